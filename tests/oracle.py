"""Comparison of a query's rows with those of its SQL, whatever their order."""

import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        if f.endswith(".parquet"):
            at = f"{DATA}/{f}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{f}") else "")
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{at}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, query, sql):
    df = query(spark, DATA)
    c = connect()
    got = c.execute(sql)
    want = rows([d[0] for d in got.description], got.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
