"""Joins of vectors (packed float64 units, see functions.vectors): top k of a set of queries, and all pairs above a cosine.

top_k is exact: queries and base meet in blocks of bounded size. Joins above a cosine take every pair of blocks and find candidates in it
by bands of hyperplane signs, verified exactly; a pair at the threshold is a candidate with probability 0.999, one above it with more.
With exact=True, for a threshold so low that MOST_BANDS bands can't promise this or that bands are of little use (SELECTIVE), and in
blocks where too many rows share a band (CROWDED), all pairs are compared. Rows with the same vector are one class: linked() gives
links between classes and their members, pairs_above() is its expansion, which grows with the square of a class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.vectors import binary, matrix
from notemill.session import drop_table, materialize, new_path

QUERIES, BASE = 2000, 20_000  #: rows of a block
MISS = 1e-3  #: of pairs exactly at the threshold
MOST_BANDS = 64
PAIRED = 4000  #: rows of a block of a join above a cosine
STRIP, WIDE = 512, 2048  #: rows of two blocks whose products are made at once
AGAIN = 4096  #: pairs computed again at once
SLACK = 1e-5  #: more than a float32 product of unit vectors can be off by
SELECTIVE = 0.01  #: of pairs of unlike vectors; where more would share a band, all pairs are compared
CROWDED = 0.04  #: the same, of the pairs of two blocks
PLACES = 9  #: decimals to which scores are compared, so that equal vectors tie

_F8 = np.dtype(np.float64)


def top_k(queries: DataFrame, base: DataFrame, k: int, dim: int = 64, exclude_same: bool = False) -> DataFrame:
    """(query, key, score, rank) for queries (query, u) against base (key, u); ties go to the lesser key."""
    kinds = queries.schema["query"].dataType.simpleString(), base.schema["key"].dataType.simpleString()
    schema = f"query {kinds[0]}, key {kinds[1]}, score double"
    nq, nb = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERIES), (base, BASE)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("query", "u", part("query", nq).alias("qb")).withColumn("bb", all_(nb))
    b = base.select("key", "u", part("key", nb).alias("bb")).withColumn("qb", all_(nq))

    def kernel(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, asks = right.column("key").combine_chunks(), left.column("query").combine_chunks()
        if not len(keys) or not len(asks):
            return pa.table({"query": asks[:0], "key": keys[:0], "score": pa.array([], pa.float64())})
        x, y = matrix(left.column("u"), _F8, dim), matrix(right.column("u"), _F8, dim)
        place = np.empty(len(keys), np.int64)
        place[np.asarray(pa.compute.array_sort_indices(keys))] = np.arange(len(keys))
        same = {v: i for i, v in enumerate(keys.to_pylist())} if exclude_same else {}
        names = asks.to_pylist() if exclude_same else []
        qi, bi, sc = [], [], []
        for s in range(0, len(x), 256):
            sim = np.round(x[s : s + 256] @ y.T, PLACES)
            if exclude_same:
                for r in range(sim.shape[0]):
                    if (j := same.get(names[s + r])) is not None:
                        sim[r, j] = -2.0
            n = min(k, sim.shape[1])
            bound = np.partition(sim, sim.shape[1] - n, axis=1)[:, sim.shape[1] - n]
            r, c = np.nonzero(sim >= bound[:, None])
            order = np.lexsort((place[c], -sim[r, c], r))
            r, c = r[order], c[order]
            keep = (np.arange(len(r)) - np.searchsorted(r, r) < n) & (sim[r, c] > -2.0)
            qi.append(s + r[keep])
            bi.append(c[keep])
            sc.append(sim[r[keep], c[keep]])
        return pa.table({"query": asks.take(pa.array(np.concatenate(qi))), "key": keys.take(pa.array(np.concatenate(bi))), "score": pa.array(np.concatenate(sc))})

    found = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(kernel, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def plan_bands(least: float) -> tuple[int, int] | None:
    """(signs in a band, bands): the most selective with at most MOST_BANDS bands that miss no more than MISS at the threshold; None
    if there are none."""
    p = 1 - np.arccos(min(least, 0.9999)) / np.pi
    best = None
    for r in range(4, 25):
        b = int(np.ceil(np.log(MISS) / np.log(1 - p**r)))
        if b <= MOST_BANDS:
            best = (r, b)
    return best


def _keys(x: np.ndarray, width: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys: bands x rows, folded to 16 bits; the first 128 signs of each row as two words) of unit vectors."""
    planes = np.random.default_rng(3).standard_normal((x.shape[1], max(128, width * bands)))
    keys, two = np.empty((bands, len(x)), np.uint16), np.empty((len(x), 2), np.uint64)
    for s in range(0, len(x), 2048):
        signs = x[s : s + 2048] @ planes > 0
        bits = signs[:, : width * bands].reshape(len(signs), bands, width) @ (1 << np.arange(width))
        keys[:, s : s + 2048] = ((bits ^ (bits >> 16)) & 0xFFFF).T
        two[s : s + 2048] = np.packbits(signs[:, :128], axis=1).copy().view(np.uint64)
    return keys, two


def cosines(pairs: DataFrame, dim: int, *keep: str) -> DataFrame:
    """pairs (keep..., u, v) with the cosine in place of u and v."""
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (matrix(b.column(b.schema.get_field_index(c)), _F8, dim) for c in ("u", "v"))
            yield pa.RecordBatch.from_arrays([*b.select(list(keep)).columns, pa.array(np.round((u * v).sum(axis=1), PLACES))], names=[*keep, "cosine"])

    return pairs.select(*keep, "u", "v").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", cosine double")


def _members(rows: DataFrame) -> DataFrame:
    """(rep, key): the class of each row of rows (key, u), named by its vector's hash."""
    return materialize(rows.select(F.unhex(F.md5("u")).alias("rep"), "key"), "members")


def _blocks(rows: DataFrame, dim: int, plan: tuple[int, int] | None, path: str) -> DataFrame:
    """(id, reps, x, bands, signs), written to path: rows (key, u), PAIRED to a row at most, each vector once in a block."""
    size = PAIRED

    def block(t: pa.Table) -> pa.RecordBatch:
        reps, first = np.unique(matrix(t.column("rep"), np.dtype(np.uint8), 16).view("V16").ravel(), return_index=True)
        x = matrix(t.column("u"), _F8, dim)[first]
        keys = [k.tobytes() for k in _keys(x, *plan)] if plan else [b"", b""]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (reps.tobytes(), x.tobytes(), *keys)], names=["reps", "x", "bands", "signs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, n = [], 0
        for b in batches:
            rest.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(rest)
                yield block(t.slice(0, size))
                rest, n = t.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(rest))

    few = rows.select(F.unhex(F.md5("u")).alias("rep"), "u").coalesce(max(1, -(-rows.count() // size)))
    packed = few.mapInArrow(run, "reps binary, x binary, bands binary, signs binary").select(F.monotonically_increasing_id().alias("id"), "*")
    packed.write.option("maxRecordsPerFile", 2).parquet(path)  # so that a task holds few
    return rows.sparkSession.read.schema(packed.schema).parquet(path)


def _products(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the pairs of rows of x and y whose cosine may be least, i < j if they are the same rows."""
    xs, ys = x.astype(np.float32), y.astype(np.float32)
    for s in range(0, len(x), STRIP):
        for t in range(s if same else 0, len(y), WIDE):
            sim = xs[s : s + STRIP] @ ys[t : t + WIDE].T
            i, j = np.divmod(np.flatnonzero(sim >= least - SLACK), sim.shape[1])
            i, j = i + s, j + t
            yield (i[i < j], j[i < j]) if same else (i, j)


def _sorted(keys: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order of the rows in each band, their keys in that order, either word of their signs)."""
    order = np.argsort(keys, axis=1, kind="stable")
    return order, np.take_along_axis(keys, order, 1), signs[:, 0].copy(), signs[:, 1].copy()


def _banded(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], most: int, same: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """(i, j) of the pairs of rows of x and y (as _sorted gives them) that share a band and differ in most signs at most, i < j if
    they are the same rows; None if so many share one that it is less to compare all."""
    (ox, kx, x0, x1), (oy, ky, y0, y1) = x, y
    enough, total = CROWDED * len(x0) * len(y0), 0
    met = [np.zeros(0, np.int64)]
    for o, k, p, q in zip(ox, kx, oy, ky):
        lo = np.searchsorted(q, k)
        hit = np.flatnonzero(q.take(lo, mode="clip") == k)
        lo, k = lo[hit], k[hit]
        c = np.searchsorted(q, k, "right") - lo
        total += (n := int(c.sum()))
        if total > enough:
            return None
        i = np.repeat(o[hit], c)
        j = p[np.arange(n) + np.repeat(lo - (np.cumsum(c) - c), c)]
        if same:
            i, j = i[i < j], j[i < j]
        ok = np.bitwise_count(x0[i] ^ y0[j]) + np.bitwise_count(x1[i] ^ y1[j]) <= most
        met.append(i[ok] * len(y0) + j[ok])
    return np.divmod(np.unique(np.concatenate(met)), max(1, len(y0)))


def _met(left: DataFrame, right: DataFrame | None, least: float, dim: int, exact: bool) -> DataFrame:
    """(x, y, cosine) of classes of rows (key, u) of left and right, or of left alone, each pair once: with at least that cosine.

    Blocks meet by a Cartesian product, so that nothing but what is found is shuffled."""
    plan = None if exact else plan_bands(least)
    if plan and plan[1] > SELECTIVE * 2 ** plan[0]:
        plan = None
    alone = right is None
    paths = [new_path(left.sparkSession, "blocks") for _ in range(1 if alone else 2)]
    blocks = _blocks(left, dim, plan, paths[0])
    others = blocks if alone else _blocks(right, dim, plan, paths[1])
    p = np.arccos(min(least, 0.9999)) / np.pi
    most = int(np.ceil(128 * p + 5 * np.sqrt(128 * p * (1 - p))))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c, kind, *shape: np.frombuffer(b.column(c)[r].as_buffer(), kind).reshape(*shape)  # noqa: B023, E731
                x, y, rx, ry = (get(pre + c, kind, -1, n) for c, kind, n in (("x", _F8, dim), ("reps", np.uint8, 16)) for pre in ("", "other_"))
                same = alone and b.column("id")[r] == b.column("other_id")[r]
                found = None
                if plan:
                    for pre in ("", "other_"):
                        if last.get(pre, (None,))[0] != (n := b.column(f"{pre}id")[r].as_py()):
                            last[pre] = n, _sorted(get(f"{pre}bands", np.uint16, plan[1], -1), get(f"{pre}signs", np.uint64, -1, 2))
                    found = _banded(last[""][1], last["other_"][1], most, same)
                for i, j in _products(x, y, least, same) if found is None else [found]:
                    for s in range(0, len(i), AGAIN):
                        p, q = i[s : s + AGAIN], j[s : s + AGAIN]
                        c = np.round(np.einsum("ij,ij->i", x[p], y[q]), PLACES)
                        p, q, c = p[c >= least], q[c >= least], c[c >= least]
                        yield pa.RecordBatch.from_arrays([binary(rx[p]), binary(ry[q]), pa.array(c)], names=["x", "y", "cosine"])

    i, j = F.col("id"), F.col("other_id")
    # of two blocks of one table each pair once, on either side, so that no task has all of a block's
    once = (i == j) | ((i < j) == (F.xxhash64(F.least(i, j), F.greatest(i, j)) % 2 == 0)) if alone else F.xxhash64(i, j).isNotNull()
    meet = blocks.hint("shuffle_replicate_nl").join(others.select([F.col(c).alias(f"other_{c}") for c in others.columns]), once)
    found = meet.mapInArrow(kernel, "x binary, y binary, cosine double")
    if alone:
        found = found.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "cosine")
    conf, rows_at_once = left.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows_at_once)
    conf.set(rows_at_once, "1")  # else all pairs of blocks of a task are in memory at once
    try:
        found = materialize(found.groupBy("x", "y").agg(F.max("cosine").alias("cosine")), "found")  # a vector may be in several blocks
    finally:
        conf.set(rows_at_once, before)
    for path in paths:
        drop_table(left.sparkSession, path)
    return found


def linked(rows: DataFrame, least: float, dim: int = 64, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """((x, y, cosine) of classes of rows (key, u) with at least that cosine, (rep, key): the classes' members)."""
    return _met(rows, None, least, dim, exact), _members(rows)


def pairs_above(rows: DataFrame, least: float, dim: int = 64, exact: bool = False) -> DataFrame:
    """(a, b, cosine), a < b: the pairs of rows (key, u) with at least that cosine (compared to PLACES decimals)."""
    links, members = linked(rows, least, dim, exact)
    left, right = members.select(F.col("rep").alias("x"), F.col("key").alias("m")), members.select(F.col("rep").alias("y"), F.col("key").alias("n"))
    wide = links.join(left, "x").join(right, "y").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"), "cosine")
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("rep")
    some = members.join(copies, "rep")
    same = some.select("rep", F.col("key").alias("a")).join(some.select("rep", F.col("key").alias("b")), "rep").where("a < b")
    return wide.unionByName(same.select("a", "b", F.lit(1.0).alias("cosine")))


def pairs_between(left: DataFrame, right: DataFrame, least: float, dim: int = 64, exact: bool = False) -> DataFrame:
    """(left, right, cosine) of pairs of rows (key, u) of two sets with at least that cosine. Neither set is paired with itself."""
    found, ma, mb = _met(left, right, least, dim, exact), _members(left), _members(right)
    found = found.join(ma.select(F.col("rep").alias("x"), F.col("key").alias("left")), "x")
    return found.join(mb.select(F.col("rep").alias("y"), F.col("key").alias("right")), "y").select("left", "right", "cosine")
