"""Pivot permutations: a bounded set of pivot vectors, each row's ordered nearest pivots, and blocks of the pivots' lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.functions.vectors import binary, matrix, with_unit
from notemill.session import materialize

MAX_PIVOTS = 4096  #: pivots collected to the driver: at most this many vectors, whatever the input
ROWS_PER_PIVOT = 200  #: there is a pivot for so many rows; beyond MAX_PIVOTS of them lists get longer, and pivots of their own
LONG = 6000  #: a list of more rows than this (some 800 are meant) has pivots of its own
SUBLISTS, SUBPREFIX = 3, 12  #: of these, the lists each of its rows is posted in, and the pivots of its new permutation
SHARE = 4000  #: rows of such a list that one task permutes


def distinct_entries(df: DataFrame, key: str, vec: str, dim: int, dtype: type = np.float32) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows with a usable vector: themselves as a table (key, h, u: packed unit vector); (rep, key) of those whose vector is
    repeated; and (rep, u), each vector once.

    Copies are found by digest, in short columns; they are a table of their own, so that Spark knows its size when it plans joins."""
    units = with_unit(df.select(F.col(key).alias("key"), F.col(vec).alias("vec")), dim=dim, dtype=dtype)
    rows = materialize(units.withColumn("h", F.unhex(F.md5("u"))), "units")
    copies = rows.groupBy("h").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = materialize(rows.select("h", "key").join(materialize(copies, "copies"), "h").select("rep", "key"), "members")
    entries = rows.join(members.where("key <> rep").select("key"), "key", "left_anti").select(F.col("key").alias("rep"), "u")
    return rows, members, entries


def fit_pivots(entries: DataFrame, dim: int, pivots: int | None = None) -> np.ndarray:
    """A bounded sample of the distinct vectors (rep, u) as pivots: those least by a hash of rep, so it doesn't depend on the order of
    rows, and however many copies a vector has it is one pivot at most.

    The sample is only the index's coordinate system; every row is indexed."""
    if pivots is None:
        pivots = int(min(MAX_PIVOTS, max(32, entries.count() // ROWS_PER_PIVOT)))
    drawn = entries.select("rep", F.xxhash64("rep").alias("h")).orderBy("h", "rep").limit(pivots)  # no vectors are sorted
    got = entries.join(F.broadcast(drawn), "rep").orderBy("h", "rep").select("u").toArrow()
    return matrix(got.column(0), np.dtype(np.float32), dim)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, in order."""
    prefix = min(prefix, len(pivots))
    out = np.empty((len(x), prefix), np.int64)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ pivots.T
        top = np.argpartition(-s, prefix - 1, axis=1)[:, :prefix] if prefix < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out[i : i + 4096] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def permute(df: DataFrame, pivots: np.ndarray, dim: int, prefix: int) -> DataFrame:
    """df, which has u, with perm (packed uint16: the nearest pivots in order)."""
    schema = T.StructType([*df.schema.fields, T.StructField("perm", T.BinaryType(), False)])
    prefix = min(prefix, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            perm = nearest_pivots(matrix(b.column(b.schema.get_field_index("u")), np.dtype(np.float32), dim), pivots, prefix).astype(np.uint16)
            yield from pa.Table.from_batches([b]).append_column("perm", binary(perm)).to_batches()

    return df.mapInArrow(run, schema)


def pivot_at(i: int) -> Column:
    """The i-th nearest pivot of perm (little-endian uint16)."""
    two = F.hex(F.substring("perm", 2 * i + 1, 2))
    return F.conv(F.concat(F.substring(two, 3, 2), F.substring(two, 1, 2)), 16, 10).cast("int")


def _refined(posted: DataFrame, cells: list[tuple[int, int]], dim: int) -> DataFrame:
    """Rows of long lists (cell, rep, u, perm; cells: theirs and their lengths) in shorter ones, by pivots drawn from each list alone.

    So at any size a list is as long as meant, and a list that is long because its rows are alike is told apart by pivots among them.
    A list's pivots, one for ROWS_PER_PIVOT rows by a hash, meet each share of its rows in a task; none is collected."""
    n = F.create_map(*[F.lit(int(x)) for cell, rows in cells for x in (cell, -(-rows // SHARE))])[F.col("cell")]
    kind = posted.schema["rep"].dataType.simpleString()
    rows = posted.where(F.col("cell").isin([c for c, _ in cells]))
    drawn = rows.where(F.pmod(F.xxhash64("rep", "cell"), F.lit(ROWS_PER_PIVOT)) == 0)
    drawn = drawn.select("cell", F.explode(F.sequence(F.lit(0), n - 1)).alias("share"), F.xxhash64("rep").alias("h"), "u")
    rows = rows.select("cell", F.pmod(F.xxhash64("rep", F.lit(3)), n).cast("int").alias("share"), "rep", "u")
    meets = drawn.select("cell", "share", F.lit(None).cast(kind).alias("rep"), "u", "h").unionByName(rows.withColumn("h", F.lit(None).cast("bigint")))
    names = ["cell", "rep", "u", "perm"]

    def kernel(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        pivot = np.asarray(t.column("h").is_valid())
        x = matrix(t.column("u"), np.dtype(np.float32), dim)
        at = np.flatnonzero(pivot)
        base = x[at[np.argsort(np.asarray(t.column("h").combine_chunks().fill_null(0))[at], kind="stable")]]
        mine = t.filter(pa.array(~pivot)).combine_chunks()
        x = x[~pivot]
        cell = int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
        if not len(base):
            base = x[:1]
        perm = nearest_pivots(x, base, SUBPREFIX).astype(np.uint16)
        for i in range(min(SUBLISTS, perm.shape[1])):
            # a list's number: its own within that of the list it divides
            number = -((cell + 1) << 16) - perm[:, i].astype(np.int64) - 1
            yield pa.RecordBatch.from_arrays([pa.array(number), mine.column("rep").combine_chunks(), mine.column("u").combine_chunks(), binary(perm)], names=names)

    return meets.groupBy("cell", "share").applyInArrow(kernel, f"cell bigint, rep {kind}, u binary, perm binary")


def lists_of(df: DataFrame, lists: int, dim: int) -> DataFrame:
    """(cell, rep, u, perm): each row of df (rep, u, perm) in the inverted lists of its nearest pivots, long lists divided."""
    posted = df.select(F.explode(F.array(*[pivot_at(i).cast("bigint") for i in range(lists)])).alias("cell"), "rep", "u", "perm")
    cells = [(r["cell"], r["count"]) for r in posted.groupBy("cell").count().where(F.col("count") > LONG).collect()]  # bounded by MAX_PIVOTS
    if not cells:
        return posted
    return posted.where(~F.col("cell").isin([c for c, _ in cells])).unionByName(materialize(_refined(posted, cells, dim), "refined"))


def post(df: DataFrame, lists: int, block: int, dim: int) -> DataFrame:
    """Each row of df (rep, u, perm) in the lists of its nearest pivots, as blocks: columns cell, a, b, side, rep, u, perm.

    A list longer than block rows even so is divided by a hash of rep into several blocks, and each pair of its blocks a <= b is a
    group of its own, so no group exceeds two blocks by much, however dense a list is."""
    posted = lists_of(df, lists, dim)
    long = materialize(posted.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("n")), "long")
    posted = posted.join(long, "cell", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return (
        posted.withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("a", F.least("mine", "other"))
        .withColumn("b", F.greatest("mine", "other"))
        .withColumn("side", F.when(F.col("a") == F.col("b"), 2).otherwise((F.col("mine") == F.col("b")).cast("int")))
        .drop("mine", "other", "n")
    )


def unpack(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = matrix(table.column("u"), np.dtype(np.float32), dim)
    first = table.column("perm")[0].as_py() if table.num_rows else b""
    return x, matrix(table.column("perm"), np.dtype(np.uint16), len(first) // 2)
