"""Problem 6: the k most similar vectors of every vector, exactly (similar_pairs), and of a stated set of them, by a permutation index
(similar_to).

similar_pairs compares every pair of rows, in blocks: float32 products tell which pairs may count, these are computed again in
float64. What is found of a row depends on its cosines alone, whatever the table's size, and the cost grows with the square of the
rows.

In the index, every row is represented by its ordered nearest pivots (a prefix of its permutation of the pivots) and posted in the lists
of the nearest of them. Within a list, rows are ranked by the footrule distance of their prefixes, and those ranked best are
reranked by cosine. In both, rows with the same vector are one entry, expanded at the end, so no group of copies is compared with itself.

Defined results: rows without a usable vector (null, wrong length, not finite, all zero) neither ask nor answer; cosines equal
to 5 decimals are ordered by key; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.vectors import matrix, with_unit
from notemill.llm.pivots import distinct_entries, fit_pivots, permute, pivot_at, unpack
from notemill.session import drop_table, materialize

BLOCK = 6000  #: rows of a block, or of a list, compared at once
STRIP, WIDTH = 512, 2048  #: rows of two blocks whose products are made at once
AGAIN = 65_536  #: pairs computed again at once
SLACK = 1e-5  #: more than a float32 product of unit vectors can be off by


def footrule(q: np.ndarray, o: np.ndarray, pivots: int) -> np.ndarray:
    """Footrule distance of each prefix in q to each in o; a pivot missing from a prefix counts as placed after its end."""
    n = q.shape[1]
    place = np.full((len(o), pivots), n, np.uint8)
    np.put_along_axis(place, o.astype(np.int64), np.arange(n, dtype=np.uint8)[None, :], 1)
    gain = (n - place).T.copy()  # pivots x rows: how far before the end it is placed
    out = np.empty((len(q), len(o)), np.uint16)
    mine = (n - np.arange(n)).astype(np.uint8)[:, None]
    for i, p in enumerate(q):
        out[i] = n * (n + 1) - 2 * np.minimum(gain[p], mine).sum(axis=0, dtype=np.uint16)
    return out


def _rerank(xq: np.ndarray, pq: np.ndarray, xo: np.ndarray, po: np.ndarray, candidates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pivots = int(max(pq.max(initial=0), po.max(initial=0))) + 1
    out = []
    for s in range(0, len(xq), 512):
        far = footrule(pq[s : s + 512], po, pivots)
        if candidates < far.shape[1]:
            bound = np.partition(far, candidates - 1, axis=1)[:, candidates - 1 : candidates]
            i, j = np.nonzero(far <= bound)
        else:
            i, j = (x.ravel() for x in np.indices(far.shape))
        out.append((s + i, j, np.einsum("ij,ij->i", xq[s + i].astype(np.float64), xo[j].astype(np.float64))))
    i, j, c = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i, j, c


def _best(i: np.ndarray, j: np.ndarray, c: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among their asking row's first k, by cosine (5 decimals) and name."""
    order = np.lexsort((names[j], -np.round(c, 5), i))
    si = i[order]
    rank = np.arange(len(si)) - np.searchsorted(si, si)
    return order[rank < k]


def _alike(x: np.ndarray, y: np.ndarray, same: bool, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of rows of x and y with a cosine of at least least, y's among the first k of x's row; and of y and x likewise,
    unless they are the same rows. Rows are in order of their keys."""
    xs, ys = x.astype(np.float32), y.astype(np.float32)
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    join = lambda *found: tuple(np.concatenate(z) for z in zip(*found))

    def first(i: np.ndarray, j: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = _best(i, j, c, np.arange(n), k)
        return i[keep], j[keep], c[keep]

    def kth(sim: np.ndarray, axis: int) -> np.ndarray | float:
        """What a product must reach to be among the first k of its row or column, or to tie with them in 5 decimals."""
        n = sim.shape[axis]
        return np.partition(sim, n - k, axis=axis).take([n - k], axis) - 2 * SLACK - 1e-5 if k < n else -np.inf

    there, back = [none], none
    for s in range(0, len(x), STRIP):
        found = [none]
        for t in range(0, len(y), WIDTH):
            sim = xs[s : s + STRIP] @ ys[t : t + WIDTH].T
            if same:
                at = np.arange(max(s, t), min(s + sim.shape[0], t + sim.shape[1]))
                sim[at - s, at - t] = -np.inf
            hit = sim >= least - SLACK
            if np.count_nonzero(hit) > 4 * k * sum(sim.shape):  # as many can't all be among the first
                hit &= (sim >= kth(sim, 1)) | (sim >= kth(sim, 0))
            i, j = np.divmod(np.flatnonzero(hit), sim.shape[1])
            i, j = i + s, j + t
            for a in range(0, len(i), AGAIN):
                p, q = i[a : a + AGAIN], j[a : a + AGAIN]
                c = np.einsum("ij,ij->i", x[p], y[q])
                ok = c >= least
                found.append((p[ok], q[ok], c[ok]))
        i, j, c = join(*found)
        there.append(first(i, j, c, len(y)))
        if not same and len(i):
            back = first(*join(back, (j, i, c)), len(x))
    return [join(*there)] if same else [join(*there), back]


def _blocks(entries: DataFrame, block: int, dim: int) -> DataFrame:
    """(id, reps, x): entries (rep, u), so many to a row, in order of rep; x is their packed vectors."""
    kind = entries.schema["rep"].dataType.simpleString()

    def row(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("rep").combine_chunks()
        reps = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("rep").combine_chunks())
        return pa.RecordBatch.from_arrays([reps, pa.array([matrix(t.column("u"), np.dtype(np.float64), dim).tobytes()], pa.binary())], names=["reps", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            t = pa.Table.from_batches([*rest, b])
            for s in range(0, t.num_rows - block + 1, block):
                yield row(t.slice(s, block))
            rest = t.slice(t.num_rows // block * block).to_batches()
        if rest:
            yield row(pa.Table.from_batches(rest))

    packed = entries.select("rep", "u").mapInArrow(run, f"reps array<{kind}>, x binary")
    return materialize(packed.select(F.monotonically_increasing_id().alias("id"), "reps", "x"), "blocks")


def similar_pairs(df: DataFrame, key: str, vec: str, k: int = 5, min_cosine: float = -1.0, dim: int = 64, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(key, neighbour, cosine, rank): for each row of df with a usable vector its k most similar other rows, of cosine at least min_cosine.

    key must be unique and not null. Every pair is compared, whatever block is; pivots, which callers of the former index give, has no effect."""
    data = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    kind = data.schema["key"].dataType.simpleString()
    _, members, entries = distinct_entries(data, "key", "vec", dim, np.float64)
    blocks = _blocks(entries, block, dim)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                same = b.column("id")[r] == b.column("other_id")[r]
                x, y = (np.frombuffer(b.column(n)[r].as_buffer(), np.float64).reshape(-1, dim) for n in ("x", "other_x"))
                names = b.column("reps")[r].values, b.column("other_reps")[r].values
                for (i, j, c), (mine, other) in zip(_alike(x, y, same, k, min_cosine), (names, names[::-1])):
                    yield pa.RecordBatch.from_arrays([mine.take(pa.array(i)), other.take(pa.array(j)), pa.array(c, pa.float64())], names=["rep", "other", "cosine"])

    # each pair of blocks once, on either side, so that no task has all of a block's; neither side is moved to disk for it
    i, j = F.col("id"), F.col("other_id")
    once = (i == j) | ((i < j) == (F.xxhash64(F.least(i, j), F.greatest(i, j)) % 2 == 0))
    met = blocks.join(blocks.select([F.col(c).alias(f"other_{c}") for c in blocks.columns]), once)
    links = met.mapInArrow(kernel, f"rep {kind}, other {kind}, cosine double")
    # a class of copies that is not among the first k, by its least key, has no row that is
    order = Window.partitionBy("rep").orderBy(F.round("cosine", 5).desc(), "other")
    links = links.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    # the k + 1 least keys of each repeated vector answer for all of its rows
    first = Window.partitionBy("rep").orderBy("key")
    least = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("rep", "key")
    answers = least.select(F.col("rep").alias("other"), F.col("key").alias("neighbour"))
    askers = members.select("rep", "key")
    wide = links.join(answers, "other", "left").select("rep", F.coalesce("neighbour", "other").alias("neighbour"), "cosine")
    wide = wide.join(askers, "rep", "left").select(F.coalesce("key", "rep").alias("key"), "neighbour", "cosine")
    own = members.join(least.withColumnRenamed("key", "neighbour"), "rep").where("key <> neighbour").select("key", "neighbour", F.lit(1.0).alias("cosine"))
    if min_cosine > 1:
        own = own.limit(0)
    order = Window.partitionBy("key").orderBy(F.round("cosine", 5).desc(), "neighbour")
    ranked = wide.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "neighbour", "cosine", "rank")


STORE_LISTS, ASK_LISTS, ASK_PREFIX, ASK_CANDIDATES = 4, 32, 32, 500
ASK_BLOCK = 2000  #: asking rows compared with a block of a list in one task


def similar_to(queries: DataFrame, df: DataFrame, key: str, vec: str, k: int = 5, dim: int = 64, pivots: int | None = None) -> DataFrame:
    """(key, neighbour, cosine, rank): for the rows of queries (key, vec), a stated set, their k most similar rows of df, whatever the
    cosine. A row is not its own neighbour.

    Far neighbours share fewer pivots than near ones, so a query reads many more lists than a row is posted in."""
    spark = df.sparkSession
    pick = lambda d: d.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    data, ask = pick(df), pick(queries)
    kind = data.schema["key"].dataType.simpleString()
    rows, members, entries = distinct_entries(data, "key", "vec", dim)
    base = fit_pivots(entries, dim, pivots)
    if not len(base):
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, cosine double, rank int")
    prefix = min(ASK_PREFIX, len(base))
    entries = materialize(permute(entries, base, dim, prefix), "permuted")
    drop_table(spark, rows.inputFiles()[0].rpartition("/")[0])  # not read again
    asks = materialize(permute(with_unit(ask, dim=dim), base, dim, prefix).dropDuplicates(["key"]), "asks")
    posted = entries.withColumn("cell", F.explode(F.array(*[pivot_at(i) for i in range(min(STORE_LISTS, prefix))])))
    asked = asks.withColumn("cell", F.explode(F.array(*[pivot_at(i) for i in range(min(ASK_LISTS, prefix))])))
    # a long list, or one that many ask, is dealt to several tasks; a count for each pivot
    parts = lambda d, size: {r["cell"]: -(-r["count"] // size) for r in d.groupBy("cell").count().collect() if r["count"] > size}
    nb, nq = parts(posted, BLOCK), parts(asked, ASK_BLOCK)
    of = lambda n: F.coalesce(F.create_map(*[F.lit(x) for kv in n.items() for x in kv])[F.col("cell")], F.lit(1)) if n else F.lit(1)
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), of(n)).cast("int")
    posted = posted.withColumn("bb", deal("rep", nb)).withColumn("qb", F.explode(F.sequence(F.lit(0), of(nq) - 1)))
    asked = asked.withColumn("qb", deal("key", nq)).withColumn("bb", F.explode(F.sequence(F.lit(0), of(nb) - 1)))

    def kernel(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        asks, reps = left.column("key").combine_chunks(), right.column("rep").combine_chunks()
        if not len(asks) or not len(reps):
            return pa.table({"key": asks[:0], "rep": reps[:0], "cosine": pa.array([], pa.float64())})
        (x, p), (y, q) = unpack(left.combine_chunks(), dim), unpack(right.combine_chunks(), dim)
        place = np.empty(len(reps), np.int64)
        place[np.asarray(pa.compute.array_sort_indices(reps))] = np.arange(len(reps))
        i, j, c = _rerank(x, p, y, q, ASK_CANDIDATES)
        keep = _best(i, j, c, place, k + 1)
        return pa.table({"key": asks.take(pa.array(i[keep])), "rep": reps.take(pa.array(j[keep])), "cosine": pa.array(c[keep])})

    by = ["cell", "qb", "bb"]
    found = asked.select(*by, "key", "u", "perm").groupBy(*by).cogroup(posted.select(*by, "rep", "u", "perm").groupBy(*by)).applyInArrow(kernel, f"key {kind}, rep {kind}, cosine double")
    found = found.groupBy("key", "rep").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("key").orderBy(F.round("cosine", 5).desc(), "rep")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("r") <= k + 1).select("rep", F.col("key").alias("copy"))
    wide = found.join(least, "rep", "left").select("key", F.coalesce("copy", "rep").alias("neighbour"), "cosine").where("key <> neighbour")
    order = Window.partitionBy("key").orderBy(F.round("cosine", 5).desc(), "neighbour")
    ranked = wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "neighbour", "cosine", "rank")
