"""Problem 3: themes of notes, by hierarchical density clustering.

Each vector's neighbours are looked for among the rows in the lists of its nearest pivots. A row's core distance is that to the
NEIGHBOURS-th of them, over all its lists; an edge to a neighbour weighs their mutual reachability distance, the greatest of the
edge and both core distances. Forests of the edges are taken within partitions first, for an edge that is in no forest of a part is in
none of the whole. The hierarchy is then built from the densest level up (see hierarchy.py): rows become components, components of
`least_rows` rows become clusters, clusters merge. Of each branch the clusters with the greatest stability are the themes, a row
belongs to the theme whose branch it joined, at the density it joined it, and rows that joined above all themes belong to none. The
most persistent members, those that joined at the greatest density, are a theme's exemplars.

A row that the hierarchy puts into a theme stays in it if its cosine with the theme's mean direction is at least `least`; no row is
put into a theme by its cosine.

Defined results: rows without a usable vector belong to no theme; equal vectors are one node of the hierarchy, and all of their rows
members; where the whole collection is one branch it is no theme itself, unless nothing in it divides; an empty table gives none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.vectors import matrix
from notemill.llm.hierarchy import LEVELS, condensed, spanning
from notemill.llm.pivots import distinct_entries, fit_pivots, permute, post, unpack
from notemill.session import drop_table, materialize

LISTS, BLOCK, PREFIX = 3, 3000, 4
NEIGHBOURS = 8  #: that set a row's core distance
LEAST_ROWS = 25  #: different vectors that make a theme, however many there are in all
SUMS = 4096  #: themes whose vectors a task adds up at once


def _nearest(x: np.ndarray, y: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the k nearest in y of each row of x."""
    k = min(k, len(y) - same)
    ii, jj, dd = [], [], []
    for s in range(0, len(x), 1000):
        sim = x[s : s + 1000] @ y.T
        rows = np.arange(sim.shape[0])
        if same:
            sim[rows, rows + s] = -2
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        ii.append(np.repeat(rows + s, k))
        jj.append(top.ravel())
        dd.append(1 - np.take_along_axis(sim, top, 1).astype(np.float64).ravel())
    return np.concatenate(ii), np.concatenate(jj), np.concatenate(dd)


def neighbours(posted: DataFrame, dim: int, k: int) -> DataFrame:
    """(node, other, d): each row's k nearest in each of its blocks, with their distances."""

    def kernel(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        x, _p = unpack(t, dim)
        node, side = np.asarray(t.column("node")), np.asarray(t.column("side"))
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        whole = np.arange(len(side))
        pairs = [(whole, whole, True)] if len(side) > 1 and side[0] == 2 else [(l, r, False), (r, l, False)] if len(l) and len(r) else []
        for a, b, same in pairs:
            i, j, d = _nearest(x[a], x[b], same, k)
            yield pa.RecordBatch.from_arrays([pa.array(node[a[i]]), pa.array(node[b[j]]), pa.array(d)], names=["node", "other", "d"])

    return posted.withColumn("node", F.xxhash64("u")).select("cell", "a", "b", "side", "node", "u", "perm").groupBy("cell", "a", "b").applyInArrow(kernel, "node bigint, other bigint, d double")


def reachability(found: DataFrame, k: int) -> DataFrame:
    """(a, b, level) of the edges of the mutual-reachability graph, from rows' neighbours (node, other, d) of all their lists."""
    # hashed by node, so that both groupings and no more than that move the rows once
    once = found.where("node <> other").repartition("node").groupBy("node", "other").agg(F.min("d").alias("d"))
    near = F.slice(F.sort_array(F.collect_list(F.struct("d", "other"))), 1, k)  # a row has k neighbours in each of its blocks
    rows = materialize(once.groupBy("node").agg(near.alias("near")).select("node", "near", F.element_at("near", -1)["d"].alias("core")), "cores")
    edges = rows.select("node", "core", F.explode("near").alias("n")).select("node", "core", F.col("n.other").alias("other"), F.col("n.d").alias("d"))
    edges = edges.join(rows.select(F.col("node").alias("other"), F.col("core").alias("theirs")), "other")
    level = F.greatest(F.ceil(F.greatest("d", "core", "theirs") * LEVELS).cast("int"), F.lit(0))
    edges = edges.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), level.alias("level")).where(F.col("level") <= LEVELS)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, w = (np.asarray(b.column(n)) for n in ("a", "b", "level"))
            ids, at = np.unique(np.concatenate([a, c]), return_inverse=True)
            keep = spanning(len(ids), at[: len(a)], at[len(a) :], w)
            yield b.take(pa.array(keep))

    return edges.mapInArrow(forest, "a bigint, b bigint, level int")


def _means(members: DataFrame, dim: int) -> DataFrame:
    """(theme, mean): the packed mean direction of each theme's rows (theme, u), added up before they are moved."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["theme", "sums"])

        for b in batches:
            x, l = matrix(b.column("u"), np.dtype(np.float32), dim).astype(np.float64), np.asarray(b.column("theme"))
            for v in np.unique(l):
                sums[int(v)] = sums.get(int(v), 0) + x[l == v].sum(axis=0)
            if len(sums) > SUMS:
                yield out()
                sums = {}
        if sums:
            yield out()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("sums").flatten()).reshape(-1, dim)
            x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
            yield pa.RecordBatch.from_arrays([b.column("theme"), pa.array([v.tobytes() for v in x], pa.binary())], names=["theme", "mean"])

    part = members.select("theme", "u").mapInArrow(add, "theme bigint, sums array<double>")
    total = part.groupBy("theme").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    return total.mapInArrow(unit, "theme bigint, mean binary")


def _cosines(rows: DataFrame, kind: str, dim: int) -> DataFrame:
    """rows (key, theme, persistence, u, mean) with the cosine in place of u and mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = matrix(b.column("u"), np.dtype(np.float32), dim).astype(np.float64), matrix(b.column("mean"), np.dtype(np.float64), dim)
            yield pa.RecordBatch.from_arrays([*b.select(["key", "theme", "persistence"]).columns, pa.array((x * m).sum(axis=1))], names=["key", "theme", "persistence", "cosine"])

    return rows.select("key", "theme", "persistence", "u", "mean").mapInArrow(run, f"key {kind}, theme bigint, persistence double, cosine double")


def themes(df: DataFrame, key: str, vec: str, least: float = 0.35, dim: int = 64, least_rows: int = LEAST_ROWS, **options: int) -> DataFrame:
    """(key, theme, cosine, persistence): the members of each theme. theme is an opaque number, persistence the cosine at which a row joined."""
    spark = df.sparkSession
    data = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    kind = data.schema["key"].dataType.simpleString()
    rows, _, entries = distinct_entries(data, "key", "vec", dim)
    base = fit_pivots(entries, dim)
    if not len(base):
        return spark.createDataFrame([], f"{key} {kind}, theme bigint, cosine double, persistence double")
    entries = materialize(permute(entries, base, dim, min(PREFIX, len(base))), "permuted")
    posted = post(entries, min(LISTS, len(base)), BLOCK, dim)
    edges = materialize(reachability(neighbours(posted, dim, NEIGHBOURS), NEIGHBOURS), "edges")
    drop_table(spark, entries.inputFiles()[0].rpartition("/")[0])  # not read again
    labels = condensed(edges, least_rows, **options)
    node = rows.select("key", "u", F.xxhash64("u").alias("node"))
    members = node.join(labels, "node").select("key", "u", "theme", (1 - F.col("level") / LEVELS).alias("persistence"))
    members = materialize(members, "members")
    return _cosines(members.join(_means(members, dim), "theme"), kind, dim).where(F.col("cosine") >= least).select(F.col("key").alias(key), "theme", "cosine", "persistence")


def tag_names(tags_json: Column) -> Column:
    """Tags in one spelling: of a JSON array, or else of a text with commas or spaces between them."""
    parsed = F.from_json(tags_json, "array<string>")
    tags = F.when(F.trim(tags_json).startswith("["), parsed).otherwise(F.split(F.regexp_replace(tags_json, r'^"|"$', ""), r"[,\s]+"))
    clean = F.transform(tags, lambda t: F.regexp_replace(F.lower(F.trim(t)), r"^#+", ""))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def describe(members: DataFrame, notes: DataFrame, key: str = "path", exemplars: int = 5, tags: int = 5) -> DataFrame:
    """(theme, size, cohesion, exemplars, tags, folder) from members and notes (key, tags_json, folder)."""
    first = lambda by, *order: F.row_number().over(Window.partitionBy("theme").orderBy(*order))
    size = members.groupBy("theme").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("cosine"), 4).alias("cohesion"))
    top = members.withColumn("r", first("theme", F.col("persistence").desc(), F.col("cosine").desc(), key)).where(F.col("r") <= exemplars)
    top = top.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("exemplars"))
    both = members.select(key, "theme").join(notes.select(key, "tags_json", "folder"), key)
    tag = both.select("theme", F.explode(tag_names(F.col("tags_json"))).alias("tag")).groupBy("theme", "tag").count()
    tag = tag.withColumn("r", first("theme", F.col("count").desc(), "tag")).where(F.col("r") <= tags)
    tag = tag.groupBy("theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("tags"))
    folder = both.groupBy("theme", "folder").count().withColumn("r", first("theme", F.col("count").desc(), "folder")).where("r = 1").select("theme", "folder")
    return size.join(top, "theme", "left").join(tag, "theme", "left").join(folder, "theme", "left")
