"""Minimum spanning forests, and the condensed hierarchy of density clustering over a graph of any size.

The hierarchy is built from the densest level up. At each level the components that edges of that level join become one. A component
of `least` nodes or more is a cluster: a new one if none of its parts was, the same one if one was, a new one above all of its parts
if several were. A cluster's stability is its mass times the span of levels over which it exists, added up (excess of mass, with the
cosine of mutual reachability as the density: bounded, so that a few equal rows don't outweigh a theme). A cluster is chosen if its
stability is no less than that of all chosen below it and none above it is.

Levels are LEVELS steps of distance, the same for any input. While the graph has more than AT_ONCE edges, a level is a few joins on
tables in the shared folder; what is left is done in one task by the same rules, with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.bands import mix64
from notemill.llm.components import components
from notemill.session import materialize

LEVELS = 64  #: from a cosine of 1 to one of 0; what is farther is no edge
AT_ONCE = 2_000_000  #: edges that one task takes, and twice as many components


def spanning(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Borůvka: which of the edges (i, j, w) make the minimum spanning forest of n nodes."""
    order = np.lexsort((np.maximum(i, j), np.minimum(i, j), w))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    comp = np.arange(n)
    taken: list[np.ndarray] = []
    live = np.arange(len(i))
    while True:
        a, b = comp[i[live]], comp[j[live]]
        out = a != b
        live, a, b = live[out], a[out], b[out]
        if not len(live):
            return np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
        best = np.full(n, len(order))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        has = np.flatnonzero(best < len(order))
        edge = order[best[has]]
        taken.append(np.unique(edge))
        ea, eb = comp[i[edge]], comp[j[edge]]
        parent = np.arange(n)
        parent[has] = np.where(ea == has, eb, ea)
        mutual = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)
        parent[mutual] = np.flatnonzero(mutual)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        comp = parent[comp]


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    top = np.arange(n)
    while len(i):
        a, b = top[i], top[j]
        out = a != b
        i, j, a, b = i[out], j[out], a[out], b[out]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not (top[top] == top).all():
            top = top[top]
    return top


Rows = dict[str, np.ndarray]


def condense(ids: np.ndarray, state: Rows, i: np.ndarray, j: np.ndarray, level: np.ndarray, least: int) -> tuple[Rows, Rows]:
    """The rest of the hierarchy from components (ids, ascending, and their state: mass, cluster (0: none), stability, below, since)
    and edges (i, j: their places, level): where components join (comp, cluster, level), and clusters (cluster, parent, ok)."""
    mass, cluster, stable, below, since = (state[c].copy() for c in ("mass", "cluster", "stability", "below", "since"))
    went: list[np.ndarray] = [ids[:0]] * 3
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    place = np.arange(len(ids))  # the live component that each first one is in now
    order = np.argsort(level, kind="stable")
    i, j, level = i[order], j[order], level[order]
    small = np.ones(len(ids), bool)  # of the first ones: in no cluster yet
    small[cluster != 0] = False
    for l in np.unique(level):
        s = slice(*np.searchsorted(level, [l, l + 1]))
        root = _joined(len(ids), place[i[s]], place[j[s]])
        old = np.unique(place)
        r = root[old]
        changed = np.bincount(r, minlength=len(ids)) > 1
        old, r = old[changed[r]], r[changed[r]]
        if not len(old):
            continue
        new = np.unique(r)
        big = cluster[old] != 0
        total = np.bincount(r, mass[old], minlength=len(ids)).astype(np.int64)
        now = stable[old] + mass[old] * (l - since[old])
        n = np.bincount(r[big], minlength=len(ids))
        lower = np.bincount(r[big], np.maximum(now, below[old])[big], minlength=len(ids))
        name = np.zeros(len(ids), np.int64)
        kept_s, kept_b = np.zeros(len(ids)), np.zeros(len(ids))
        one = big & (n[r] == 1)
        name[r[one]], kept_s[r[one]], kept_b[r[one]] = cluster[old[one]], now[one], below[old[one]]
        fresh = new[(total[new] >= least) & (n[new] != 1)]
        name[fresh] = mix64(ids[fresh].view(np.uint64) ^ mix64(np.full(len(fresh), l + 1, np.uint64))).view(np.int64)
        kept_b[fresh] = lower[fresh]
        over = big & (n[r] > 1)
        done = [np.concatenate(x) for x in zip(done, (cluster[old[over]], name[r[over]], (now >= below[old])[over].astype(np.int64)))]
        mass[new], cluster[new], stable[new], below[new], since[new] = total[new], name[new], kept_s[new], kept_b[new], l
        place = root[place]
        in_now = small & (cluster[place] != 0)
        went = [np.concatenate(x) for x in zip(went, (ids[in_now], cluster[place[in_now]], np.full(in_now.sum(), l)))]
        small &= ~in_now
    live = np.unique(place)
    live = live[cluster[live] != 0]
    ok = stable[live] + mass[live] * (LEVELS - since[live]) >= below[live]
    if len(live) == 1 and below[live[0]] > 0:
        ok[:] = False  # the whole is no theme if anything in it is
    done = [np.concatenate(x) for x in zip(done, (cluster[live], np.zeros(len(live), np.int64), ok.astype(np.int64)))]
    return dict(zip(("comp", "cluster", "level"), went)), dict(zip(("cluster", "parent", "ok"), done))


def _rest(edges: DataFrame, comps: DataFrame, least: int) -> DataFrame:
    """(comp, cluster, level, parent, ok): condense() of what is left, in one task; rows of components, and of clusters (comp null)."""
    held = edges.select(F.col("a").alias("comp")).unionByName(edges.select(F.col("b").alias("comp"))).unionByName(comps.where("cluster <> 0").select("comp")).distinct()
    no = lambda kind: F.lit(0).cast(kind)
    rows = edges.select("a", "b", F.col("level").alias("since"), no("bigint").alias("mass"), no("bigint").alias("cluster"), no("double").alias("stability"), no("double").alias("below"))
    nodes = held.join(comps, "comp", "left").select(F.col("comp").alias("a"), F.col("comp").alias("b"), F.coalesce("since", F.lit(0)).alias("since"), F.coalesce("mass", F.lit(1)).alias("mass"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cluster", "stability", "below")])

    def kernel(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        c = {n: np.asarray(t.column(n).combine_chunks()) for n in ("a", "b", "since", "mass", "cluster", "stability", "below")}
        node = c["mass"] > 0
        ids, at = np.unique(c["a"][node], return_index=True)
        state = {n: c[n][node][at] for n in ("mass", "cluster", "stability", "below", "since")}
        went, done = condense(ids, state, np.searchsorted(ids, c["a"][~node]), np.searchsorted(ids, c["b"][~node]), c["since"][~node], least)
        n, m = len(went["comp"]), len(done["cluster"])
        none = lambda k: pa.nulls(k, pa.int64())
        col = lambda x: pa.array(x.astype(np.int64))
        yield pa.RecordBatch.from_arrays([col(went["comp"]), col(went["cluster"]), col(went["level"]), none(n), none(n)], names=["comp", "cluster", "level", "parent", "ok"])
        yield pa.RecordBatch.from_arrays([none(m), col(done["cluster"]), none(m), col(done["parent"]), col(done["ok"])], names=["comp", "cluster", "level", "parent", "ok"])

    return rows.unionByName(nodes).groupBy(F.lit(0).alias("all")).applyInArrow(kernel, "comp bigint, cluster bigint, level bigint, parent bigint, ok bigint")


_EVENT = ["comp", "up", "cluster", "level"]
_CLUSTER = ["cluster", "parent", "ok"]


def _level(edges: DataFrame, comps: DataFrame, l: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One level by joins: (edges, comps, events (comp, up, cluster, level), clusters closed (cluster, parent, ok))."""
    labels = components(edges.where(F.col("level") <= l))
    old = labels.withColumnRenamed("node", "comp").join(comps, "comp", "left").na.fill({"mass": 1, "cluster": 0, "stability": 0.0, "below": 0.0, "since": 0})
    old = materialize(old.withColumn("now", F.col("stability") + F.col("mass") * (l - F.col("since"))), "joining")
    big = F.col("cluster") != 0
    new = old.groupBy("component").agg(F.sum("mass").alias("mass"), F.count_if(big).alias("n"), F.max(F.when(big, F.struct("cluster", "now", "below"))).alias("one"), F.sum(F.when(big, F.greatest("now", "below"))).alias("lower"))
    one = F.col("n") == 1
    name = F.when(one, F.col("one.cluster")).when(F.col("mass") >= least, F.xxhash64("component", F.lit(l))).otherwise(F.lit(0))
    kept = F.when(one, F.col("one.below")).when(F.col("n") > 1, F.col("lower")).otherwise(F.lit(0.0))
    new = materialize(new.select(F.col("component").alias("comp"), "mass", name.alias("cluster"), F.when(one, F.col("one.now")).otherwise(F.lit(0.0)).alias("stability"), kept.alias("below"), F.lit(l).alias("since"), "n"), "joined")
    to = new.select(F.col("comp").alias("component"), F.col("cluster").alias("into"), "n")
    moved = old.join(to, "component")
    events = moved.where((F.col("cluster") == 0) & ((F.col("into") != 0) | (F.col("comp") != F.col("component"))))
    events = events.select("comp", F.when(F.col("into") == 0, F.col("component")).alias("up"), F.nullif("into", F.lit(0)).alias("cluster"), F.lit(l).cast("long").alias("level"))
    closed = moved.where((F.col("cluster") != 0) & (F.col("n") > 1)).select("cluster", F.col("into").alias("parent"), (F.col("now") >= F.col("below")).cast("long").alias("ok"))
    comps = materialize(comps.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti").unionByName(new.drop("n")), "comps")
    by = lambda df, c: df.join(labels.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    rest = by(by(edges.where(F.col("level") > l), "a"), "b").where("a <> b")
    rest = rest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("level").alias("level"))
    return materialize(rest, "edges"), comps, materialize(events, "events"), materialize(closed, "closed")


def _followed(df: DataFrame, key: str, up: str, take: list[str], upper: bool) -> DataFrame:
    """Pointers (key, up) followed to their ends by doubling; take: columns got from above, either the uppermost or the nearest value."""
    while not df.where(F.col(up).isNotNull()).isEmpty():
        above = df.select(F.col(key).alias(up), F.col(up).alias("next"), *[F.col(c).alias(f"{c} above") for c in take])
        both = [(f"{c} above", c) if upper else (c, f"{c} above") for c in take]
        df = materialize(df.join(above, up, "left").select(key, F.col("next").alias(up), *[F.coalesce(F.col(x), F.col(y)).alias(c) for c, (x, y) in zip(take, both)]), "followed")
    return df


def condensed(edges: DataFrame, least: int, at_once: int = AT_ONCE) -> DataFrame:
    """(node, theme, level) of the nodes of edges (a, b, level) that a chosen cluster holds, with the level they joined it at."""
    spark = edges.sparkSession
    comps = spark.createDataFrame([], "comp bigint, mass bigint, cluster bigint, stability double, below double, since int")  # those not yet joined to any have mass 1
    events, closed = [], []
    while True:
        n, l = edges.agg(F.count(F.lit(1)), F.min("level")).head()
        if n <= at_once:
            break
        edges, comps, went, done = _level(edges, comps, l, least)
        events.append(went)
        closed.append(done)
    rest = materialize(_rest(edges, comps, least), "hierarchy")
    went = rest.where("comp is not null").select("comp", F.lit(None).cast("bigint").alias("up"), "cluster", "level")
    clusters = rest.where("comp is null").select("cluster", F.nullif("parent", F.lit(0)).alias("parent"), F.when(F.col("ok") == 1, F.col("cluster")).alias("theme"))
    for e, c in zip(events, closed):
        went = went.unionByName(e)
        clusters = clusters.unionByName(c.select("cluster", "parent", F.when(F.col("ok") == 1, F.col("cluster")).alias("theme")))
    went = _followed(went, "comp", "up", ["cluster", "level"], False) if events else went
    chosen = _followed(clusters, "cluster", "parent", ["theme"], True).where("theme is not null").select("cluster", "theme")
    return went.join(chosen, "cluster").select(F.col("comp").alias("node"), "theme", "level")
