"""Vectors of groups: note vectors from chunks, folder centroids, classification, tags, profiles.

Sums of vectors are added up in batches before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.embedding import ngram_vectors
from notemill.functions.vectors import unit_rows, with_unit
from notemill.operators.vector_join import cosines, top_k
from notemill.session import materialize

FEW = 3  #: fewer notes (or users of a tag) than this make no centroid of their own
SOURCE = "\x01"  #: between a tag and what its vector comes from


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def usable(v: Column, dim: int) -> Column:
    n = norm(v.cast("array<double>"))
    return (F.size(v) == dim) & (n > 0) & (n < float("inf"))


def unit(v: Column) -> Column:
    """A vector at unit length; the zero vector stays as it is."""
    d = v.cast("array<double>")
    n = norm(d)
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def vector_sum(df: DataFrame, by: str, vec: str, dim: int, weight: str | None = None) -> DataFrame:
    """(by, total, n): the sum of the usable vectors of each group at unit length, times their weights, and how many there are.

    Rows are added up batch by batch before they are moved."""
    kind = df.schema[by].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit_rows(b.column("v"), dim)
            if not len(rows):
                continue
            coded = b.column("k").take(pa.array(rows)).dictionary_encode()
            code = np.asarray(coded.indices.fill_null(-1))
            if weight is not None:
                x = x * np.asarray(b.column("w").take(pa.array(rows)))[:, None]
            order = np.argsort(code, kind="stable")
            at = np.flatnonzero(np.diff(code[order], prepend=-2))
            sums, first = np.add.reduceat(x[order], at, axis=0), code[order][at]
            counts = np.diff(np.append(at, len(code)))
            keys = coded.dictionary.take(pa.array(first, mask=first < 0))
            yield pa.RecordBatch.from_arrays([keys, pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), dim).cast(pa.list_(pa.float64())), pa.array(counts.astype(np.int64))], names=["k", "sums", "n"])

    rows = df.where(F.col(vec).isNotNull()).select(F.col(by).alias("k"), F.col(vec).alias("v"), *([F.col(weight).cast("double").alias("w")] if weight else []))
    part = rows.mapInArrow(add, f"k {kind}, sums array<double>, n bigint")
    return part.groupBy(F.col("k").alias(by)).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("total"), F.sum("n").alias("n"))


def note_vectors(chunks: DataFrame, heads: DataFrame | None = None, dim: int = 64) -> DataFrame:
    """(note, vec): the unit sum of a note's head vector and of its chunks' vectors weighted by tokens, each at unit length first.

    chunks: (note, tokens, vec); heads: (note, vec), or none. A note without chunks has its head only."""
    weighed = chunks.select("note", "vec", F.greatest(F.coalesce("tokens", F.lit(1)), F.lit(1)).alias("w"))
    body = vector_sum(weighed, "note", "vec", dim, "w").select("note", unit(F.col("total")).alias("body"))
    if heads is None:
        return body.select("note", F.col("body").alias("vec"))
    both = body.join(heads.select("note", unit(F.col("vec")).alias("head")), "note", "full_outer")
    return both.select("note", unit(plus(F.col("body"), F.col("head"))).alias("vec"))


def folder_centroids(notes: DataFrame, described: DataFrame, skip: list[str], dim: int = 64) -> DataFrame:
    """(folder, n, total, desc, vec): notes (path, folder, vec) by exact folder, without the root and folders below skip.

    A folder with few notes, or only a description, leans on the embedding of its name and description."""
    rows = notes.where((F.col("folder") != "") & ~F.split("folder", "/")[0].isin(skip))
    sums = vector_sum(rows, "folder", "vec", dim)
    described = described.where("folder is not null").groupBy("folder").agg(F.max(F.coalesce("description", F.lit(""))).alias("description"))
    all_ = sums.join(described, "folder", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    name = F.concat(F.replace(F.col("folder"), F.lit("/"), F.lit(" / ")), F.lit(": "), F.coalesce("description", F.lit("")))
    weak = all_.where(F.col("n") < FEW).select("folder", F.regexp_replace(name, r"^[: ]+|(?<![: ])[: ]+$", "").alias("text"))
    weak = ngram_vectors(weak, "folder", "text", dim).select("folder", F.col("vec").alias("desc"))
    out = all_.join(weak, "folder", "left")
    return out.select("folder", "n", "total", "desc", unit(plus(unit(F.col("total")), F.col("desc"))).alias("vec"))


def classify(queries: DataFrame, notes: DataFrame, described: DataFrame, skip: list[str], dim: int = 64, least: float = 0.55, margin: float = 0.03, k: int = 3) -> DataFrame:
    """(query, folder, score, notes, rank, margin, confident, reason) for queries (query, path, vec): the k nearest folders.

    A query that is itself a note of a folder is held against that folder without it."""
    centroids = materialize(folder_centroids(notes, described, skip, dim), "centroids")
    queries = materialize(queries.select("query", "path", "vec"), "queries")
    q = materialize(with_unit(queries.select("query", "vec"), dim=dim, dtype=np.float64), "asked")
    base = materialize(with_unit(centroids.select(F.col("folder").alias("key"), "vec"), dim=dim, dtype=np.float64), "folders")
    found = top_k(q.select("query", "u"), base, k + 1, dim).select("query", F.col("key").alias("folder"), "score").join(centroids.select("folder", "n"), "folder")
    # its own folder, scored without the query: with fewer notes left it may come to lean on the description
    own = queries.select("query", "path", F.col("vec").alias("mine")).join(notes.select("path", "folder"), "path").join(centroids.drop("vec"), "folder")
    own = own.where(usable(F.col("mine"), dim)).withColumn("left", F.col("n") - 1).withColumn("rest", F.zip_with("total", unit(F.col("mine")), lambda x, y: x - y))
    name = F.regexp_replace(F.concat(F.replace(F.col("folder"), F.lit("/"), F.lit(" / ")), F.lit(": "), F.coalesce("description", F.lit(""))), r"^[: ]+|(?<![: ])[: ]+$", "")
    texts = described.where("folder is not null").groupBy("folder").agg(F.max("description").alias("description"))
    alone = own.select("folder").distinct().join(texts, "folder", "left").select("folder", name.alias("text"))
    own = own.drop("desc").join(ngram_vectors(alone, "folder", "text", dim).withColumnRenamed("vec", "desc"), "folder")
    cent = F.when(F.col("left") >= FEW, F.col("rest")).when(F.col("left") > 0, plus(unit(F.col("rest")), F.col("desc"))).otherwise(F.col("desc"))
    listed = described.select("folder").distinct().withColumn("listed", F.lit(True))
    own = own.withColumn("c", cent).join(listed, "folder", "left").withColumn("keep", (F.col("left") > 0) | F.coalesce("listed", F.lit(False)))
    pairs = with_unit(own.select("query", "folder", "left", "keep", "mine", "c"), "mine", "u", dim, np.float64)
    pairs = with_unit(pairs, "c", "v", dim, np.float64)
    again = cosines(pairs, dim, "query", "folder", "left", "keep").select("query", "folder", F.col("cosine").alias("score"), F.col("left").alias("n"), "keep")
    rest = found.join(again.select("query", "folder"), ["query", "folder"], "left_anti").select("query", "folder", "score", "n")
    found = rest.unionByName(again.where("keep").drop("keep"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "folder")
    ranked = found.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where(F.col("rank") <= k)
    gap = F.max(F.when(F.col("rank") == 1, F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)))).over(Window.partitionBy("query"))
    top = F.max(F.when(F.col("rank") == 1, F.round("score", 4))).over(Window.partitionBy("query"))
    out = ranked.withColumn("gap", gap).withColumn("top", top)
    reason = F.when(F.col("top") < least, "low_score").when(F.col("gap") < margin, "ambiguous")
    return out.select("query", "folder", F.round("score", 4).alias("score"), F.col("n").cast("long").alias("notes"), "rank", F.round("gap", 4).alias("margin"), reason.isNull().alias("confident"), reason.alias("reason"))


def parsed_tags(tags_json: Column) -> Column:
    """The tags of a JSON array; of anything else, none."""
    clean = F.filter(F.from_json(tags_json, "array<string>"), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_distinct(clean), F.array().cast("array<string>"))


def tag_usage(notes: DataFrame) -> DataFrame:
    """(tag, users) of notes (path, tags_json)."""
    return notes.select(F.explode(parsed_tags(F.col("tags_json"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("users"))


def tag_candidates(notes: DataFrame, listed: DataFrame | None) -> DataFrame:
    """(tag, description): the tag list as it is, or without one the tags that several notes use."""
    if listed is None:
        return tag_usage(notes).where(F.col("users") >= FEW).select("tag", F.lit("").alias("description"))
    t = F.regexp_replace("tag", "^#+", "")
    return listed.where("tag is not null").groupBy(t.alias("tag")).agg(F.max(F.coalesce("description", F.lit(""))).alias("description"))


def suggest_tags(queries: DataFrame, notes: DataFrame, listed: DataFrame | None, dim: int = 64, k: int = 5, least: float = 0.55) -> DataFrame:
    """(query, tag, score, source, rank) for queries (query, vec[, path]): the k best candidates, those of at least `least`.

    A candidate is held against by its description's embedding and, with several users, by their centroid, whichever is nearer."""
    named = tag_candidates(notes, listed)
    text = F.when(F.col("description") != "", F.concat("tag", F.lit(": "), "description")).otherwise(F.col("tag"))
    by_text = ngram_vectors(named.select("tag", text.alias("text")), "tag", "text", dim)
    used = notes.where("vec is not null").select("path", F.explode(parsed_tags(F.col("tags_json"))).alias("tag"), "vec").join(named.select("tag"), "tag")
    by_use = materialize(vector_sum(used, "tag", "vec", dim).where(F.col("n") >= FEW).select("tag", F.col("total").alias("vec"), "n"), "tag_uses")
    labelled = lambda df, source: df.select(F.concat("tag", F.lit(SOURCE + source)).alias("key"), "vec")
    base = materialize(with_unit(labelled(by_text, "description").unionByName(labelled(by_use, "usage")), dim=dim, dtype=np.float64), "tag_vectors")
    # a query that is itself a note is held against its tags' uses without it
    own = queries.select("query", "path", F.col("vec").alias("mine")).join(used.withColumnRenamed("vec", "v"), "path").where(usable(F.col("v"), dim)).join(by_use.withColumnRenamed("vec", "total"), "tag") if "path" in queries.columns else None
    most = own.groupBy("query").count().agg(F.max("count")).head()[0] or 0 if own is not None else 0
    # a tag has two vectors at most, so its better one is among the first 2k, but for those that are taken out
    found = top_k(materialize(with_unit(queries.select("query", "vec"), dim=dim, dtype=np.float64), "asked"), base, 2 * k + most, dim)
    parts = F.split("key", SOURCE)
    found = found.select("query", parts[0].alias("tag"), parts[1].alias("source"), "score")
    if own is not None:
        own = own.withColumn("rest", F.zip_with("total", unit(F.col("v")), lambda x, y: x - y))
        found = found.join(own.select("query", "tag", F.lit("usage").alias("source")), ["query", "tag", "source"], "left_anti")
        pairs = with_unit(with_unit(own.where(F.col("n") > FEW).select("query", "tag", "mine", "rest"), "mine", "u", dim, np.float64), "rest", "v", dim, np.float64)
        again = cosines(pairs, dim, "query", "tag").select("query", "tag", F.lit("usage").alias("source"), F.col("cosine").alias("score"))
        found = found.select("query", "tag", "source", "score").unionByName(again)
    best = found.groupBy("query", "tag").agg(F.min(F.struct((-F.col("score")).alias("s"), "source")).alias("b"))
    w = Window.partitionBy("query").orderBy(F.col("b.s"), "tag")
    ranked = best.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (-F.col("b.s") >= least))
    return ranked.select("query", "tag", F.round(-F.col("b.s"), 4).alias("score"), F.col("b.source").alias("source"), "rank")


def profiles(labelled: DataFrame, dim: int = 64, least: int = 3, titles: int = 5, tags: int = 5, folders: int = 3) -> DataFrame:
    """(label, size, cohesion, representative, common_tags, folders) of labelled notes (label, path, title, folder, tags_json, vec).

    Groups of fewer than `least` are left out; ties go to the path, or the name, that comes first."""
    sums = vector_sum(labelled, "label", "vec", dim).where(F.col("n") >= least)
    cent = with_unit(sums.select("label", "n", "total"), "total", "v", dim, np.float64)
    near = with_unit(labelled.select("label", "path", "title", "folder", "tags_json", "vec"), dim=dim, dtype=np.float64).join(cent, "label")
    near = cosines(near, dim, "label", "path", "title", "folder", "tags_json", "n")
    first = lambda df, n, name, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("r") <= n).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias(name))
    size = near.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("cosine"), 4).alias("cohesion"))
    title = first(near.withColumn("x", F.coalesce(F.nullif("title", F.lit("")), "path")), titles, "representative", F.col("cosine").desc(), "path")
    tag = first(near.select("label", F.explode(parsed_tags(F.col("tags_json"))).alias("x")).groupBy("label", "x").count(), tags, "common_tags", F.col("count").desc(), "x")
    folder = first(near.select("label", F.when(F.col("folder") == "", "(root)").otherwise(F.col("folder")).alias("x")).groupBy("label", "x").count(), folders, "folders", F.col("count").desc(), "x")
    return size.join(title, "label", "left").join(tag, "label", "left").join(folder, "label", "left")


def similar(queries: DataFrame, notes: DataFrame, chunks: DataFrame, k: int = 10, dim: int = 64) -> DataFrame:
    """(query, path, score, rank, chunk, chunk_score) for queries (query, path, vec): the nearest notes, and of each its nearest chunk.

    The query itself is left out, and so are notes with a negative cosine, after the k best are found."""
    q = materialize(with_unit(queries.select("query", "vec"), dim=dim, dtype=np.float64), "asked")
    base = materialize(with_unit(notes.select(F.col("path").alias("key"), "vec"), dim=dim, dtype=np.float64), "notes")
    found = top_k(q, base, k + 1, dim)
    own = queries.select("query", F.col("path").alias("own"))
    found = found.join(own, "query").where("not (key <=> own)")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    found = found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= 0)).select("query", F.col("key").alias("path"), "score", "rank")
    c = with_unit(chunks.select(F.col("note").alias("path"), F.col("idx").alias("chunk"), "vec"), out="v", dim=dim, dtype=np.float64)
    cells = cosines(found.select("query", "path").join(c, "path").join(q, "query"), dim, "query", "path", "chunk")
    best = cells.groupBy("query", "path").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "chunk")).alias("b"))
    out = found.join(best, ["query", "path"], "left")
    return out.select("query", "path", F.round("score", 4).alias("score"), "rank", F.col("b.chunk").alias("chunk"), F.round(-F.col("b.s"), 4).alias("chunk_score"))
