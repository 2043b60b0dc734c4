"""Duplicates: exact by hash, near by note vectors, contained by chunks, with evidence.

notes: (path, text_hash, u); chunks: (note, idx, u), vectors packed as float64 units (functions.vectors.with_unit). Only notes with a
usable vector and chunks of such notes take part. A pair is given once, the lesser path first, and named from its point of view."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.vectors import matrix
from notemill.operators.vector_join import PLACES, cosines, pairs_above, pairs_between
from notemill.session import materialize

KINDS = ["exact", "duplicate", "contained_in", "contains", "near_duplicate"]  # fixed value: kinds in their order of report
SIDE = 1024  #: chunks of one note compared at once for evidence


def exact_members(notes: DataFrame) -> DataFrame:
    """(text_hash, path, first): one row per note whose text another note has too, and the group's first path."""
    h = F.lower("text_hash").alias("text_hash")
    several = notes.where("text_hash is not null").groupBy(h).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).where("n > 1").drop("n")
    return notes.select("path", h).join(several, "text_hash")


def exact_matches(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc, target): for docs (doc, file_hash, text_hash, path) the notes (path, hash, text_hash) with the same file or text."""
    hit = lambda a, b: docs.select("doc", F.col("path").alias("own"), F.lower(a).alias("h")).join(notes.select(F.col("path").alias("target"), F.lower(b).alias("h")), "h")
    both = hit("file_hash", "hash").unionByName(hit("text_hash", "text_hash"))
    return both.where(~F.col("own").eqNullSafe(F.col("target"))).select("doc", "target").distinct()


def kind_of(note_sim: Column, a_in_b: Column, b_in_a: Column, t: dict[str, float]) -> Column:
    """The relation of a pair, by the first rule that holds; null if none does."""
    a, b = a_in_b >= t["contained_ratio"], b_in_a >= t["contained_ratio"]
    return F.when(note_sim >= t["dup"], "duplicate").when(a & ~b, "contained_in").when(b & ~a, "contains").when(a & b, "duplicate").when(note_sim >= t["near_dup"], "near_duplicate")


def chunk_links(chunks: DataFrame, least: float, dim: int) -> DataFrame:
    """(note_a, i, note_b, j, cosine) of pairs of chunks with at least that cosine, within and across notes."""
    rows = chunks.select(F.struct("note", "idx").alias("key"), "u")
    found = pairs_above(rows, least, dim)
    return found.select(F.col("a.note").alias("note_a"), F.col("a.idx").alias("i"), F.col("b.note").alias("note_b"), F.col("b.idx").alias("j"), "cosine")


def chunk_links_between(docs: DataFrame, chunks: DataFrame, least: float, dim: int) -> DataFrame:
    """(doc, i, note, j, cosine): the same of chunks (note, idx, u) of documents and of an index; neither is held against itself."""
    rows = lambda df: df.select(F.struct("note", "idx").alias("key"), "u")
    found = pairs_between(rows(docs), rows(chunks), least, dim)
    return found.select(F.col("left.note").alias("doc"), F.col("left.idx").alias("i"), F.col("right.note").alias("note"), F.col("right.idx").alias("j"), "cosine")


def _related(near: DataFrame, across: DataFrame, a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], t: dict[str, float], dim: int) -> DataFrame:
    """(a, b, kind, score, a_in_b, b_in_a) of the pairs near (a, b) and those with a matching chunk, across (a, i, b, j). a and b: the
    notes (path, text_hash, u) and chunks (note) of either side."""
    matched = across.groupBy("a", "b").agg(F.countDistinct("i").alias("n_i"), F.countDistinct("j").alias("n_j"))
    pairs = near.select("a", "b").distinct().join(matched, ["a", "b"], "full_outer")

    def side(s: str, u: str, notes: DataFrame, chunks: DataFrame) -> DataFrame:
        count = chunks.groupBy(F.col("note").alias(s)).agg(F.count(F.lit(1)).alias(f"n_{s}"))
        return notes.select(F.col("path").alias(s), F.lower("text_hash").alias(f"h_{s}"), F.col("u").alias(u)).join(count, s, "left")

    full = pairs.join(side("a", "u", *a), "a").join(side("b", "v", *b), "b").where("n_a is not null and not (h_a <=> h_b and h_a is not null)")
    scored = cosines(full, dim, "a", "b", "n_i", "n_j", "n_a", "n_b")
    ratio = lambda n, of: F.coalesce(F.col(n) / F.col(of), F.lit(0.0))
    scored = scored.select("a", "b", "cosine", ratio("n_i", "n_a").alias("x"), ratio("n_j", "n_b").alias("y"))
    out = scored.withColumn("kind", kind_of(F.col("cosine"), F.col("x"), F.col("y"), t)).where("kind is not null")
    return out.select("a", "b", "kind", F.round("cosine", 4).alias("score"), F.round("x", 4).alias("a_in_b"), F.round("y", 4).alias("b_in_a"))


def related_notes(notes: DataFrame, chunks: DataFrame, links: DataFrame, t: dict[str, float], dim: int = 64) -> DataFrame:
    """(a, b, kind, score, a_in_b, b_in_a), a < b. links: chunk_links at chunk_match.

    Candidates are the pairs alike as notes and those with a matching chunk; all others have neither ratio nor score to report."""
    near = pairs_above(notes.select(F.col("path").alias("key"), "u"), t["near_dup"], dim)
    flip = F.col("note_a") < F.col("note_b")
    across = links.where("note_a <> note_b").select(F.least("note_a", "note_b").alias("a"), F.greatest("note_a", "note_b").alias("b"), F.when(flip, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(flip, F.col("j")).otherwise(F.col("i")).alias("j"))
    return _related(near, across, (notes, chunks), (notes, chunks), t, dim)


def related_to(docs: DataFrame, doc_chunks: DataFrame, notes: DataFrame, chunks: DataFrame, links: DataFrame, t: dict[str, float], dim: int = 64) -> DataFrame:
    """(a, b, kind, score, a_in_b, b_in_a) of documents a against notes b. links: chunk_links_between at chunk_match."""
    rows = lambda df: df.select(F.col("path").alias("key"), "u")
    near = pairs_between(rows(docs), rows(notes), t["near_dup"], dim).select(F.col("left").alias("a"), F.col("right").alias("b"))
    across = links.select(F.col("doc").alias("a"), F.col("note").alias("b"), "i", "j")
    return _related(near, across, (docs, doc_chunks), (notes, chunks), t, dim)


def evidence(pairs: DataFrame, chunks: DataFrame, dim: int = 64, most: int = 3) -> DataFrame:
    """(a, b, rank, i, j, score): for pairs (a, b) of notes, of the 3 x most best cells the first of each chunk of a, at most `most`.

    Notes are compared in blocks of SIDE chunks, each giving its best cells, so a note's size doesn't matter."""
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    block = F.floor(F.col("idx") / SIDE).cast("int")
    blocks = lambda s: chunks.select(F.col("note").alias(s), block.alias(f"k{s}")).distinct()
    left = pairs.join(chunks.select(F.col("note").alias("a"), F.col("idx").alias("i"), "u", block.alias("ka")), "a").join(blocks("b"), "b")
    right = pairs.join(chunks.select(F.col("note").alias("b"), F.col("idx").alias("j"), "u", block.alias("kb")), "b").join(blocks("a"), "a")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same chunks
    by = ["a", "b", "ka", "kb"]
    cells = 3 * most

    def kernel(key: tuple, l: pa.Table, r: pa.Table) -> pa.Table:
        x, y = (matrix(t.column("u"), np.dtype(np.float64), dim) for t in (l, r))
        i, j = np.asarray(l.column("i")), np.asarray(r.column("j"))
        s = np.round(x @ y.T, PLACES) if len(x) and len(y) else np.zeros((len(x), len(y)))
        p, q = np.nonzero(s >= np.partition(s.ravel(), max(0, s.size - cells))[max(0, s.size - cells)]) if s.size else (np.zeros(0, int),) * 2
        o = np.lexsort((j[q], i[p], -s[p, q]))[:cells]
        p, q = p[o], q[o]
        a, b = (k.as_py() if hasattr(k, "as_py") else k for k in key[:2])
        return pa.table({"a": pa.array([a] * len(p), pa.string()), "b": pa.array([b] * len(p), pa.string()), "i": pa.array(i[p], pa.int32()), "j": pa.array(j[q], pa.int32()), "score": pa.array(s[p, q], pa.float64())})

    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(kernel, "a string, b string, i int, j int, score double")
    order = [F.col("score").desc(), "i", "j"]
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).where(F.col("r") <= cells)
    best = best.withColumn("f", F.row_number().over(Window.partitionBy("a", "b", "i").orderBy("r"))).where("f = 1")
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("r"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most).select("a", "b", "rank", "i", "j", F.round("score", 4).alias("score"))


def redundant_inside(links: DataFrame) -> DataFrame:
    """(note, chunk, duplicate_of_chunk, score): pairs of chunks of one note that match."""
    same = links.where("note_a = note_b")
    return same.select(F.col("note_a").alias("note"), F.least("i", "j").alias("chunk"), F.greatest("i", "j").alias("duplicate_of_chunk"), F.round("cosine", 4).alias("score"))


def redundant_across(links: DataFrame) -> DataFrame:
    """(note, chunk, score, found_in, found_chunk): for each chunk with a match in another note the best one."""
    other = links.where("note_a <> note_b")
    both = other.select(F.col("note_a").alias("note"), F.col("i").alias("chunk"), "cosine", F.col("note_b").alias("found_in"), F.col("j").alias("found_chunk")).unionByName(
        other.select(F.col("note_b").alias("note"), F.col("j").alias("chunk"), "cosine", F.col("note_a").alias("found_in"), F.col("i").alias("found_chunk"))
    )
    # an aggregate, not a window: the best of a chunk's matches is found before the shuffle
    best = both.groupBy("note", "chunk").agg(F.min(F.struct((-F.col("cosine")).alias("s"), "found_in", "found_chunk")).alias("m"))
    return best.select("note", "chunk", F.round(-F.col("m.s"), 4).alias("score"), "m.found_in", "m.found_chunk")


def redundant_ratio(chunks: DataFrame, inside: DataFrame, across: DataFrame) -> DataFrame:
    """(note, chunks, internal, cross_vault, redundant_ratio) for notes with chunks (note, idx, tokens): the share of their tokens
    in chunks that occur again later in the note, or in another note."""
    tokens = F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0))
    hit = inside.select("note", F.col("chunk").alias("idx")).unionByName(across.select("note", F.col("chunk").alias("idx"))).distinct().withColumn("hit", F.lit(1))
    n = inside.groupBy("note").agg(F.count(F.lit(1)).alias("internal"))
    m = across.groupBy("note").agg(F.count(F.lit(1)).alias("cross_vault"))
    per = chunks.join(hit, ["note", "idx"], "left").groupBy("note").agg(F.count(F.lit(1)).alias("chunks"), F.sum(tokens).alias("t"), F.sum(F.when(F.col("hit") == 1, tokens).otherwise(0)).alias("r"))
    out = per.join(n, "note", "left").join(m, "note", "left")
    return out.select("note", "chunks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("internal", "cross_vault")], F.round(F.col("r") / F.greatest("t", F.lit(1)), 4).alias("redundant_ratio"))
