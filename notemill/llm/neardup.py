"""Problem 5: near-duplicate texts with small edits, by min-max hashing.

A text's set is its distinct substrings of `gram` characters after lower-casing and removal of white space. Equal texts become one
class, carried by its least key. Each class gets one min-max signature; candidates share a band and have sketches close enough for
the threshold; the exact Jaccard similarity of the sets decides. All 32 bands of 4 values are used: a pair at exactly 0.70 shares none
with probability 0.00015, one at 0.80 with 0.00000005.

Defined results: null texts and texts shorter than min_chars have no class; rows with the same key and text count once; a key given
with several texts is in the class of each; an empty table gives an empty result; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.llm.bands import band_keys, differing, pack_bits
from notemill.llm.components import components
from notemill.llm.minmax import gram_hashes, minmax, permutations
from notemill.session import materialize

GRAM, THRESHOLD, MIN_CHARS = 5, 0.70, 150
PERMUTATIONS = 64  #: each gives two values of the signature
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS  #: all that the signature has
SPACES = " \t\r\n 　"  # fixed value: the characters removed before comparison


def compact(text: Column) -> Column:
    return F.translate(F.lower(text), SPACES, "")


def classes(df: DataFrame, key: str, text: str, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rep, norm): each distinct text once; and (rep, key): which class each key belongs to."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), compact(F.col(text)).alias("norm")).where(F.length("norm") >= min_chars)
    rows = rows.withColumn("h", F.unhex(F.md5("norm")))
    texts = materialize(rows.groupBy("h").agg(F.min("key").alias("rep"), F.first("norm").alias("norm")), "texts")
    members = rows.select("h", "key").distinct().join(texts.select("h", "rep"), "h").select("rep", "key")
    return texts.select("rep", "norm"), members


def signatures(texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(band, rep, s1, s2): a row for each band of each text."""
    kind = texts.schema["rep"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = permutations(PERMUTATIONS)
        interleave = np.arange(2 * PERMUTATIONS).reshape(2, -1).T.ravel()  # a permutation's minimum and maximum side by side
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                sig = np.array([minmax(gram_hashes(x, gram), perms) for x in part.column("norm").to_pylist()], np.uint32).reshape(-1, 2 * PERMUTATIONS)
                s1, s2 = pack_bits(sig & np.uint32(1))
                keys = band_keys(sig[:, interleave], ROWS)
                rep = part.column("rep").take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), rep, pa.array(np.repeat(s1, BANDS)), pa.array(np.repeat(s2, BANDS))], names=["band", "rep", "s1", "s2"])

    return texts.mapInArrow(sign, f"band bigint, rep {kind}, s1 bigint, s2 bigint")


def most_differing(threshold: float) -> int:
    """Bits of 128 that a pair at the threshold differs in, and five standard deviations more."""
    p = (1 - threshold) / 2
    return int(np.ceil(128 * p + 5 * np.sqrt(128 * p * (1 - p))))


def jaccard(pairs: DataFrame, a: str, b: str, gram: int, threshold: float) -> DataFrame:
    """Pairs (rep_a, rep_b, and the texts in columns a and b) whose exact similarity reaches the threshold, with it."""
    kind = pairs.schema["rep_a"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, frozenset()
        grams = lambda t: {t[i : i + gram] for i in range(max(1, len(t) - gram + 1))}
        for batch in batches:
            keep, score = [], []
            for i, (x, y) in enumerate(zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())):
                if x != last:
                    last, left = x, grams(x)
                right = grams(y)
                both = len(left & right)
                j = both / (len(left) + len(right) - both)
                if j >= threshold:
                    keep.append(i)
                    score.append(j)
            rows = batch.select(["rep_a", "rep_b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    return pairs.select("rep_a", "rep_b", a, b).mapInArrow(compare, f"rep_a {kind}, rep_b {kind}, similarity double")


def similar_classes(texts: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(rep_a, rep_b, similarity), rep_a < rep_b: the pairs of classes that are similar."""
    rows = signatures(texts, gram)
    near = (F.col("a.rep") < F.col("b.rep")) & (differing("a", "b") <= most_differing(threshold))
    candidates = rows.alias("a").join(rows.alias("b"), (F.col("a.band") == F.col("b.band")) & near)
    candidates = candidates.select(F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct()
    candidates = materialize(candidates, "candidates")
    pairs = candidates.join(texts.select(F.col("rep").alias("rep_b"), F.col("norm").alias("norm_b")), "rep_b")
    pairs = pairs.join(texts.select(F.col("rep").alias("rep_a"), F.col("norm").alias("norm_a")), "rep_a")
    return jaccard(pairs, "norm_a", "norm_b", gram, threshold)


def near_duplicates(df: DataFrame, key: str, text: str, gram: int = GRAM, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, (rep_a, rep_b, similarity), and membership of every key, (rep, key)."""
    texts, members = classes(df, key, text, min_chars)
    return similar_classes(texts, gram, threshold), members


def near_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: all pairs of different keys whose texts are equal or similar."""
    links, members = near_duplicates(df, key, text, **options)
    members = materialize(members, "members")
    left, right = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("key").alias("y"))
    across = links.join(left, "rep_a").join(right, "rep_b").where("x <> y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    same = members.join(several, "rep")
    equal = same.select("rep", F.col("key").alias("x")).join(same.select("rep", F.col("key").alias("y")), "rep").where("x < y")
    equal = equal.select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(equal).groupBy(f"{key}_a", f"{key}_b").agg(F.max("similarity").alias("similarity"))


def groups(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, class_id, group_id, group_size, links): for every key with a class, its class (of equal texts), its group (classes linked
    directly or through others), the keys in it, and the different texts its own is similar to."""
    members = materialize(members, "members")
    found = components(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep")))
    n = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    per = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(n, "rep", "left")
    per = per.select(F.col("key").alias(key), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    size = per.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return per.join(size, "group_id").select(key, "class_id", "group_id", "group_size", "links")


def vector_evidence(links: DataFrame, chunks: DataFrame, notes: DataFrame, key: str = "chunk_id", dim: int = 64) -> DataFrame:
    """links with the cosines of the chunks' vectors and of their notes' vectors; null where one has no usable vector.

    chunks: (key, note, vec); notes: (path, vec)."""
    one = chunks.groupBy(F.col(key).alias("k")).agg(F.max(F.struct("note", "vec")).alias("c")).select("k", "c.note", "c.vec")
    side = lambda s: one.select(F.col("k").alias(f"rep_{s}"), F.col("note").alias(f"note_{s}"), F.col("vec").alias(f"vec_{s}"))
    owner = lambda s: notes.select(F.col("path").alias(f"note_{s}"), F.col("vec").alias(f"whole_{s}"))
    rows = links.join(side("a"), "rep_a").join(side("b"), "rep_b").join(owner("a"), "note_a", "left").join(owner("b"), "note_b", "left")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    def cosine(x: str, y: str) -> Column:
        a, b = F.col(x), F.col(y)
        n = F.sqrt(dot(a, a) * dot(b, b))
        return F.when((F.size(a) == dim) & (F.size(b) == dim) & (n > 0), F.round(dot(a, b) / n, 5))

    return rows.select("rep_a", "rep_b", "similarity", cosine("vec_a", "vec_b").alias("chunk_cosine"), cosine("whole_a", "whole_b").alias("note_cosine"))
