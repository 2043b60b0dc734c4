"""Problem 10: passages that occur verbatim in more than one text, by sliding spans of sentences.

Every run of consecutive sentences that is the shortest one of at least RUN characters from its start is a span; spans are hashed
and joined globally. Where a passage of the least length holds no whole span (in long sentences, code, tables), the piece of
GRAM characters with the least hash in it stands in for one, so every passage of that length has an anchor, chosen by its own
characters only: two texts that share the passage share the anchor. Around anchors that more than one text has, passages of exactly
the least length are hashed and compared under the anchor's own hash, so a match is one of 128 bits. First those that begin or end
with the anchor are tried, and only texts not yet settled by these have all passages through the anchor tried.

No group of texts is ever paired: each step is an aggregate of hashes (least and greatest text), however many texts share one.

Defined results: null texts and those shorter than the least length share nothing; passages repeated within one text only don't
count; rows with the same key are one text's; lengths are in code points; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.llm.bands import mix64
from notemill.session import materialize

LEAST = 200  #: characters of a passage
RUN = 64  #: characters that a run of sentences has at least
GRAM = 64  #: characters of a piece that stands in for a span
SLICE = 1 << 21  #: characters hashed at once
ENDS = "\n.!?;。！？；"  # fixed value: what ends a sentence

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of an array of code points, from prefix sums modulo 2^64."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]), dtype=np.uint64)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _P)]), dtype=np.uint64)[:n]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) + np.uint64(77)) * power, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(v)
    if n < width:
        return v[:0]
    pad = np.concatenate([v, np.full(-n % width, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(points: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[Rolling, np.ndarray, np.ndarray]:
    """Start and end of the anchors of texts that lie one after the other in points; bounds has where each begins, and the end."""
    n = len(points)
    roll = Rolling(points)
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end_of = bounds[1:][which]
    ends = np.isin(points, np.frombuffer(ENDS.encode("utf-32-le"), np.uint32))
    cut = np.flatnonzero(ends[:-1] & ~ends[1:] & (which[:-1] == which[1:])) + 1
    reach = np.searchsorted(cut, cut + RUN)
    ok = reach < len(cut)
    start, stop = cut[ok], cut[reach[ok]]
    ok = (which[start] == which[stop - 1]) & (stop - start <= least - 2)
    start, stop = start[ok], stop[ok]
    # passages [i, i + least) with a whole span inside, and the characters beside it that make its ends sentence ends
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, np.maximum(stop + 1 - least, 0), 1)
    np.add.at(mark, start, -1)
    covered = np.cumsum(mark)[:n] > 0
    bare = np.flatnonzero(~covered & (np.arange(n) + least <= end_of))
    if len(bare):
        m = n - GRAM + 1
        at = np.arange(m)
        bits = np.uint64(max(1, int(n).bit_length()))
        v = ((roll.of(at, at + GRAM) >> bits) << bits) | at.astype(np.uint64)
        low = sliding_min(v, least - GRAM + 1)
        pick = np.unique((low[bare] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
        start, stop = np.concatenate([start, pick]), np.concatenate([stop, pick + GRAM])
    return roll, start, stop


def _slices(b: pa.RecordBatch, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, code points, bounds and offsets of the texts of a batch that are long enough, about SLICE characters at a time.

    A text beyond SLICE comes in stretches that overlap by more than an anchor and the passages through it; the offset is where in
    its text a stretch begins."""
    rows: list[int] = []
    offsets: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for i, t in enumerate(b.column("text").to_pylist()):
        if t is not None and len(t) >= least:
            points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            lap = 3 * least
            for s in range(0, max(1, len(points) - lap), max(1, SLICE - lap)):
                rows.append(i)
                offsets.append(s)
                texts.append(points[s : s + SLICE])
                size += len(texts[-1])
                if size >= SLICE:
                    yield np.array(rows), np.concatenate(texts), np.cumsum([0, *map(len, texts)]), np.array(offsets)
                    rows, offsets, texts, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.concatenate(texts), np.cumsum([0, *map(len, texts)]), np.array(offsets)


def text_anchors(df: DataFrame, kind: str, least: int) -> DataFrame:
    """(hash, key, pos, len, after, before): a row for each anchor; after and before hash the passages that begin and end with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, points, bounds, offsets in _slices(b, least):
                roll, start, stop = anchors(points, bounds, least)
                text = np.searchsorted(bounds, start, side="right") - 1
                lo, hi = bounds[text], bounds[text + 1]
                right, left = start + least <= hi, stop - least >= lo
                after = roll.of(start, np.where(right, start + least, start)).view(np.int64)
                before = roll.of(np.where(left, stop - least, stop), stop).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(roll.of(start, stop).view(np.int64)), b.column("key").take(pa.array(rows[text])), pa.array((start - lo + offsets[text]).astype(np.int32)), pa.array((stop - start).astype(np.int32)), pa.array(after, mask=~right), pa.array(before, mask=~left)],
                    names=["hash", "key", "pos", "len", "after", "before"],
                )

    return df.mapInArrow(run, f"hash bigint, key {kind}, pos int, len int, after bigint, before bigint")


def passages(df: DataFrame, kind: str, least: int) -> DataFrame:
    """(hash, key, passage, pos): for texts (key, text, found: anchors as structs hash, pos, len) all passages through the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("found").to_pylist()
            for rows, points, bounds, offsets in _slices(b, least):
                roll = Rolling(points)
                names, keys, first = [], [], []
                for j, i in enumerate(rows):
                    lo, hi = int(bounds[j]), int(bounds[j + 1])
                    for f in found[i]:
                        at = lo + f["pos"] - int(offsets[j])
                        a = np.arange(max(lo, at + f["len"] - least), min(at, hi - least) + 1)
                        first.append(a)
                        names.append(np.full(len(a), f["hash"], np.int64))
                        keys.append(np.full(len(a), i, np.int64))
                if first:
                    a, k = np.concatenate(first), np.concatenate(keys)
                    j = np.searchsorted(bounds, a, side="right") - 1
                    pos = a - bounds[j] + offsets[j]
                    if not len(a):
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), b.column("key").take(pa.array(k)), pa.array(roll.of(a, a + least).view(np.int64)), pa.array(pos.astype(np.int32))], names=["hash", "key", "passage", "pos"])

    return df.mapInArrow(run, f"hash bigint, key {kind}, passage bigint, pos int")


def _several(df: DataFrame, *by: str | Column) -> DataFrame:
    """The values of by that more than one key has."""
    return df.groupBy(*by).agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first <> last").drop("last")


def shared_anchors(df: DataFrame, key: str, text: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The texts (key, text), and those of their anchors that more than one text has."""
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = materialize(text_anchors(texts, texts.schema["key"].dataType.simpleString(), least), "anchors")
    shared = found.join(_several(found, "hash").select("hash"), "hash", "left_semi")
    # an anchor where stretches of a long text overlap comes from each of them
    once = shared.groupBy("hash", "key", "pos", "len").agg(F.max("after").alias("after"), F.max("before").alias("before"))
    return texts, materialize(once, "shared")


def sharing(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key): the texts that share at least one passage of least characters with another one."""
    texts, found = shared_anchors(df, key, text, least)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("passage")) for i, c in enumerate(("after", "before"))])
    tried = found.select("hash", "key", F.explode(sides).alias("x")).select("hash", "key", "x.side", "x.passage").where("passage is not null")
    settled = materialize(tried.join(_several(tried, "hash", "side", "passage"), ["hash", "side", "passage"], "left_semi").select("key").distinct(), "settled")
    open_ = found.join(settled, "key", "left_anti").select("hash").distinct()
    left = found.join(open_, "hash", "left_semi").groupBy("key").agg(F.collect_list(F.struct("hash", "pos", "len")).alias("found"))
    left = materialize(left, "open")
    some = passages(texts.join(left, "key"), texts.schema["key"].dataType.simpleString(), least).select("hash", "key", "passage").distinct()
    some = materialize(some, "passages")
    more = some.join(_several(some, "hash", "passage"), ["hash", "passage"], "left_semi").select("key")
    return settled.unionByName(more).distinct().select(F.col("key").alias(key))


def shared_parts(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, start, end, later): stretches of texts that other texts have too, together all of what is shared; later says that a
    lesser key has the stretch, so this is not its first place.

    Where the passages that begin and end with an anchor are shared alike, they cover all passages through it, and these are not
    tried, unless the anchor has another place where it is otherwise."""
    texts, found = shared_anchors(df, key, text, least)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("passage")) for i, c in enumerate(("after", "before"))])
    tried = found.select("hash", "key", "pos", "len", F.explode(sides).alias("x")).select("hash", "key", "pos", "len", "x.side", "x.passage")
    several = _several(tried.where("passage is not null"), "hash", "side", "passage")
    seen = materialize(tried.join(several, ["hash", "side", "passage"], "left").withColumn("later", F.col("key") > F.col("first")), "sides")
    start = F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("pos") + F.col("len") - least)
    ends = seen.where("first is not null").select("key", start.alias("start"), (start + least).alias("end"), "later")
    alike = seen.groupBy("hash", "key", "pos").agg(F.count("first").alias("n"), F.min("later").alias("x"), F.max("later").alias("y")).where("n < 2 or x <> y").select("hash").distinct()
    rest = materialize(found.join(alike, "hash", "left_semi").groupBy("key").agg(F.collect_list(F.struct("hash", "pos", "len")).alias("found")), "open")
    some = materialize(passages(texts.join(rest, "key"), texts.schema["key"].dataType.simpleString(), least), "passages")
    through = some.join(_several(some, "hash", "passage"), ["hash", "passage"])
    through = through.select("key", F.col("pos").alias("start"), (F.col("pos") + least).alias("end"), (F.col("key") > F.col("first")).alias("later"))
    return ends.unionByName(through).withColumnRenamed("key", key)


def merged(parts: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the parts of each text as stretches that don't touch."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1)), 1).otherwise(0)
    run = F.sum("new").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    # of parts with one start only the longest counts: fewer rows to sort
    longest = parts.groupBy(key, "start").agg(F.max("end").alias("end"))
    return longest.withColumn("new", new).withColumn("run", run).groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def shared_report(df: DataFrame, parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chars, shared_chars, share) of every text."""
    got = merged(parts, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
    size = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("chars"))
    out = size.join(got, key, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", F.round(F.col("shared_chars") / F.greatest("chars", F.lit(1)), 6))


def keep_first(df: DataFrame, parts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, removed_chars): each text without the sentences that lie in a stretch an earlier text has."""
    gone = merged(parts.where("later"), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(gone.withColumnRenamed(key, "key"), "key", "left")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for t, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                out = t
                if t and gone:
                    ends = [i + 1 for i, c in enumerate(t) if c in ENDS and (i + 1 == len(t) or t[i + 1] not in ENDS)]
                    bounds = sorted({0, *ends, len(t)})
                    held = iter(gone)
                    g = next(held)
                    pieces = []
                    for s, e in zip(bounds, bounds[1:]):
                        while g is not None and g["end"] < e:
                            g = next(held, None)
                        if g is None or not (g["start"] <= s and e <= g["end"]):
                            pieces.append(t[s:e])
                    out = "".join(pieces)
                kept.append(out)
                removed.append(len(t) - len(out) if t else 0)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(kept, pa.string()), pa.array(removed, pa.int32())], names=[key, "text", "removed_chars"])

    return rows.mapInArrow(cut, f"`{key}` {kind}, text string, removed_chars int")
