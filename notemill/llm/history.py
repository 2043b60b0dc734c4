"""Problem 7: each batch checked against everything accepted before, through a persisted index of minwise band keys.

A vector's set is the sides of random hyperplanes it lies on; minwise hashes of that set are cut into bands. The index keeps the
band keys, each with a sketch of the vector, and beside them the text hashes, in files partitioned by a hash of the key, and the vectors likewise. Batches
are taken one after the other: each probes the buckets of its own keys, compares sketches in the join, verifies what is left by exact
cosine, reading the buckets of the candidates' vectors only, and appends the keys of what it accepts, which the next batch probes.
History is never signed again. The history's side of a join stays where it is while the batch is small enough to be broadcast
(counted first); only a larger one is joined by a shuffle.

Every append is a part of its own; a part has a bucket for about BUCKET_KEYS of its keys, so that the longer the history the smaller
the share of it that a batch reads (all of it only once a batch has more keys than there are buckets). FAN parts of one size are
merged into one, so there are few parts and a record is rewritten a logarithmic number of times.

A pair of cosine 0.95 shares a band with probability 0.996, one of 0.97 with 0.9998.

Defined results: null text hashes and the hash of empty text match nothing; unusable vectors (null, other length, not finite, all
zero) are near nothing; an item's repeated rows count once (its earliest arrival; ties: least values); a null batch_no comes last;
an empty batch or empty history is no special case; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.vectors import matrix, with_unit_or_null
from notemill.llm.bands import band_keys, differing, pack_bits
from notemill.session import materialize, new_path

PLANES, ROWS, BANDS, SEED = 256, 6, 16, 11
BUCKET_KEYS = 50_000  #: keys in a bucket, about
MOST_BUCKETS = 4096  #: a bound on the list of buckets that a batch asks for
FAN = 8  #: parts of one size that are merged
SENT = 200_000  #: keys of a batch, of some 40 bytes, that are sent to all executors; more are joined by a shuffle
AT_ONCE = 50_000  #: items of a batch that one task decides in their order, from what was found; a larger batch is decided in rounds
EMPTY_TEXT = "da39a3ee5e6b4b0d3255bfef95601890afd80709"  # fixed value: SHA-1 of no bytes
_SCHEMAS = {"vectors": "ref bigint, u binary", "keys": "band bigint, ref bigint, s1 bigint, s2 bigint, h string"}  # a text hash has a key of its own
_BY = {"vectors": "ref", "keys": "band"}


def sign_minhash(x: np.ndarray, planes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs, and minwise hashes of the set {(plane, sign)}: the first member of the set in each order of all 2 x PLANES."""
    signs = (x @ planes) > 0
    out = np.full((len(x), len(order)), -1, np.int64)
    for token in order.T:
        open_ = (out < 0) & (signs[:, token >> 1] == (token & 1).astype(bool))
        out = np.where(open_, token, out)
        if (out >= 0).all():
            break
    return signs, out


def _functions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    planes = r.standard_normal((dim, PLANES)).astype(np.float32)
    return planes, np.array([r.permutation(2 * PLANES) for _ in range(ROWS * BANDS)])


def vector_keys(vectors: DataFrame, dim: int) -> DataFrame:
    """(band, ref, s1, s2, n): a row for each band of each vector of (ref, u, n)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, order = _functions(dim)
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                signs, sig = sign_minhash(matrix(part.column("u"), np.dtype(np.float32), dim), planes, order)
                s1, s2 = pack_bits(signs)
                keys = band_keys(sig, ROWS)
                values = (keys.ravel(), *(np.repeat(np.asarray(v), BANDS) for v in (part.column("ref"), s1, s2, part.column("n"))))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["band", "ref", "s1", "s2", "n"])

    return vectors.select("ref", "u", "n").mapInArrow(sign, "band bigint, ref bigint, s1 bigint, s2 bigint, n int")


def most_differing(cosine: float) -> int:
    """Signs of 128 in which two vectors of that cosine differ, and 4.5 standard deviations more."""
    p = np.arccos(cosine) / np.pi
    return int(np.ceil(128 * p + 4.5 * np.sqrt(128 * p * (1 - p))))


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float, dim: int) -> DataFrame:
    """The pairs (x, y, old) of refs whose vectors, in left and right (ref, u), have at least that cosine.

    Should two vectors have one ref, each is compared."""

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (matrix(b.column(c), np.dtype(np.float32), dim).astype(np.float64) for c in ("u", "v"))
            yield b.select(["x", "y", "old"]).filter(pa.array((u * v).sum(axis=1) >= least))

    got = pairs.join(left.select(F.col("ref").alias("x"), "u"), "x").join(right.select(F.col("ref").alias("y"), F.col("u").alias("v")), "y")
    return got.select("x", "y", "old", "u", "v").mapInArrow(cosine, "x bigint, y bigint, old boolean")


def usable_hash(h: Column) -> Column:
    low = F.lower(h)
    return F.when(low != EMPTY_TEXT, low)


def _place(c: str, buckets: int = MOST_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def _hash_keys(df: DataFrame, *keep: str) -> DataFrame:
    """(band, ref, s1, s2, h, keep...): a key for each text hash of df."""
    none = F.lit(0).cast("bigint")
    return df.where("text_hash is not null").select(F.xxhash64("text_hash").alias("band"), none.alias("ref"), none.alias("s1"), none.alias("s2"), F.col("text_hash").alias("h"), *keep).distinct()


def _with_h(keys: DataFrame) -> DataFrame:
    return keys.withColumn("h", F.lit(None).cast("string"))


class HistoryIndex:
    """The accepted records' text hashes, vectors and band keys, in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, dim: int = 64, least: float = 0.95, bucket_keys: int = BUCKET_KEYS) -> None:
        self.spark, self.path, self.dim, self.least, self.bucket_keys = spark, path or new_path(spark, "history"), dim, least, bucket_keys
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # parts: of each table a folder part=FIRST-LAST (of the appends it holds); a part counts once done/FIRST-LAST-BUCKETS is there

    def parts(self) -> list[tuple[int, int, int]]:
        """(first, last, buckets) of the parts that together hold every append once; a merged one stands for those it was made of."""
        done = self._hadoop(f"{self.path}/done")
        found = [tuple(int(x) for x in s.getPath().getName().split("-")) for s in self._fs.listStatus(done)] if self._fs.exists(done) else []
        out, n = [], 0
        while longest := max((p for p in found if p[0] == n), key=lambda p: p[1], default=None):
            out.append(longest)
            n = longest[1] + 1
        return out

    def _at(self, name: str, part: tuple[int, ...]) -> str:
        return f"{self.path}/{name}/part={part[0]}-{part[1]}"

    def _scan(self, name: str, parts: list[tuple[int, int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], _SCHEMAS[name] + ", part string, bucket int")
        read = self.spark.read.schema(_SCHEMAS[name] + ", part string, bucket int").option("basePath", f"{self.path}/{name}")
        return read.parquet(*[self._at(name, p) for p in parts])

    def _read(self, name: str, asked: DataFrame | None = None, rows: int = 0) -> DataFrame:
        """A table; asked: only the buckets that its values of the table's key (so many rows) are in."""
        parts = self.parts()
        table = self._scan(name, parts)
        # more rows than eight to a bucket are in all of them anyway
        large = [p for p in parts if p[2] > 1 and rows < 8 * p[2]]
        if asked is not None and large:
            places = [r[0] for r in asked.select(_place(_BY[name])).distinct().collect()]  # at most MOST_BUCKETS, of which parts' numbers are divisors
            hit = F.lit(False)
            for p in large:
                hit = hit | ((F.col("part") == f"{p[0]}-{p[1]}") & F.col("bucket").isin(sorted({x % p[2] for x in places})))
            rest = [f"{p[0]}-{p[1]}" for p in parts if p not in large]
            table = table.where(hit | F.col("part").isin(rest) if rest else hit)
        return table.drop("part", "bucket")

    def vectors(self, *asked) -> DataFrame:  # noqa: ANN002
        return self._read("vectors", *asked)

    def keys(self, *asked) -> DataFrame:  # noqa: ANN002
        return self._read("keys", *asked)

    def _write(self, first: int, last: int, vectors: DataFrame, keys: DataFrame | None, hashes: DataFrame | None, rows: int) -> None:
        """A part, from vectors (ref, u) and keys; keys None: made of the vectors and hashes. A failed write leaves nothing that is read."""
        n = 1
        while n < MOST_BUCKETS and n * self.bucket_keys < rows * BANDS:
            n *= 2

        def write(df: DataFrame, name: str) -> None:
            df = df.withColumn("bucket", _place(_BY[name], n))
            df = (df.repartition("bucket") if n > 1 else df.coalesce(1)).sortWithinPartitions("bucket", _BY[name])
            df.write.mode("overwrite").partitionBy("bucket").parquet(self._at(name, (first, last)))

        if keys is None:
            write(vectors, "vectors")
            there = self.spark.read.schema(_SCHEMAS["vectors"]).parquet(self._at("vectors", (first, last))).withColumn("n", F.lit(0))
            write(_with_h(vector_keys(there, self.dim).drop("n")).unionByName(_hash_keys(hashes)), "keys")
        else:
            with ThreadPoolExecutor(2) as both:  # two small jobs at once
                for w in [both.submit(write, vectors, "vectors"), both.submit(write, keys, "keys")]:
                    w.result()
        self._fs.create(self._hadoop(f"{self.path}/done/{first}-{last}-{n}"), True).close()

    def append(self, records: DataFrame, keys: DataFrame | None = None, rows: int | None = None) -> None:
        """Adds records (text_hash, u) to the index; u is a packed unit vector or null. keys: those of the records, if made already;
        rows: how many they are, about."""
        parts = self.parts()
        number = parts[-1][1] + 1 if parts else 0
        hashes = records.select(usable_hash(F.col("text_hash")).alias("text_hash"))
        vectors = records.where("u is not null").groupBy(F.xxhash64("u").alias("ref")).agg(F.first("u").alias("u"))
        self._write(number, number, vectors, keys, hashes, records.count() if rows is None else rows)
        self._merge()

    def _merge(self) -> None:
        """While the last FAN parts are of one size they become one; readers see either them or it."""
        size = lambda p: int(np.log2(max(1, self._fs.getContentSummary(self._hadoop(self._at("keys", p))).getLength())) // np.log2(FAN))
        while len(last := self.parts()[-FAN:]) == FAN and len({size(p) for p in last}) == 1:
            whole = lambda name, by: self._scan(name, last).drop("part", "bucket").dropDuplicates(by)
            vectors = whole("vectors", ["ref"])
            self._write(last[0][0], last[-1][1], vectors, whole("keys", ["band", "ref", "h"]), None, vectors.count())
            for p in last:
                self._fs.delete(self._hadoop(f"{self.path}/done/{p[0]}-{p[1]}-{p[2]}"), False)
                for name in _SCHEMAS:
                    self._fs.delete(self._hadoop(self._at(name, p)), True)

    # batches

    def check(self, items: DataFrame, key: str = "item_id", append: bool = True) -> DataFrame:
        """(key, batch_no, verdict) of items (key, batch_no, arrived_at, text_hash, vec).

        Verdicts are those of taking items one after the other by batch_no, then key: exact, near or accepted. Each batch probes
        what those before it appended; with append=False nothing is appended and all are one batch."""
        order = F.struct(F.coalesce("batch_no", F.lit(2**31 - 1)).alias("n"), F.col(key).alias("k"))
        rows = items.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), order.alias("o"), usable_hash(F.col("text_hash")).alias("text_hash"), "vec", F.xxhash64(key, "batch_no", "text_hash", "vec").alias("rid"), "arrived_at")
        kept = rows.groupBy("key").agg(F.min(F.struct(F.col("o.n").alias("n"), F.coalesce("arrived_at", F.to_timestamp(F.lit("9999-01-01"))).alias("at"), "rid", "o", "text_hash", "vec")).alias("r")).select("key", "r.o", "r.text_hash", "r.vec")
        batch = F.col("o.n") if append else F.lit(0)
        packed = with_unit_or_null(kept, dim=self.dim).withColumn("ref", F.when(F.col("u").isNotNull(), F.xxhash64("u"))).withColumn("n", batch)
        base = materialize(packed, "items", "n")
        sizes = {r["n"]: r["count"] for r in base.groupBy("n").count().collect()}  # a row per batch
        signed = vector_keys(base.where("u is not null").groupBy("n", "ref").agg(F.first("u").alias("u")), self.dim)
        signed = materialize(_with_h(signed).unionByName(_hash_keys(base, "n")), "keys", "n")
        paths = []
        for n in sorted(sizes):
            of = F.col("n") == n
            paths.append(self._batch(base.where(of), signed.where(of).drop("n"), sizes[n], append))
        kind, order = base.schema["key"].dataType.simpleString(), base.schema["o"].dataType.simpleString()
        schema = f"key {kind}, o {order}, verdict string"
        verdicts = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return verdicts.select(F.col("key").alias(key), F.col("o.n").alias("batch_no"), "verdict")

    def _batch(self, base: DataFrame, keys: DataFrame, rows: int, append: bool) -> str:
        """Where the verdicts (key, o, verdict) of one batch (key, o, text_hash, u, ref) with its keys are; appends what is accepted."""
        near = (differing("a", "b") <= most_differing(self.least)) & F.col("a.h").eqNullSafe(F.col("b.h"))
        n_keys = rows * (BANDS + 1)
        there = self.keys(keys, n_keys).withColumn("old", F.lit(True)).unionByName(keys.where("h is null").withColumn("old", F.lit(False)))
        asks = F.broadcast(keys) if n_keys <= SENT else keys
        met = there.alias("b").join(asks.alias("a"), (F.col("a.band") == F.col("b.band")) & near & (F.col("old") | (F.col("a.ref") != F.col("b.ref"))))
        hits = materialize(met.select(F.col("a.ref").alias("x"), F.col("b.ref").alias("y"), "old", F.col("a.h").alias("h")).distinct(), "hits")
        seen, hits = hits.where("h is not null").select("h"), hits.where("h is null")
        own = base.where("u is not null").groupBy("ref").agg(F.first("u").alias("u"))
        asked = hits.where("old").select(F.col("y").alias("ref"))
        of = self.vectors(asked, rows).join(asked, "ref", "left_semi")
        both = of.unionByName(own.join(hits.where("not old").select(F.col("y").alias("ref")), "ref", "left_semi"))  # a ref of both is compared twice
        found = verified(hits, own, both, self.least, self.dim)
        verdicts = new_path(self.spark, "verdicts")
        (self._in_turn(base, seen, found) if rows <= AT_ONCE else self._settle(base, seen, found)).write.parquet(verdicts)
        if append:
            new = self.spark.read.parquet(verdicts).where("verdict = 'accepted'").select("key").join(base.select("key", "text_hash", "u", "ref"), "key")
            names = new.select("ref", F.lit(None).cast("string").alias("h")).where("ref is not null").unionByName(new.select(F.lit(0).cast("bigint").alias("ref"), F.col("text_hash").alias("h")).where("h is not null"))
            names = names.select(F.col("ref").alias("r"), F.col("h").alias("g"))
            self.append(new.select("text_hash", "u"), keys.join(names, (F.col("ref") == F.col("r")) & F.col("h").eqNullSafe(F.col("g")), "left_semi"), rows)
        return verdicts

    def _in_turn(self, base: DataFrame, seen: DataFrame, found: DataFrame) -> DataFrame:
        """(key, o, verdict) of a batch of bounded size: its items, without their vectors, one after the other in one task."""
        near = found.groupBy(F.col("x").alias("ref")).agg(F.max("old").alias("old_near"), F.collect_set(F.when(~F.col("old"), F.col("y"))).alias("around"))  # refs of this batch only
        rows = base.select("key", "o", "text_hash", "ref").join(seen.select(F.col("h").alias("text_hash"), F.lit(True).alias("old_exact")), "text_hash", "left").join(near, "ref", "left")
        kind, order = (base.schema[c].dataType.simpleString() for c in ("key", "o"))

        def kernel(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches).combine_chunks()
            items = sorted(enumerate(t.to_pylist()), key=lambda x: (x[1]["o"]["n"], x[1]["o"]["k"]))
            hashes: set[str] = set()
            refs: set[int] = set()
            out = [""] * len(items)
            for i, r in items:
                if r["old_exact"] or r["text_hash"] is not None and r["text_hash"] in hashes:
                    out[i] = "exact"
                elif r["old_near"] or r["ref"] is not None and (r["ref"] in refs or not refs.isdisjoint(r["around"] or ())):
                    out[i] = "near"
                else:
                    out[i] = "accepted"
                    hashes.add(r["text_hash"])
                    refs.add(r["ref"])
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), t.column("o").combine_chunks(), pa.array(out)], names=["key", "o", "verdict"])

        return rows.groupBy(F.lit(0).alias("all")).applyInArrow(kernel, f"key {kind}, o {order}, verdict string")

    def _settle(self, base: DataFrame, seen: DataFrame, found: DataFrame) -> DataFrame:
        """(key, o, verdict) of a batch of any size. Statuses 0 (open) become 1 (accepted) or -1, in rounds: an item is settled once all
        that precede it and match it are; there are as many rounds as links in the longest chain.

        h and r stand for hash and vector: rows without one get a name of their own, so they don't meet in one task."""
        found = materialize(found, "found")
        alone = F.concat(F.lit(" "), F.col("key").cast("string"))
        state = base.select("key", "o", F.coalesce("text_hash", alone).alias("h"), F.coalesce(F.col("ref").cast("string"), alone).alias("r"))
        state = state.join(seen.select("h", F.lit(True).alias("old_exact")), "h", "left")
        state = state.join(found.where("old").select(F.col("x").cast("string").alias("r"), F.lit(True).alias("old_near")).distinct(), "r", "left")
        state = state.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("old_exact", "old_near")})
        state = materialize(state.withColumn("status", F.when(F.col("old_exact") | F.col("old_near"), -1).otherwise(0)), "state")
        around = materialize(found.where("not old").select(F.col("x").cast("string").alias("r"), F.col("y").cast("string").alias("y")), "around")

        def bounds(state: DataFrame) -> DataFrame:
            taken = lambda by: state.where("status >= 0").groupBy(by).agg(F.min(F.when(F.col("status") == 1, F.col("o"))).alias("taken"), F.min(F.when(F.col("status") == 0, F.col("o"))).alias("open"))
            by_hash = taken("h").select("h", F.col("taken").alias("h_taken"), F.col("open").alias("h_open"))
            by_ref = taken("r")
            beside = around.join(by_ref.withColumnRenamed("r", "y"), "y").select("r", "taken", "open")
            by_ref = by_ref.unionByName(beside).groupBy("r").agg(F.min("taken").alias("v_taken"), F.min("open").alias("v_open"))
            return state.join(by_hash, "h", "left").join(by_ref, "r", "left")

        columns = ["key", "o", "h", "r", "old_exact", "old_near"]
        false = F.lit(False)
        before = lambda c: F.coalesce(F.col(c) < F.col("o"), false)
        while True:
            status = F.when(F.col("status") != 0, F.col("status")).when(before("h_taken") | before("v_taken"), -1).when(before("h_open") | before("v_open"), 0).otherwise(1)
            state = materialize(bounds(state).select(*columns, status.alias("status")), "state")
            if state.where("status = 0").isEmpty():
                break
        verdict = F.when(F.col("old_exact") | before("h_taken"), "exact").when(F.col("old_near") | before("v_taken"), "near").otherwise("accepted")
        return bounds(state).select("key", "o", verdict.alias("verdict"))
