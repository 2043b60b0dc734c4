"""Problem 2: processing only what is new or changed, by a change log with per-partition offsets.

The vault's difference from the index (its last successful state) is captured into an append-only log; every change has a partition
(by its path's hash) and an offset in it. A run first writes its plan, the range of offsets it will take of each partition, then
processes those changes into a sink, then commits the plan. A run that finds a plan without commit repeats that plan in the same place,
and the sink keeps one row per path and offset, so a failure at any point neither skips nor repeats a change. A change that equals the
last one captured of its path, committed or not, is not captured again, so a path comes once even if the index isn't refreshed between
runs.

What a run reads doesn't grow with the log's age: each epoch of the log keeps the offsets it ends at, so only epochs with offsets still
to be taken are read; the last change of each path is a table of its own, folded together every FOLD epochs.

Defined results: rows without a path are ignored; a note indexed before the first run, or without indexed_at, is not valid; of runs
that start together the one with the greatest id counts; a null hash, on either side, differs from any; repeated rows are one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.session import new_path

PARTITIONS = 64  #: of the log: as many tasks number its changes; the offsets of all of them are the only thing the driver keeps
FOLD = 8  #: epochs whose changes are looked through beside the table of last changes
LAST = "path string, change_kind string, file_hash string, seen timestamp"
EVENTS = "path string, change_kind string, file_hash string, seen timestamp, part int, offset bigint"


def is_ok(status: Column) -> Column:
    return F.lower(F.trim(status)) == "ok"


def successful(notes: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of notes that a successful run wrote: the last one to start at or before indexed_at was.

    An as-of join: each run reigns from its start to the next one's, and is looked up by the days of its reign."""
    starts = runs.where("started_at is not null").groupBy("started_at").agg(F.max_by("status", "run_id").alias("status"))
    # one row per run, a short table by nature
    reign = starts.withColumn("until", F.lead("started_at").over(Window.orderBy("started_at")))
    last = reign.where("until is null").select("started_at", is_ok(F.col("status")).alias("ok")).head()
    if last is None:
        return notes.limit(0)
    good = reign.where(F.col("until").isNotNull() & is_ok(F.col("status")))
    days = good.select("started_at", "until", F.explode(F.sequence(F.to_date("started_at"), F.to_date("until"))).alias("day"))
    at = F.col("indexed_at")
    inside = notes.where(at < last["started_at"]).withColumn("day", F.to_date(at)).join(days, "day")
    inside = inside.where((at >= F.col("started_at")) & (at < F.col("until"))).select(*notes.columns)
    return inside.unionByName(notes.where(at >= last["started_at"])) if last["ok"] else inside


def changed_paths(files: DataFrame, notes: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, change_kind, file_hash, seen): paths of the vault added, updated or removed since a successful run indexed them."""
    known = successful(notes.select("path", "hash", "indexed_at"), runs).where("path is not null")
    known = known.groupBy("path").agg(F.max(F.struct("indexed_at", F.lower("hash").alias("hash"))).alias("k"))
    there = files.where("path is not null").groupBy("path").agg(F.max(F.struct("modification_time", F.lower("file_hash").alias("hash"))).alias("f"))
    both = there.join(known, "path", "full_outer")
    same = F.coalesce(F.col("f.hash") == F.col("k.hash"), F.lit(False))
    kind = F.when(F.col("k").isNull(), "added").when(F.col("f").isNull(), "removed").when(~same, "updated")
    return both.select("path", kind.alias("change_kind"), F.col("f.hash").alias("file_hash"), F.col("f.modification_time").alias("seen")).where("change_kind is not null")


class ChangeLog:
    """Log, plans, commits and sink in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None, partitions: int = PARTITIONS) -> None:
        self.spark, self.path, self.partitions = spark, path or new_path(spark, "changes"), partitions
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # small files: plans and commits

    def _at(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[int]:
        p = self._at(folder)
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p) if s.getPath().getName().isdigit()) if self._fs.exists(p) else []

    def _write(self, name: str, value: dict) -> bool:
        """Written beside and renamed, so a file is whole or not there; False if it was there already, by another run."""
        beside = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(beside, True)
        out.write(json.dumps(value).encode())
        out.close()
        if not self._fs.exists(self._at(name)) and self._fs.rename(beside, self._at(name)):
            return True
        self._fs.delete(beside, False)
        return False

    def _read(self, name: str) -> dict:
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at(name)), "UTF-8"))

    # the log: an epoch counts once the offsets it ends at are written

    def _ends_of(self, epoch: int) -> dict[int, int]:
        return {int(k): v for k, v in self._read(f"epochs/{epoch}").items()} if epoch >= 0 else {}

    def _events(self, epochs: list[int]) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(*[f"{self.path}/log/{e}" for e in epochs]) if epochs else self.spark.createDataFrame([], EVENTS)

    def events(self) -> DataFrame:
        return self._events(self._names("epochs"))

    def ends(self) -> dict[int, int]:
        """The offset after the last one of each partition: as many numbers as partitions."""
        return self._ends_of(max(self._names("epochs"), default=-1))

    def last_changes(self) -> DataFrame:
        """(path, change_kind, file_hash, seen): the last change captured of each path."""
        folded, epochs = self._names("folds"), self._names("epochs")
        fold = folded[-1] if folded else -1
        newer = self._events([e for e in epochs if e > fold]).groupBy("path").agg(F.max_by(F.struct("change_kind", "file_hash", "seen"), "offset").alias("c")).select("path", "c.*")
        if fold < 0:
            return newer
        older = self.spark.read.schema(LAST).parquet(f"{self.path}/last/{fold}")
        return newer.unionByName(older.join(newer.select("path"), "path", "left_anti"))

    def capture(self, changes: DataFrame) -> None:
        """Appends changes (path, change_kind, file_hash, seen) to the log as one epoch, without those that equal their path's last one.

        Where a hash is null, changes are equal only if their times are."""
        epochs = self._names("epochs")
        epoch, before = max(epochs, default=-1) + 1, self._ends_of(max(epochs, default=-1))
        new = changes
        if epochs:
            last = self.last_changes().select("path", F.struct("change_kind", "file_hash", "seen").alias("w"))
            again = (F.col("w.change_kind") == F.col("change_kind")) & F.col("w.file_hash").eqNullSafe(F.col("file_hash")) & (F.col("file_hash").isNotNull() | F.col("w.seen").eqNullSafe(F.col("seen")))
            new = changes.join(last, "path", "left").where(~F.coalesce(again, F.lit(False))).drop("w")
        part = F.pmod(F.xxhash64("path"), F.lit(self.partitions)).cast("int")
        new = new.withColumn("part", part)
        rank = F.row_number().over(Window.partitionBy("part").orderBy("path")) - 1
        new = new.withColumn("offset", (rank + self._start(before, F.col("part"))).cast("long"))
        new.select("path", "change_kind", "file_hash", "seen", "part", "offset").write.mode("overwrite").parquet(f"{self.path}/log/{epoch}")
        added = {r["part"]: r["n"] + 1 for r in self._events([epoch]).groupBy("part").agg(F.max("offset").alias("n")).collect()}  # a row per partition
        if not self._write(f"epochs/{epoch}", before | added):
            raise RuntimeError(f"epoch {epoch} was written by another run at the same time")
        fold = max(self._names("folds"), default=-1)
        if epoch - fold >= FOLD:
            self.last_changes().write.mode("overwrite").parquet(f"{self.path}/last/{epoch}")
            self._write(f"folds/{epoch}", {})

    @staticmethod
    def _start(offsets: dict[int, int], part: Column) -> Column:
        if not offsets:
            return F.lit(0)
        return F.coalesce(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[part], F.lit(0))

    # runs

    def done(self) -> dict[int, int]:
        commits = self._names("commits")
        return {int(k): v for k, v in self._read(f"plans/{commits[-1]}")["to"].items()} if commits else {}

    def plan(self) -> tuple[int, dict[int, int], dict[int, int]]:
        """(batch, from, to): the plan left without commit by a failed run, or a new one, written before anything is processed."""
        plans, commits = self._names("plans"), self._names("commits")
        if plans and plans[-1] not in commits:
            p = self._read(f"plans/{plans[-1]}")
            return plans[-1], *({int(k): v for k, v in p[x].items()} for x in ("from", "to"))
        batch, start, end = len(plans), self.done(), self.ends()
        if not self._write(f"plans/{batch}", {"from": start, "to": end}):
            return self.plan()  # another run was first: its plan holds
        return batch, start, end

    def batch(self, start: dict[int, int], end: dict[int, int]) -> DataFrame:
        """The events of a plan, from the epochs that hold any of them."""
        part, offset = F.col("part"), F.col("offset")
        need = []
        for e in reversed(self._names("epochs")):  # an epoch's offsets begin where the one before it ends
            begin, stop = self._ends_of(e - 1), self._ends_of(e)
            if any(begin.get(p, 0) < n and v > begin.get(p, 0) for p, v in stop.items() for n in (end.get(p, 0),)):
                need.append(e)
            if all(v <= start.get(p, 0) for p, v in begin.items()):
                break
        return self._events(need[::-1]).where((offset >= self._start(start, part)) & (offset < self._start(end, part)))

    def run(self, process: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Processes one plan into the sink and commits it; returns its number. process keeps path, part and offset."""
        number, start, end = self.plan()
        rows = self.batch(start, end)
        # plans' offsets don't overlap and a plan's repetition overwrites, so a row can be there twice only within a plan
        (process(rows).dropDuplicates(["path", "part", "offset"]) if process else rows).write.mode("overwrite").parquet(f"{self.path}/sink/{number}")
        self._write(f"commits/{number}", {})
        return number

    def sink(self) -> DataFrame:
        """What committed runs have put out, each path and offset once."""
        batches = self._names("commits")
        if not batches:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.parquet(*[f"{self.path}/sink/{b}" for b in batches])
