"""The inbox as a stream: each file that arrives is extracted once, and each micro-batch is handed on as documents.

Spark's checkpoint keeps which files were taken, and the sink one folder per batch, written over if a batch is repeated, so a restart
neither loses nor doubles a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notemill.sources.vault import markdown, plain

FIELDS = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, inbox: str, out: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a stream over the Markdown and text files of a folder; it ends when all that are there have been taken."""
    raw = spark.readStream.format("binaryFile").schema(FIELDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(inbox)

    def batch(rows: DataFrame, number: int) -> None:
        files = rows.withColumn("mtime", F.unix_micros("modificationTime") / 1e6)
        ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        docs = markdown(files.where(ext == "md")).unionByName(plain(files.where(ext == "txt")))
        (handle(docs) if handle else docs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
