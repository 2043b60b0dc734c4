"""Session helpers: the shared folder and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: paths written by each application, for release()
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's `spark.checkpoint.dir`, or (local runs only) one of our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    ours = "file://" + tempfile.mkdtemp(prefix="notemill-")
    spark.conf.set("spark.checkpoint.dir", ours)
    return ours


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: later plans neither repeat its work nor depend on executors.

    by: a column whose values have a folder each, so that plans for single values read no more and are compiled but once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; spread: for costly work on each row, dealt to all cores where its files give fewer partitions than there are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Deletes the tables this session wrote to the shared folder. DataFrames made from them can't be read afterwards."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        drop_table(spark, path)
