"""The deterministic embedding of texts: hashed character 2- and 3-grams, at unit length, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.tokens import SPACE


IMAGE_BYTES = 2048  # fixed value: of an image that its vector is made of


def ngram_buckets(df: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """(key, bucket, n): how often each bucket is hit by an n-gram of the text in lower case without white space.

    The bucket is the first bytes of the n-gram's MD5, little-endian, modulo dim (a power of two up to 65536). Counts are added up
    before the shuffle, one short row per text and bucket."""
    t = F.regexp_replace(F.lower(F.col(text)), f"[{SPACE}]+", "")
    # an array of characters: its elements are found at once, those of a string by counting from its start
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.filter(F.split(t, ""), lambda c: c != "").alias("c"))
    at = lambda i: F.get(F.col("c"), i)
    two = F.transform("c", lambda x, i: F.concat(x, at(i + 1)))
    three = F.transform("c", lambda x, i: F.concat(x, at(i + 1), at(i + 2)))
    grams = F.filter(F.concat(two, three), lambda g: g.isNotNull())
    # outer: else Spark infers a filter on the n-grams and makes them twice
    rows = rows.select(key, F.explode_outer(grams).alias("g")).where("g is not null").withColumn("m", F.md5(F.col("g").cast("binary")))
    byte = lambda at: F.conv(F.substring("m", at, 2), 16, 10).cast("int")
    bucket = (byte(1) + 256 * byte(3)) % dim
    return rows.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ngram_vectors(df: DataFrame, key: str, text: str, dim: int = 1024) -> DataFrame:
    """(key, vec): the unit vector of each text; an empty text is the first axis, a text of one character the zero vector."""
    hit = ngram_buckets(df, key, text, dim).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"))
    t = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), f"[{SPACE}]+", "")
    whole = df.select(key, (F.length(t) == 0).alias("blank")).distinct().join(hit, key, "left")
    norm = F.sqrt(F.aggregate(F.map_values("m"), F.lit(0.0), lambda s, x: s + x * x))
    axis = F.sequence(F.lit(0), F.lit(dim - 1))
    vec = F.transform(axis, lambda i: F.coalesce(F.try_element_at(F.col("m"), i) / norm, F.when(F.col("blank") & (i == 0), 1.0).otherwise(0.0)))
    return whole.select(key, vec.alias("vec"))


def image_vectors(df: DataFrame, key: str, content: str, dim: int = 1024) -> DataFrame:
    """(key, vec): the same of an image's first bytes in hexadecimal digits: a stand-in that knows equal images, nothing of what they show."""
    digits = F.lower(F.hex(F.substring(F.col(content), 1, IMAGE_BYTES)))
    return ngram_vectors(df.select(key, digits.alias("digits")), key, "digits", dim)
