"""Keeping an index: what a scan changed, statistics, image references, and the atomic swap of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import IMAGE_EXTENSIONS


def role_of(path: Column, exclude: list[str], extensions: list[str], images: list[str]) -> Column:
    """document, image or null: whether a file of a vault counts, with no excluded name anywhere in its path."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    role = F.when(ext.isin(extensions), "document").when(ext.isin(images), "image")
    return F.when(~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in exclude])), role)


def scanned(files: DataFrame, exclude: list[str], extensions: list[str], images: list[str]) -> DataFrame:
    """(path, role) of the files of a vault that count, each once."""
    return files.select("path", role_of(F.col("path"), exclude, extensions, images).alias("role")).where("role is not null").distinct()


def index_diff(files: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, change): scan (path, mtime, hash) against index (path, mtime, hash): an equal time needs no reading; an equal hash only
    a new time (touched); null hashes differ."""
    known = notes.select("path", F.col("mtime").alias("m"), F.lower("hash").alias("h"))
    both = files.select("path", "mtime", F.lower("hash").alias("hash"), F.lit(1).alias("f")).join(known.withColumn("k", F.lit(1)), "path", "full_outer")
    change = F.when(F.col("k").isNull(), "added").when(F.col("f").isNull(), "removed").when(F.col("mtime") == F.col("m"), "unchanged").when(F.col("hash") == F.col("h"), "touched").otherwise("updated")
    return both.select("path", change.alias("change"))


def index_stats(diff: DataFrame) -> DataFrame:
    """One row: how many paths were added, updated, unchanged (touched ones among them) and removed, and how many notes there are."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return diff.agg(n("added").alias("added"), n("updated").alias("updated"), n("unchanged", "touched").alias("unchanged"), n("removed").alias("removed"), n("added", "updated", "unchanged", "touched").alias("notes_total"))


def image_referrers(docs: DataFrame) -> DataFrame:
    """(image, referenced_by) from docs (path, images): the notes that show an image, in order; only current references count."""
    refs = docs.select("path", F.explode("images").alias("i")).select("path", F.coalesce("i.path", "i.name").alias("image"))
    return refs.where("image is not null").distinct().groupBy("image").agg(F.sort_array(F.collect_list("path")).alias("referenced_by"))


def resolve_images(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(note, name, path): refs (note, name) as files (path): beside the note, from the vault's root, else the first of that name."""
    local = refs.where(~F.col("name").rlike("(?i)^[a-z]+://"))
    local = local.withColumn("want", F.url_decode(F.replace(F.trim("name"), F.lit("+"), F.lit("%2B"))))
    folder = F.regexp_extract("note", r"^(.*/)[^/]*$", 1)
    images = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(IMAGE_EXTENSIONS))).select("path").distinct()
    hit = local.withColumn("near", F.concat(folder, "want")).withColumn("base", F.regexp_extract("want", r"([^/]*)$", 1))
    one = images.select(F.col("path").alias("near"), F.col("path").alias("p1"))
    two = images.select(F.col("path").alias("want"), F.col("path").alias("p2"))
    three = images.groupBy(F.regexp_extract("path", r"([^/]*)$", 1).alias("base")).agg(F.min("path").alias("p3"))
    out = hit.join(one, "near", "left").join(two, "want", "left").join(three, "base", "left")
    return out.select("note", "name", F.coalesce("p1", "p2", "p3").alias("path"))
