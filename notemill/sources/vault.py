"""Reading a vault: files as rows, Markdown, text, skill folders and page-split PDFs as documents.

documents() gives one row per file that counts, with the fields of the data model: path, kind, title, text, frontmatter (JSON), tags,
images, removed, needs_ocr, meta, file_hash, mtime, and error where a file could not be made a document: a bad file never fails the
others. Pages of PDFs come from a back-end: a function of (path, content, mtime) that gives (path, pages, content, mtime) and, if it
can, metadata_title and error. Without one a PDF is a document with an error."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.config import DEFAULTS
from notemill.functions.text import IMAGE_EXTENSIONS, all_tags, clean_common, first_h1, image_targets, needs_ocr, normalise_markdown, split_frontmatter
from notemill.operators.index import role_of
from notemill.operators.pdf import clean_pages, pdf_title, running_headers

SKILL_FILES = 200  #: files of a skill folder that are listed


def scan_vault(spark: SparkSession, vault: str, config: Any = DEFAULTS, only: list[str] | None = None, content: bool = True) -> DataFrame:
    """(path, role, mtime, length, content) of the vault's files; path is relative to the vault. role is document, image, or null for
    what doesn't count; such files have no content here, and are known by their path only. content=False: no file is opened.

    Spark's file sources pass over names that begin with _ or a dot, below the folder they are given. only: folders or files of the
    vault to read instead of all of it, such as the inbox; their own names may begin so."""
    root = vault.rstrip("/")
    at = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", f"{root}/{x}") for x in only] if only is not None else root
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(at)
    path = F.url_decode(F.replace(F.regexp_replace("path", r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    rows = raw.withColumn("path", F.regexp_replace(path, "^" + _quoted(root.removeprefix("file://")) + "/", ""))
    role = role_of(F.col("path"), [*config["exclude"], config["inbox"]], config["extensions"], config["image_extensions"])
    held = F.when(role.isNotNull(), F.col("content")) if content else F.lit(None).cast("binary")
    return rows.select("path", role.alias("role"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", held.alias("content"))


def _quoted(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("bad", T.BooleanType())]))
def yaml_json(blocks: pd.Series) -> pd.DataFrame:
    """Frontmatter as JSON: {} for what isn't a mapping; bad where it isn't YAML."""
    import yaml

    out = []
    for b in blocks:
        try:
            v = yaml.safe_load(b) if b is not None else None
            out.append((json.dumps(v if isinstance(v, dict) else {}, ensure_ascii=False, default=str), False))
        except (yaml.YAMLError, ValueError, RecursionError):
            out.append(("{}", True))
    return pd.DataFrame(out, columns=["json", "bad"])


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8, else the likeliest character set, else UTF-8 with replacements."""

    def one(data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            try:
                from charset_normalizer import from_bytes

                best = from_bytes(data).best()
            except ImportError:
                best = None
            return str(best) if best is not None else data.decode("utf-8", errors="replace")

    return content.map(lambda d: None if d is None else one(bytes(d)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _empty_images() -> Column:
    return F.array().cast("array<struct<name:string,path:string,page:int>>")


def _removed(*pairs: tuple[str, Column]) -> Column:
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("int").alias("value")) for k, v in pairs]), lambda e: e["value"] > 0)
    return F.map_from_entries(entries)


def _meta(chars: Column, pages: Column | None = None, files: Column | None = None) -> Column:
    return F.struct(chars.cast("int").alias("raw_chars"), (pages if pages is not None else F.lit(None)).cast("int").alias("pages"), (files if files is not None else F.array()).cast("array<string>").alias("files"))


def _error(failed: Column, message: str) -> Column:
    return F.when(failed, message)


def markdown(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Documents from Markdown (path, content, ...); a SKILL.md is its folder's skill. files: (path) of the whole vault, for skills."""
    rows = rows.withColumn("raw", decoded("content")).withColumn("skill", F.regexp_extract("path", r"([^/]*)$", 1) == "SKILL.md")
    block, body = split_frontmatter(F.col("raw"))
    rows = rows.withColumn("block", block).withColumn("body", body).withColumn("y", yaml_json("block"))
    fm = F.col("y.json")
    named = F.nullif(F.when(F.col("skill"), F.get_json_object(fm, "$.name")).otherwise(F.get_json_object(fm, "$.title")), F.lit(""))
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    rows = rows.withColumn("folder_path", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1))
    if files is not None:
        homes = rows.where("skill").select(F.col("folder_path").alias("home"))
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
        inside = files.select("path", F.explode(above).alias("home")).join(homes, "home").where(F.col("path") != F.concat("home", F.lit("SKILL.md")))
        listed = inside.groupBy("home").agg(F.slice(F.sort_array(F.collect_list(F.expr("substring(path, length(home) + 1)"))), 1, SKILL_FILES).alias("files"))
        rows = rows.join(listed.withColumnRenamed("home", "folder_path"), "folder_path", "left")
    else:
        rows = rows.withColumn("files", F.array().cast("array<string>"))
    title = F.when(F.col("skill"), F.coalesce(named, folder)).otherwise(F.coalesce(named, first_h1(F.col("body")), stem(F.col("path"))))
    images = F.transform(image_targets(F.col("body")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("page")))
    return rows.select(
        "path", F.when(F.col("skill"), "skill").otherwise("md").alias("kind"), title.alias("title"), clean_common(normalise_markdown(F.col("body"))).alias("text"), fm.alias("frontmatter"), all_tags(fm, F.col("body")).alias("tags"), images.alias("images"),
        _removed(("bad_frontmatter", F.col("y.bad"))).alias("removed"), F.lit(False).alias("needs_ocr"), _meta(F.length("raw"), None, F.col("files")).alias("meta"), F.sha1("content").alias("file_hash"), "mtime", _error(F.col("content").isNull(), "unreadable").alias("error"),
    )


def plain(rows: DataFrame) -> DataFrame:
    """Documents from text files (path, content, mtime) in any character set."""
    rows = rows.withColumn("raw", decoded("content"))
    return rows.select(
        "path", F.lit("txt").alias("kind"), stem(F.col("path")).alias("title"), clean_common(F.col("raw")).alias("text"), F.lit("{}").alias("frontmatter"), F.array().cast("array<string>").alias("tags"), _empty_images().alias("images"),
        F.map_from_entries(F.array().cast("array<struct<key:string,value:int>>")).alias("removed"), F.lit(False).alias("needs_ocr"), _meta(F.length("raw")).alias("meta"), F.sha1("content").alias("file_hash"), "mtime", _error(F.col("content").isNull(), "unreadable").alias("error"),
    )


def paged(rows: DataFrame) -> DataFrame:
    """Documents from PDFs given as (path, pages: array<string>, content or null, mtime[, metadata_title])."""
    for c in ("metadata_title", "error"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    clean = clean_pages(rows.select("path", "pages")).join(running_headers(rows.select("path", "pages")), "path", "left")
    both = rows.join(clean, "path", "left")
    text = clean_common(F.coalesce("text", F.lit("")))
    removed = _removed(*[(c, F.coalesce(c, F.lit(0))) for c in ("header_footer", "page_numbers", "hyphen_joins", "line_joins")])
    error = F.coalesce("error", _error(F.col("pages").isNull(), "no pages"))
    return both.select(
        "path", F.lit("pdf").alias("kind"), pdf_title(F.col("metadata_title"), F.coalesce("header", F.lit("")), text, stem(F.col("path"))).alias("title"), text.alias("text"), F.lit("{}").alias("frontmatter"), F.array().cast("array<string>").alias("tags"), _empty_images().alias("images"),
        removed.alias("removed"), F.coalesce(needs_ocr(F.col("pages")), F.lit(False)).alias("needs_ocr"), _meta(F.length(F.array_join("pages", "")), F.size("pages")).alias("meta"), F.sha1("content").alias("file_hash"), "mtime", error.alias("error"),
    )


def documents(files: DataFrame, pdf: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Markdown, skills, text files and PDFs of a scan (see scan_vault) as documents. pdf: the back-end that gives pages."""
    docs = files.where("role = 'document'")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = markdown(docs.where(ext == "md"), files.select("path")).unionByName(plain(docs.where(ext == "txt")))
    pdfs = docs.where(ext == "pdf").select("path", "content", "mtime")
    none = pdfs.select("*", F.lit(None).cast("array<string>").alias("pages"), F.lit("no back-end for PDFs").alias("error"))
    return out.unionByName(paged(pdf(pdfs) if pdf else none))


def images(files: DataFrame) -> DataFrame:
    """(path, file_hash, mtime, content) of the images of a scan."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where((F.col("role") == "image") & ext.isin(list(IMAGE_EXTENSIONS))).select("path", F.sha1("content").alias("file_hash"), "mtime", "content")


def tag_list(spark: SparkSession, path: str) -> DataFrame | None:
    """(tag, description) of a YAML file; None if there is no such file."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            read = yaml.safe_load(f) or {}
    except FileNotFoundError:
        return None
    return spark.createDataFrame([(str(k).lstrip("#"), str(v or "")) for k, v in read.items()], "tag string, description string")


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def extract(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Documents with their text cut to max_chars (0 or None: not cut) and whether it was."""
    if not max_chars:
        return docs.withColumn("truncated", F.lit(False))
    return docs.withColumn("truncated", F.length("text") > max_chars).withColumn("text", F.left("text", F.lit(max_chars)))
