"""Text of PDF pages: running headers and footers, page numbers, wrapped lines. Pages come as an array of texts per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notemill.functions.text import is_page_number, join_lines, norm_line, strip

# fixed value: titles that word processors put in
STAND_IN = r"(?i)^(untitled|microsoft (word|powerpoint)\b)|\.(docx?|pdf)$"


def page_lines(docs: DataFrame) -> DataFrame:
    """(path, pages, page, line, text, top, bottom): lines of docs (path, pages); top and bottom: place among the page's lines that
    are not blank, from either end, counted from 0; null for blank lines."""
    rows = docs.select("path", F.size("pages").alias("pages"), F.posexplode("pages").alias("page", "body"))
    lines = F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(x, r"(?U)(?<!\s)\s++$", ""))
    rows = rows.select("path", "pages", "page", F.posexplode(lines).alias("line", "text"))
    page = Window.partitionBy("path", "page")
    full = F.when(strip(F.col("text")) != "", 1).otherwise(0)
    seen = F.sum(full).over(page.orderBy("line"))
    total = F.sum(full).over(page)
    return rows.withColumn("top", F.when(full == 1, seen - 1)).withColumn("bottom", F.when(full == 1, total - seen))


def edge_keys(top: Column, bottom: Column, text: Column) -> Column:
    """The line at the edges of its page, as place and text with numbers made alike: of the first and last two."""
    norm = norm_line(text)
    key = lambda c, side: F.when(c < 2, F.concat(F.lit(side), c.cast("string"), F.lit(":"), norm))
    return F.filter(F.array(key(top, "t"), key(bottom, "b")), lambda x: x.isNotNull())


def repeated_edges(lines: DataFrame) -> DataFrame:
    """(path, key): edges that at least three pages, and half of all, have in the same place."""
    keyed = lines.where("pages >= 3").select("path", "pages", "page", F.explode(edge_keys(F.col("top"), F.col("bottom"), F.col("text"))).alias("key")).distinct()
    counted = keyed.groupBy("path", "pages", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= 3) & (F.col("n") * 2 >= F.col("pages")) & (F.length("key") > 3)).select("path", "key")


def clean_pages(docs: DataFrame) -> DataFrame:
    """(path, text, header_footer, page_numbers, hyphen_joins, line_joins) of docs (path, pages)."""
    lines = page_lines(docs)
    marked = lines.select("*", F.explode_outer(edge_keys(F.col("top"), F.col("bottom"), F.col("text"))).alias("key")).join(repeated_edges(lines).withColumn("hit", F.lit(1)), ["path", "key"], "left")
    per = marked.groupBy("path", "page", "line").agg(F.first("text").alias("text"), F.max(F.coalesce("hit", F.lit(0))).alias("edge"))
    per = per.withColumn("number", F.when((F.col("edge") == 0) & is_page_number(F.col("text")), 1).otherwise(0))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("line", "text", "edge", "number"))), lambda x: (x["edge"] == 0) & (x["number"] == 0))
    page = per.groupBy("path", "page").agg(join_lines(F.transform(kept, lambda x: x["text"])).alias("j"), F.sum("edge").alias("edges"), F.sum("number").alias("numbers"))
    body = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", F.col("j.text").alias("t")))), lambda x: x["t"]), lambda t: t != ""), "\n\n")
    return page.groupBy("path").agg(body.alias("text"), F.sum("edges").alias("header_footer"), F.sum("numbers").alias("page_numbers"), F.sum("j.hyphen_joins").alias("hyphen_joins"), F.sum("j.line_joins").alias("line_joins"))


def running_headers(docs: DataFrame) -> DataFrame:
    """(path, header): the first line that at least three pages of docs (path, pages), and half of all, begin with."""
    first = page_lines(docs).where("top = 0 and pages >= 3").select("path", "pages", strip(F.col("text")).alias("header"))
    often = first.groupBy("path", "pages", "header").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= 3) & (F.col("n") * 2 >= F.col("pages")))
    return often.groupBy("path").agg(F.min(F.struct(-F.col("n"), "header")).alias("h")).select("path", "h.header")


def pdf_title(metadata: Column, header: Column, text: Column, stem: Column) -> Column:
    """The document's title: its own, unless it is a stand-in; a short running header; the first line if short; the file's name."""
    own = strip(F.coalesce(metadata, F.lit("")))
    stand_in = F.regexp(own, F.lit(STAND_IN))
    line = strip(F.regexp_extract(text, r"(?d)(?:\A|\n)([^\n]*\S[^\n]*)", 1))
    return F.coalesce(F.when((own != "") & ~stand_in, own), F.when((F.length(header) > 0) & (F.length(header) < 80), header), F.when((F.length(line) > 0) & (F.length(line) < 80), line), stem)
