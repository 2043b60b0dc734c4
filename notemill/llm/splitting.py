"""Problem 1: oversized texts cut into overlapping pieces at natural boundaries, by one regular expression with bounded quantifiers.

The expression's unit is an atom: a CJK character, up to six characters of a word, or another character, each with the white
space after it. An atom has at most 1.3 estimated tokens, so a bound on atoms is a bound on tokens. A text is first written as its
shape, one letter for each atom that says which boundary the atom ends at: p a paragraph, i a line before a list item, s a sentence,
l a line, w a word, c none. On the shape, alternatives ordered by the strength of the boundary take as many letters as the bound
allows; the last one cuts anywhere. Letters have no inner structure, so the expression takes no stack, whatever the bound. The bound
is first set by the text's own density; where a piece then exceeds the limit, the text is cut again with the bound that holds for any
text. An overlap is a look back over the shape: at most as many atoms as are sure to be within overlap_tokens (so most overlaps have
fewer tokens: prose about three quarters), from the first start of a sentence or line among them, else of a word.

Defined results: null and blank texts and texts within the limit give no row; repeated rows (same key and text) give one set of
pieces; a null heading_path stays null; extra columns are dropped; white space belongs to the piece before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.tokens import CJK, MAX_UNITS_PER_CHAR, SPACE, UNITS, token_units, tokens
from notemill.session import materialize

ATOM = f"(?>[{CJK}]|[A-Za-z0-9_]{{1,6}}|[^{SPACE}{CJK}A-Za-z0-9_])[{SPACE}]*+"
MARKS = "\ue0f1\ue0f2\ue0f3\ue0f4\ue0f5"  #: private characters that stand for boundaries while a shape is made; a text's own don't count
PARAGRAPH, LIST_ITEM, SENTENCE, LINE, INNER = MARKS
NEXT = f"(?=[^{SPACE}{MARKS}])"  #: a boundary is where white space has ended
BOUNDARIES = [
    (PARAGRAPH, rf"(?<=\n[ \t]{{0,8}}\n[ \t]{{0,8}}){NEXT}"),
    (LIST_ITEM, rf"(?<=\n[ \t]{{0,8}})(?=[-*+•] |[0-9]{{1,3}}[.)] )"),
    (SENTENCE, rf"(?<=[。！？!?；;][{SPACE}]{{0,4}}|\.[{SPACE}]{{1,4}}){NEXT}"),
    (LINE, rf"(?<=\n[ \t]{{0,8}}){NEXT}"),
]
LETTERS = "pislc"
#: MIN, LOW and MAX stand for the bounds: a strong boundary in the upper half of a piece goes before a stronger one in the lower
PIECE = "|".join([r".{1,MAX}\z", *(f".{{MIN,MAX}}(?<={b})" for b in LETTERS[:4]), *(f".{{LOW,MAX}}(?<={b})" for b in (*LETTERS[:4], "[^c]")), ".{1,MAX}"])


def shape(text: Column) -> Column:
    """A letter for each atom of text, in order."""
    out = F.translate(text, MARKS, "?" * len(MARKS))
    for mark, pattern in BOUNDARIES:
        out = F.regexp_replace(out, pattern, mark)
    out = F.regexp_replace(out, r"[A-Za-z0-9_]{6}(?=[A-Za-z0-9_])", INNER)  # from the beginning of each word on
    out = F.regexp_replace(out, f"(?>[A-Za-z0-9_]++|[^{SPACE}{MARKS}])[{SPACE}]*+", "w")
    for mark, letter in zip(MARKS[:4], LETTERS):  # the strongest of the boundaries at one place, in place of the letter before it
        out = F.regexp_replace(out, f"w[{MARKS[:4]}]*?{mark}[{MARKS[:4]}]*+", letter)
    return F.regexp_replace(F.translate(out, INNER, "c"), "[^pislwc]++", "")


def _pattern(most: Column) -> Column:
    least = F.greatest(F.lit(1), F.floor(most / 2)).cast("string")
    low = F.greatest(F.lit(1), F.floor(most / 8)).cast("string")  # a heading line alone makes no piece
    return F.replace(F.replace(F.replace(F.lit(PIECE), F.lit("MIN"), least), F.lit("LOW"), low), F.lit("MAX"), most.cast("string"))


def _texts(atoms: str, parts: Column) -> Column:
    """The text of each part of a shape; parts follow one another."""
    to = F.aggregate(parts, F.array(F.lit(1)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return F.transform(parts, lambda p, i: F.array_join(F.slice(F.col(atoms), F.get(to, i), F.length(p)), ""))


def _laps(parts: Column, most: int) -> Column:
    """How many atoms at the end of each part are repeated: at most so many, from the start of a sentence or line, else of a word."""

    def one(p: Column) -> Column:
        tail = F.right(p, F.lit(most))
        sentence, word = F.regexp_extract(tail, "[pisl](.+)$", 1), F.regexp_extract(tail, "[^c](.+)$", 1)
        return F.length(F.when(sentence != "", sentence).when(word != "", word).otherwise(tail))

    return F.transform(parts, one) if most >= 1 else F.transform(parts, lambda _: F.lit(0))


def split_oversized(df: DataFrame, key: str, text: str = "text", heading: str = "heading_path", max_tokens: int = 800, overlap_tokens: int = 80) -> DataFrame:
    """(key, piece, pieces, heading_path, text, tokens, start_pos, end_pos, overlap) for each text of more than max_tokens tokens.

    text of a piece is the heading line that the whole begins with (from the second piece on), the overlap with the piece
    before, and its own part, [start_pos, end_pos) of the whole; overlap is the overlap's length in characters."""
    limit = max_tokens * UNITS
    t = F.col("text")
    big = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(heading).alias("heading"))
    big = big.where(F.length(t) * MAX_UNITS_PER_CHAR > limit).withColumn("units", token_units(t)).where(F.col("units") > limit)
    # a text that many rows have is cut once
    whole = materialize(big.withColumn("h", F.unhex(F.md5("text"))), "oversized")
    who = whole.select("h", "key", "heading").dropDuplicates(["h", "key"])
    # few rows are left, which would be read as one partition, but cutting is costly: they are dealt out again
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    big = whole.groupBy("h").agg(F.first("text").alias("text"), F.first("units").alias("units")).repartition(tasks)
    line = F.regexp_extract(t, r"\A(#{1,6}[ \t]+[^\n]{1,4000})\n", 1)
    big = big.withColumn("head", F.when(token_units(line) * 4 <= limit, line).otherwise(""))
    big = big.withColumn("room", F.lit(limit - overlap_tokens * UNITS) - token_units(F.col("head")))
    big = big.withColumn("atoms", F.regexp_extract_all(t, F.lit(f"((?>\\A[{SPACE}]++)?{ATOM})"), F.lit(1))).withColumn("shape", shape(t))
    dense = F.greatest(F.col("units") / F.size("atoms"), F.lit(1.0)) * 1.1
    sure = F.greatest(F.lit(1), F.floor(F.col("room") / MAX_UNITS_PER_CHAR)).cast("int")
    cut = lambda most: F.regexp_extract_all("shape", _pattern(most), F.lit(0))
    first = cut(F.greatest(sure, F.floor(F.col("room") / dense).cast("int")))
    big = big.withColumn("parts", first).withColumn("own", _texts("atoms", F.col("parts")))
    fits = F.forall("own", lambda p: token_units(p) <= F.col("room"))
    big = big.withColumn("fits", fits).withColumn("parts", F.when(F.col("fits"), F.col("parts")).otherwise(cut(sure)))
    big = big.withColumn("own", F.when(F.col("fits"), F.col("own")).otherwise(_texts("atoms", F.col("parts"))))
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    chars = F.aggregate("own", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    big = big.withColumn("laps", _laps(F.col("parts"), overlap_tokens * UNITS // MAX_UNITS_PER_CHAR)).withColumn("ends", ends).withColumn("chars", chars)
    before = lambda i: F.array_join(F.slice("atoms", F.get("ends", i) - F.get("laps", i - 1) + 1, F.get("laps", i - 1)), "")
    lap = F.transform("own", lambda _, i: F.when(i == 0, F.lit("")).otherwise(before(i)))
    # outer: else Spark infers a filter on the parts, pushes it down and cuts every text twice
    big = big.withColumn("lap", lap).select("h", "head", "chars", F.posexplode_outer(F.arrays_zip("own", "lap")).alias("piece", "p"), F.size("own").alias("pieces"))
    head = F.when((F.col("piece") == 0) | (F.col("head") == ""), F.lit("")).otherwise(F.concat("head", F.lit("\n\n")))
    out = big.withColumn("whole", F.concat(head, "p.lap", "p.own"))
    out = out.select(
        "h", "piece", "pieces", F.col("whole").alias("text"), tokens(F.col("whole")).alias("tokens"),
        F.element_at("chars", F.col("piece") + 1).alias("start_pos"), F.element_at("chars", F.col("piece") + 2).alias("end_pos"), F.length("p.lap").alias("overlap"),
    )
    out = materialize(out, "pieces")  # else the optimizer drops or repeats the cut around the join
    return who.join(out, "h").select(F.col("key").alias(key), "piece", "pieces", F.col("heading").alias("heading_path"), "text", "tokens", "start_pos", "end_pos", "overlap")


def cut_right(pieces: DataFrame, key: str, max_tokens: int = 800) -> DataFrame:
    """(key) of the texts whose pieces, as they are, keep the limit, follow one another without a gap and hold their own part and overlap."""
    whole = F.col("end_pos") - F.col("start_pos")
    per = pieces.groupBy(key).agg(F.max("tokens").alias("most"), F.count(F.lit(1)).alias("n"), F.sum(whole).alias("chars"), F.max("end_pos").alias("end"), F.min(F.length("text") - whole - F.col("overlap")).alias("rest"))
    return per.where((F.col("most") <= max_tokens) & (F.col("n") >= 2) & (F.col("chars") >= F.col("end")) & (F.col("rest") >= 0)).select(key)
