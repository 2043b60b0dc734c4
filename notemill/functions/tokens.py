"""The tokenizer-free token estimate, in whole sixtieths of a token so that no rounding of fractions can differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the ranges counted one token a character, and the estimate's weights in sixtieths of a token
CJK = r"぀-ヿ㐀-鿿豈-﫿가-힯"
UNITS = 60
CJK_UNITS, WORD_UNITS, WORD_CHAR_UNITS, SYMBOL_UNITS = 60, 78, 13, 30
SPACE = r"\s\x1c-\x1f\x85\xa0  -     　"
#: no text of so many tokens is shorter than this many characters times tokens
MAX_UNITS_PER_CHAR = 78


def token_units(text: Column) -> Column:
    """Estimated tokens of text, times 60."""
    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    runs = F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.lit(WORD_UNITS), F.length(w) * WORD_CHAR_UNITS))
    cjk = F.length(F.regexp_replace(text, f"[^{CJK}]+", ""))
    rest = F.regexp_replace(text, f"[{SPACE}{CJK}A-Za-z0-9_]+", "")
    symbols = F.length(F.regexp_replace(rest, r"[\p{L}\p{N}]+", ""))
    return runs + cjk * CJK_UNITS + (F.length(rest) - symbols) * WORD_UNITS + symbols * SYMBOL_UNITS


def tokens(text: Column) -> Column:
    """Estimated tokens of text, rounded up."""
    return F.ceil(token_units(text) / UNITS).cast("int")
