"""Heading-aware chunks of texts.

The estimate of tokens is additive over parts that no word spans, so a text is measured once, part by part, in sixtieths of a token.
Every packing step is then a search in prefix sums for the next place to cut."""

from __future__ import annotations

import os.path
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.functions.tokens import CJK, CJK_UNITS, SYMBOL_UNITS, UNITS, WORD_CHAR_UNITS, WORD_UNITS

# fixed values: words, CJK characters and symbols, as the estimate defines them, and the ends of sentences
_PART = re.compile(rf"([A-Za-z0-9_]+)|([{CJK}])|([^\s{CJK}A-Za-z0-9_])")
_SENTENCE_END = re.compile(r"[。！？!?；;\n]|\.(?=\s)")
_MARKS = ("```", "~~~")  # fixed values: what opens and closes code
DEEPEST = 6  # fixed value: levels of headings
GAP, HEAD, CODE, TEXT = range(4)  #: kinds of lines


class Span(NamedTuple):
    start: int
    end: int
    units: int


class Chunk(NamedTuple):
    path: tuple[str, ...]
    text: str
    start: int
    end: int
    units: int


def units(text: str) -> int:
    """Estimated tokens, times 60."""
    n = 0
    for m in _PART.finditer(text):
        if m.lastindex == 1:
            n += max(WORD_UNITS, WORD_CHAR_UNITS * (m.end() - m.start()))
        elif m.lastindex == 2:
            n += CJK_UNITS
        else:
            n += WORD_UNITS if m.group().isalnum() else SYMBOL_UNITS
    return n


def tokens(n: int) -> int:
    return -(-n // UNITS)


def title_of(line: str) -> tuple[int, str]:
    """(depth, title) of a heading line; depth 0 if it is none."""
    bare = line.rstrip("\n")
    rest = bare.lstrip("#")
    depth = len(bare) - len(rest)
    if not 1 <= depth <= DEEPEST or len(rest) < 2 or not rest[0].isspace():
        return 0, ""
    name = rest.strip()
    return depth, name.rstrip("#").rstrip() or name[:1]


def labels(lines: list[str]) -> list[tuple[int, int]]:
    """(kind, number) of each line: the lines of one block have one label. A fence that isn't closed goes on to the end."""
    out: list[tuple[int, int]] = []
    fence = None
    for i, line in enumerate(lines):
        bare = line.strip()
        if fence is not None:
            out.append((CODE, fence[1]))
            if bare.startswith(fence[0]):
                fence = None
        elif bare.startswith(_MARKS):
            fence = bare[:3], i
            out.append((CODE, i))
        elif title_of(line)[0]:
            out.append((HEAD, i))
        else:
            out.append((TEXT if bare else GAP, 0))
    return out


def runs(sizes: list[int], room: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs [i, j) of sizes, each as long as fits into room, but of one size at least."""
    total = [0, *accumulate(sizes)]
    i = 0
    while i < len(sizes):
        j = max(i + 1, bisect_right(total, total[i] + room) - 1)
        yield i, j
        i = j


def divided(text: str, start: int, most: int, hard: int) -> Iterator[Span]:
    """A block as runs of sentences; a run beyond hard is cut by characters."""
    at = sorted({0, len(text), *(m.end() for m in _SENTENCE_END.finditer(text))})
    sizes = [units(text[a:b]) for a, b in zip(at, at[1:])]
    for i, j in runs(sizes, most * UNITS):
        a, b, u = at[i], at[j], sum(sizes[i:j])
        step = b - a if tokens(u) <= hard else max(1, (b - a) * most // tokens(u))
        cuts = [*range(a, b, step), b]
        yield from (Span(start + x, start + y, u if step == b - a else units(text[x:y])) for x, y in zip(cuts, cuts[1:]))


def sections(text: str, most: int, hard: int) -> Iterator[tuple[tuple[str, ...], str, list[Span], list[str]]]:
    """(headings above, heading line, spans, their texts) of each section that has any."""
    lines = text.splitlines(keepends=True)
    starts = [0, *accumulate(map(len, lines))]
    above: list[str | None] = [None] * DEEPEST
    line, spans, bodies = "", [], []
    at = 0
    for (kind, _), group in groupby(labels(lines)):
        first, at = at, at + len(list(group))
        if kind == HEAD:
            if spans:
                yield tuple(t for t in above if t is not None), line, spans, bodies
            depth, title = title_of(lines[first])
            above[depth - 1 :] = [title, *[None] * (DEEPEST - depth)]
            line, spans, bodies = lines[first].strip(), [], []
        elif kind != GAP:
            body = "".join(lines[first:at]).strip("\n")
            room, n = most - tokens(units(line)), units(body)
            whole = tokens(n) <= (max(hard, room) if kind == CODE else room)  # code is divided beyond hard only
            own = [Span(starts[first], starts[at], n)] if whole else list(divided(body, starts[first], room, hard))
            spans += own
            bodies += [body] if whole else [body[s.start - starts[first] : s.end - starts[first]] for s in own]
    if spans:
        yield tuple(t for t in above if t is not None), line, spans, bodies


def chunks_of(text: str, least: int = 300, most: int = 800, hard: int = 1024) -> list[Chunk]:
    """Spans packed greedily within sections, then small chunks merged with the one before where both fit."""
    packed: list[Chunk] = []
    for path, line, spans, bodies in sections(text, most, hard):
        top = units(line)
        for i, j in runs([s.units for s in spans], (most - tokens(top)) * UNITS):
            packed.append(Chunk(path, "\n\n".join(([line] if line else []) + bodies[i:j]), spans[i].start, spans[j - 1].end, top + sum(s.units for s in spans[i:j])))
    groups: list[list[int]] = []  # [from, to, units] of packed
    for i, c in enumerate(packed):
        if groups and min(tokens(c.units), tokens(groups[-1][2])) < least and tokens(groups[-1][2] + c.units) <= most:
            groups[-1][1:] = [i + 1, groups[-1][2] + c.units]
        else:
            groups.append([i, i + 1, c.units])
    out = []
    for i, j, n in groups:
        of = packed[i:j]
        out.append(Chunk(tuple(os.path.commonprefix([c.path for c in of])), "\n\n".join(c.text for c in of), min(c.start for c in of), max(c.end for c in of), n))
    return out


def chunk_texts(df: DataFrame, key: str = "path", text: str = "text", least: int = 300, most: int = 800, hard: int = 1024) -> DataFrame:
    """(key, idx, heading_path, text, start_pos, end_pos, tokens): the chunks of each text; blank and null texts have none."""
    kind = df.schema[key].dataType.simpleString()
    names = ["idx", "heading_path", "text", "start_pos", "end_pos", "tokens"]
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            columns: list[list] = [[] for _ in names]
            for r, t in enumerate(b.column("text").to_pylist()):
                for i, c in enumerate(chunks_of(t, least, most, hard) if t and t.strip() else []):
                    rows.append(r)
                    for column, v in zip(columns, (i, " > ".join(c.path), c.text, c.start, c.end, tokens(c.units))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[key, *names])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, idx int, heading_path string, text string, start_pos int, end_pos int, tokens int")
