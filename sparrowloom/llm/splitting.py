"""Cutting texts over a size limit at natural boundaries, with an overlap.

A text is parsed into a tree as far as its size demands: sections by headings,
blocks by blank lines, lines (list items, rows), sentences, words. Only nodes
over the limit are opened; adjacent siblings are then merged, bottom-up, as long
as they stay within it. The spans that result cover the text without gaps; a
piece is a span preceded by the last ``overlap`` characters before it.

A run without space, tab, line feed or carriage return that is itself over the
limit is the only thing ever cut inside (``forced``), and then not before a
combining sign. A run that fits the limit but leaves no room for the whole
overlap is kept whole with a shorter overlap. Characters are Unicode code points.
Null texts and texts within the limit give no pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("section", "block", "line", "sentence", "word", "forced")

_HEADING = re.compile(r"^(?:(#{1,6})[ \t]|(={1,6})[^=\n]|<[hH]([1-6])\b|\\(part|chapter|(?:sub){0,2}section)\b|([^\n]+\n(?:={3,}|-{3,})[ \t]*$))", re.M)
_TEX = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4}
_BLOCK = re.compile(r"\n[ \t\r]*\n\s*|(?:</(?:p|div|ul|ol|table|pre|blockquote|section|article|h[1-6])>)\s*", re.I)
_LINE = re.compile(r"\n|<br\s*/?>|</(?:li|tr|dd|dt)>", re.I)
_SENTENCE = re.compile(r"[.!?…]+[\"')\]»”]*[ \t\r\n]+|[。！？]+")
_WORD = re.compile(r"[ \t\r\n]+")


def _depth(m: re.Match) -> int:
    for i in (1, 2):
        if m[i]:
            return len(m[i])
    if m[3]:
        return int(m[3])
    if m[4]:
        return _TEX[m[4]]
    return 1 if m[5].rstrip().endswith("=") else 2


def _cuts(text: str, a: int, b: int, level: int) -> list[int]:
    """Places strictly inside (a, b) where a node may be cut at this level."""
    if level == 0:
        marks = [(m.start(), _depth(m)) for m in _HEADING.finditer(text, a, b) if m.start() > a]
        if not marks:
            return []
        top = min(d for _, d in marks)
        return [p for p, d in marks if d == top]
    if level == 4:
        # both ends of a gap, so that a word never carries white space along; inside a long gap anywhere
        found = []
        for m in _WORD.finditer(text, a, b):
            found += [m.start(), m.end()] if m.end() - m.start() < 400 else [m.start(), *range(m.start() + 200, m.end(), 200), m.end()]
    else:
        found = [m.end() for m in (_BLOCK, _LINE, _SENTENCE)[level - 1].finditer(text, a, b)]
    return [p for p in found if a < p < b]


def _joined(text: str, p: int) -> bool:
    """Whether the sign at p belongs to the one before it."""
    c = text[p]
    return c in "\u200d\ufe0f\ufe0e" or text[p - 1] == "\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff" or unicodedata.category(c).startswith("M")


def _pack(text: str, a: int, b: int, level: int, cap: int, limit: int) -> list[tuple[int, int, int]]:
    """Spans (start, end, level of the cut before it) of a node that is over ``cap``."""
    while level < 5:
        cuts = _cuts(text, a, b, level)
        if cuts:
            break
        level += 0 if level == 0 and cuts else 1
    else:
        if b - a <= limit:
            return [(a, b, 4)]
        out, at = [], a
        while b - at > cap:
            p = at + cap
            back = p
            while back > p - 16 and back > at + 1 and _joined(text, back):
                back -= 1
            p = back if not _joined(text, back) else p
            out.append((at, p, 5))
            at = p
        return [*out, (at, b, 5)]
    out: list[tuple[int, int, int]] = []
    edges = [a, *cuts, b]
    for s, e in zip(edges, edges[1:]):
        # a section may hold deeper headings; other nodes are opened at the next level
        parts = [(s, e, level)] if e - s <= cap else _pack(text, s, e, level if level == 0 else level + 1, cap, limit)
        for i, (x, y, lv) in enumerate(parts):
            lv = level if i == 0 else lv
            if out and y - out[-1][0] <= cap:
                out[-1] = (out[-1][0], y, out[-1][2])
            else:
                out.append((x, y, lv))
    return out


def split(text: str, limit: int = 1000, overlap: int = 200) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, end, shared, boundary)`` of a text over the limit: the piece is
    text[start:end], its first ``shared`` characters end the piece before it, and
    ``boundary`` names the kind of the cut before its own part ("start" at first);
    within a run of over ``limit`` characters without blanks it is forced, also at a sign."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0, "start")]
    spans = _pack(text, 0, len(text), 0, limit - overlap, limit)
    runs = [m.span() for m in re.finditer(rf"(?<![^ \t\r\n])[^ \t\r\n]{{{limit + 1},}}", text)]
    out = []
    for i, (a, b, level) in enumerate(spans):
        shared = min(overlap, limit - (b - a), a) if i else 0
        level = 5 if any(s < a < e for s, e in runs) else level
        out.append((a - shared, b, shared, LEVELS[level] if i else "start"))
    return out


def pieces(df: DataFrame, id_col: str = "id", text_col: str = "content", limit: int = 1000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Rows ``record_id, piece, start, length, shared, boundary[, text]`` of every text
    over the limit. Rows of one id are copies of one delivery unless their texts differ."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["record_id"], batch["text"]):
                for i, (a, b, shared, boundary) in enumerate(split(text, limit, overlap)):
                    rows.append((key, i, a, b - a, shared, boundary, text[a:b]) if with_text else (key, i, a, b - a, shared, boundary))
            yield pd.DataFrame(rows, columns=names)

    schema = "record_id string, piece int, start int, length int, shared int, boundary string" + (", text string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = df.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where(F.char_length("text") > limit)
    return rows.mapInPandas(run, schema)


def cut_kinds(df: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """``record_id, cut_kind`` of every text over the limit: ``forced`` if it had to be cut inside a run, else ``natural``."""
    cuts = pieces(df, limit=limit, overlap=overlap, with_text=False)
    forced = F.max(F.col("boundary") == "forced")
    return cuts.groupBy("record_id").agg(F.when(forced, "forced").otherwise("natural").alias("cut_kind"))
