"""Splitting oversized texts at natural boundaries, by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint, halves that still
exceed the limit less the overlap are cut again, and each piece but the first then gets the last
characters before it as overlap. Near means the middle half; boundaries weaker than the text needs
are not used, so that one with fitting requirement units is cut at units only. Texts within the
limit never leave the JVM.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3_600, 200
#: Boundary strengths, strongest first.
CUTS = ("structural", "paragraph", "sentence", "hard_max")
# What begins a requirement unit at the start of a line (a dotted clause number
# with a first part of 1 to 19, a lettered item, a requirement id).
UNIT = regex.compile(
    r"[^\S\n]*(?:(?:[1-9]|1[0-9])(?:\.[0-9]{1,3})+\.?(?=\s|$)|[a-z][.)](?=\s)|[a-z][a-z0-9]*(?:[-‐‑–—.][a-z0-9]+)*_[0-9]{4,}\b)",
    regex.I,
)
SENTENCE_END = regex.compile(r"[.!?](?=\s)")


def boundaries(s: str) -> list[list[int]]:
    """Positions where a piece may begin, for each strength but the last."""
    lines = [0]
    at = s.find("\n")
    while at >= 0:
        lines.append(at + 1)
        at = s.find("\n", at + 1)
    units = [p for p in lines if UNIT.match(s, p)]
    ends = sorted({*lines, *(m.end() for m in SENTENCE_END.finditer(s))})
    return [units, lines, ends]


def _bounds(s: str, a: int, b: int) -> tuple[int, int]:
    """The stretch without white space at its ends."""
    while b > a and s[b - 1].isspace():
        b -= 1
    while a < b and s[a].isspace():
        a += 1
    return a, b


def pieces(s: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(overlap begins, piece begins, piece ends, how the piece was ended) in order; the end of the text ends the last as 'end'."""
    core = limit - overlap
    marks = boundaries(s)
    out: list[tuple[int, int, int, str]] = []
    todo: list[tuple[int, int, str]] = [(0, len(s), "end")]
    while todo:
        a, b, how = todo.pop()
        a, b = _bounds(s, a, b)
        if b - a <= core:
            if b > a:
                out.append((max(0, a - overlap) if out else a, a, b, how))
            continue
        at, strength = _cut(s, marks, a, b, core)
        todo.append((at, b, how))
        todo.append((a, at, CUTS[strength]))
    return out


def _cut(s: str, marks: list[list[int]], a: int, b: int, core: int) -> tuple[int, int]:
    """Where to cut a stretch that is too long, and the strength of the boundary there."""
    middle, inside = (a + b) // 2, []
    for positions in marks:
        # a cut must leave something on both sides
        inside.append(positions[bisect_right(positions, a) : bisect_left(positions, b)])
    near = lambda p: (abs(p - middle), p)
    # the weakest boundaries that are needed: with these every piece can be made to fit
    needed = next((k for k, p in enumerate(inside) if all(y - x <= core for x, y in (_bounds(s, *e) for e in zip([a, *p], [*p, b])))), len(marks))
    for k, positions in enumerate(inside[: needed + 1]):
        lo, hi = bisect_left(positions, (3 * a + b) // 4), bisect_right(positions, (a + 3 * b) // 4)
        if lo < hi:
            return min(positions[lo:hi], key=near), k
    if needed < len(marks):
        return min(inside[needed], key=near), needed
    # as few pieces as the limit allows, of equal size
    count = -(-(b - a) // core)
    return a + (b - a) * (count // 2) // count, needed


_SCHEMA = "key string, piece_no long, begins long, ends long, text string, cut string, record_cut string"


def _run(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = pieces(s, limit, overlap)
                weakest = CUTS[max(CUTS.index(p[3]) for p in found if p[3] != "end")] if len(found) > 1 else None
                rows += [(key, i, a, e, s[o:e], cut, weakest) for i, (o, a, e, cut) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["key", "piece_no", "begins", "ends", "text", "cut", "record_cut"])

    return run


def split_oversized(rows: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece_no, begins, ends, text, cut, record_cut: the pieces of every text of more than ``limit`` characters.

    A piece is at most ``limit`` characters: up to ``limit - overlap`` of its own (``begins`` to
    ``ends`` in the text) after up to ``overlap`` that repeat what stands before it. ``cut`` says
    at what it was ended, 'end' for the last; ``record_cut`` is the weakest cut of the text. Every
    character but white space at cuts is in a piece. Null and short texts give no row; texts in
    the result are whole, however long.
    """
    t = F.col(f"`{text}`")
    big = rows.select(F.col(f"`{key}`").cast("string").alias("key"), t.alias("text")).where(F.length("text") > limit)
    return big.mapInArrow(_run(limit, overlap), _SCHEMA)
