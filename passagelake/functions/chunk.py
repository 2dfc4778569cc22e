"""Overlapping chunks by a hierarchy of separators, with exact offsets.

Pieces are spans of the text, so a chunk knows where it stands. A piece keeps its
separator at its end. A span that is too long for its separator is cut by the next
one; spans that fit are packed greedily, and a new chunk begins with as many whole
spans of the last one as fit the overlap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Paragraph, line, sentence ends, word, character.
SEPARATORS = ("\n\n", "\n", "।", "?", "!", " ", "")

Span = tuple[int, int]


def _cut(text: str, span: Span, separator: str) -> list[int]:
    """The ends of pieces that end with the separator; the last may lack it."""
    lo, hi = span
    if not separator:
        return list(range(lo + 1, hi + 1))
    n = len(separator)
    ends = list(accumulate([len(x) + n for x in text[lo:hi].split(separator)], initial=lo))[1:]
    ends[-1] -= n
    if ends[-1] == (ends[-2] if len(ends) > 1 else lo):
        ends.pop()
    return ends


def _pack(lo: int, ends: list[int], size: int, overlap: int) -> list[Span]:
    """Runs of neighbouring pieces of at most ``size`` characters; the pieces begin at ``lo`` and
    end at ``ends``. Only ends of runs are looked at, found by bisection."""
    out: list[Span] = []
    starts = [lo, *ends[:-1]]
    first, n = 0, len(ends)  # the run is pieces first:i
    while first < n:
        i = max(bisect_right(ends, starts[first] + size, first), first + 1)
        out.append((starts[first], ends[i - 1]))
        if i == n:
            break
        # pieces go from the front until the rest fits the overlap and, with the next piece, the size
        least = max(ends[i - 1] - overlap, ends[i] - size)
        first = min(bisect_left(starts, least, first, i), i)
    return out


def spans_of(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, span: Span | None = None) -> list[Span]:
    """The spans of all chunks, unstripped."""
    lo, hi = span or (0, len(text))
    at = next((i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0), len(separators) - 1)
    rest = separators[at + 1 :]
    out: list[Span] = []
    ends = _cut(text, (lo, hi), separators[at])
    begin, done = lo, 0  # of the pieces that are not packed yet
    before = lo
    for i, end in enumerate(ends):
        if end - before >= size:
            if done < i:
                out += _pack(begin, ends[done:i], size, overlap)
            out += spans_of(text, size, overlap, rest, (before, end)) if rest else [(before, end)]
            begin, done = end, i + 1
        before = end
    return out + (_pack(begin, ends[done:], size, overlap) if done < len(ends) else [])


def split_text(text: str | None, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk): stripped, non-blank chunks with their exact offsets."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    out = []
    for lo, hi in spans_of(text or "", size, overlap):
        raw = text[lo:hi]
        chunk = raw.strip()
        if chunk:
            out.append((lo + len(raw) - len(raw.lstrip()), chunk))
    return out


def searched_starts(text: str, chunks: list[str], overlap: int) -> list[int]:
    """Offsets by searching each chunk after the last one (compatibility)."""
    out, before, length = [], 0, 0
    for i, chunk in enumerate(chunks):
        before = text.find(chunk, max(0, before + length - overlap) if i else 0)
        length = len(chunk)
        out.append(before)
    return out


def split_column(text: Column, size: int, overlap: int, searched: bool = False) -> Column:
    """array of (pos, start, text), pos from 1."""

    @arrow_udf("array<struct<pos:int,start:int,text:string>>")
    def split(texts: pa.Array) -> pa.Array:
        ends, places, starts, chunks = [0], [], [], []
        for t in texts:
            body = t.as_py()
            found = split_text(body, size, overlap)
            places += range(1, len(found) + 1)
            starts += searched_starts(body or "", [c for _, c in found], overlap) if searched else [s for s, _ in found]
            chunks += [c for _, c in found]
            ends.append(len(chunks))
        parts = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(starts, pa.int32()), pa.array(chunks, pa.string())], ["pos", "start", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    return split(text)
