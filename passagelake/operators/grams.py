"""Where keywords occur, for keyword sets of any size.

A keyword can only occur in a text that has all its grams (``GRAM`` code points; a shorter
keyword is its own gram). Grams of keywords are counted over the texts first. A keyword with
a gram that no text has is done with; every other one is represented by its rarest gram, and
is joined with the texts that have that gram. Only these pairs are compared in full.

Keywords and texts are tables throughout. Texts are looked at twice by grams; a filter of
fixed size (``FILTER_BITS``) keeps grams that no keyword has from being sent at all. The
filter is all that passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files

GRAM = 8
FILTER_BITS = 1 << 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def hashes(text: str, size: int) -> np.ndarray:
    """The grams of a text as hashes, in order; the size is part of them."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = h * _BASE + points[j : j + n] + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h.view(np.int64)


def grams(text: str, size: int) -> np.ndarray:
    """The different grams of a text."""
    return np.unique(hashes(text, size))


def passes(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = gram & ((len(bits) << 6) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def _filter(table: DataFrame) -> np.ndarray:
    """The bits of the grams in ``table``, 64 to a word."""
    bit = F.col("gram").bitwiseAND(FILTER_BITS - 1)
    words = table.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _keyword_grams(keywords: DataFrame) -> DataFrame:
    """(keyword, gram): all grams of each keyword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [grams(w, min(GRAM, len(w))) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(words, object), [len(f) for f in found]), pa.string()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["keyword", "gram"])

    return keywords.select("keyword").mapInArrow(run, "keyword string, gram bigint")


def _text_grams(bodies: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(key, gram): the grams of each text that pass the filter."""
    shared = bodies.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for size in sizes:
                    g = hashes(body, size)
                    g = np.unique(g[passes(shared.value, g)])
                    keys += [key] * len(g)
                    found.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["key", "gram"])

    return files.bounded(bodies).select("key", "text").mapInArrow(run, "key string, gram bigint")


def occurrences(keywords: DataFrame, bodies: DataFrame) -> DataFrame:
    """(keyword, and the columns of ``bodies`` but text, n): how often each keyword occurs in
    each text, not overlapping, where it does. ``keywords`` is (keyword), different and not
    empty; ``bodies`` has a column text without nulls."""
    names = [c for c in bodies.columns if c != "text"]
    keyed = bodies.withColumn("key", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in bodies.columns]), 256))
    every = files.kept(_keyword_grams(keywords), "keyword-grams")
    sizes = [r["n"] for r in keywords.select(F.least(F.char_length("keyword"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM values at most
    counts = _text_grams(keyed, sizes, _filter(every)).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = every.join(counts, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count(F.lit(1)).alias("all"), F.count("n").alias("met"))
    rarest = files.kept(rated.where(F.col("all") == F.col("met")).select("keyword", "gram"), "rarest")
    pairs = _text_grams(keyed, sizes, _filter(rarest)).join(rarest, "gram").select("key", "keyword").distinct()
    hits = keyed.join(pairs, "key").withColumn("n", ((F.char_length("text") - F.char_length(F.replace("text", "keyword"))) / F.char_length("keyword")).cast("bigint"))
    return hits.where("n > 0").select("keyword", *names, "n")
