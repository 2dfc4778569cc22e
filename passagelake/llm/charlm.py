"""A character n-gram model: counted by Spark, modified Kneser-Ney, sorted key arrays.

Symbols are 12 bits wide: code points below ``DIRECT`` as they are, all others as two
symbols (a lead and 12 bits more), so no two characters are one to the model and five
symbols pack into one 64-bit key without loss. Every task
counts the keys of its texts by sorting; Spark adds the counts up, derives the lower
orders' continuation counts, the discounts and the interpolated probabilities
with DataFrame operations. The model is a file of sorted keys with log probabilities
and back-off weights: every counted n-gram has its own entry and a look-up compares
whole keys, so an n-gram that was not counted always backs off. The file grows with
the number of distinct n-grams (12 bytes each and by context). It is written to the
shared folder part by part; Spark has each executor fetch it once, and the workers map it.
"""

from __future__ import annotations

import mmap
import os
import re
import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, create_file, new_path, written

ORDER = 5
SYMBOL_BITS = 12
SYMBOLS = 1 << SYMBOL_BITS
#: From here on code points take two symbols, the first of them a lead from here on.
DIRECT = SYMBOLS - (0x10FFFF >> SYMBOL_BITS) - 1
#: Keys that a task holds before it merges them.
HELD = 3_000_000
#: Entries of the model in one row on their way to the driver.
PACKED = 1 << 18

_MASK = SYMBOLS - 1
_SPACES = re.compile(r"\s+")


def symbols(code_points: np.ndarray) -> np.ndarray:
    """12-bit symbols of code points, one or two each; 0 is the padding before a text."""
    cp = code_points.astype(np.int64)
    high = cp >= DIRECT
    if not high.any():
        return cp
    at = np.arange(len(cp)) + np.cumsum(high) - high
    out = np.empty(len(cp) + int(high.sum()), np.int64)
    more = cp - DIRECT
    out[at] = np.where(high, DIRECT + (more >> SYMBOL_BITS), cp)
    out[at[high] + 1] = more[high] & _MASK
    return out


def squeeze(text: str) -> str:
    """White space to one space, digits to 0: what the model reads by default."""
    return _DIGITS.sub("0", _SPACES.sub(" ", text))


_DIGITS = re.compile(r"[0-9]")


def packed(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths): the key at each symbol holds it and the order - 1 symbols
    before it; lengths in symbols."""
    pad = "\0" * (order - 1)
    cp = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols(cp)
    lengths = np.array([len(t) for t in texts], np.int64)
    if len(s) > len(cp):  # characters of two symbols
        double = np.concatenate([[0], np.cumsum(cp >= DIRECT)])
        begin = np.cumsum(lengths + order - 1) - lengths
        lengths = lengths + double[begin + lengths] - double[begin]
    n = len(s) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), lengths
    keys = np.zeros(n, np.int64)
    for i in range(order):
        keys = keys << SYMBOL_BITS | s[i : i + n]
    # windows that end in the padding between two texts are dropped
    starts = np.cumsum(lengths + order - 1) - lengths - (order - 1)
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, starts, 1)
    np.add.at(keep, np.minimum(starts + lengths, n), -1)
    return keys[np.cumsum(keep)[:-1] > 0], lengths


def key_blocks(texts: list[str], order: int = ORDER, most: int = 1 << 20):
    """(keys, text number of each key) in blocks of about ``most`` characters, so that
    neither many texts nor a very long one take much memory."""
    group: list[int] = []
    size = 0

    def block():
        keys, lengths = packed([texts[i] for i in group], order)
        return keys, np.repeat(np.array(group, np.int64), lengths)

    for i, text in enumerate(texts):
        if len(text) > most:
            for at in range(0, len(text), most):
                low = max(0, at - order + 1)
                before = at - low + sum(ord(c) >= DIRECT for c in text[low:at])
                keys = packed([text[low : at + most]], order)[0][before:]
                yield keys, np.full(len(keys), i, np.int64)
            continue
        group.append(i)
        size += len(text)
        if size >= most:
            yield block()
            group, size = [], 0
    if group:
        yield block()


def _count_keys(keys: np.ndarray, counts: np.ndarray | None = None):
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counting(prepare, order: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            return _count_keys(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        for batch in batches:
            texts = [prepare(t or "") for t in batch.column(0).to_pylist()]
            for keys, _ in key_blocks(texts, order):
                k, c = _count_keys(keys)
                if len(k):
                    held.append((k, c))
                    size += len(k)
            if size > HELD:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD // 2:  # a partial sum leaves the task; Spark adds it up
                    yield _key_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _key_batch(*merged())

    return run


def _key_batch(keys, counts):
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], ["key", "n"])


def count_ngrams(docs: DataFrame, prepare=squeeze, order: int = ORDER) -> DataFrame:
    """(key, n) over the whole texts of all rows."""
    bounded_batches(docs.sparkSession)
    part = docs.select(F.col("text").cast("string")).mapInArrow(_counting(prepare, order), "key bigint, n bigint")
    return part.groupBy("key").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the counts of counts."""
    got = {r["n"]: r["m"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    n1, n2, n3, n4 = (got.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def _packed_rows(batches):
    """Rows (t, first key, entries, keys, values) of bytes from sorted rows (t, key, v)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at, size = -1, 0

    def row():
        keys, values = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(keys[0])], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["t", "first", "n", "keys", "vals"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(t)) + 1).tolist(), len(t)]
        keys, values = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and (int(t[lo]) != at or size >= PACKED):
                yield row()
                held, size = [], 0
            at = int(t[lo])
            held.append((keys[lo:hi].copy(), values[lo:hi].copy()))
            size += hi - lo
    if held:
        yield row()


def _model_file(tables: list[DataFrame]) -> tuple[str, list[tuple[int, int, int]]]:
    """The tables (key, v), sorted, in one file that every executor gets: its name, and
    the places of the keys and of the values and the number of entries by table. One
    job sorts and packs them; the packed rows pass the driver a few at a time on their way
    to the file in the shared folder, first all keys, then all values."""
    spark = tables[0].sparkSession
    rows = None
    for i, x in enumerate(tables):
        x = x.select(F.lit(i).alias("t"), "key", "v")
        rows = x if rows is None else rows.unionByName(x)
    packed = written(rows.sort("t", "key").mapInArrow(_packed_rows, "t int, first bigint, n bigint, keys binary, vals binary"), "model")
    sizes = [0] * len(tables)
    for r in packed.groupBy("t").agg(F.sum("n").alias("n")).collect():
        sizes[r["t"]] = r["n"]
    total, before, places = sum(sizes), 0, []
    for n in sizes:
        places.append((8 * before, 8 * total + 4 * before, n))
        before += n
    folder, name = new_path(spark, "ngrams"), f"ngrams-{uuid.uuid4().hex}.bin"
    with create_file(folder, name) as out:
        for column in ("keys", "vals"):
            for r in packed.select("t", "first", column).sort("t", "first").toLocalIterator():
                out.write(r[column])
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name, places


class NgramModel:
    """Per order: sorted keys with log2 probabilities; per context length: sorted keys
    with log2 back-off weights; ``unseen`` is for symbols never counted. ``probs`` and
    ``backs`` say where the tables lie in the shared file ``name``."""

    def __init__(self, order: int, name: str, probs, backs, unseen: float = -float(SYMBOL_BITS)):
        self.order, self.name, self.probs, self.backs, self.unseen = order, name, probs, backs, unseen
        self._mapped = self._views = None

    def __getstate__(self):
        return {**self.__dict__, "_mapped": None, "_views": None}

    def _tables(self):
        if self._mapped is None:
            with open(SparkFiles.get(self.name), "rb") as f:
                size = os.fstat(f.fileno()).st_size
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
            self._mapped = [[(np.frombuffer(data, np.int64, n, keys), np.frombuffer(data, np.float32, n, values)) if n else None for keys, values, n in places] for places in (self.probs, self.backs)]
        return self._mapped

    @staticmethod
    def _look_up(table, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``, NaN for those without an entry."""
        if table is None:
            return np.full(len(keys), np.nan)
        entries, values = table
        at = np.searchsorted(entries, keys)
        at[at == len(entries)] = 0
        return np.where(entries[at] == keys, values[at], np.nan).astype(np.float64)

    def log2_probs(self, keys: np.ndarray) -> np.ndarray:
        """log2 P(last symbol | the symbols before it) of packed keys."""
        if len(keys) > 64:  # keys repeat, and sorted ones are found faster
            keys, inverse = np.unique(keys, return_inverse=True)
            return self._log2_probs(keys)[inverse]
        return self._log2_probs(keys)

    def _log2_probs(self, keys: np.ndarray) -> np.ndarray:
        probs, backs = self._tables()
        out = self._look_up(probs[self.order - 1], keys)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            weight = np.zeros(len(rest))
            at = keys[rest]
            for k in range(self.order - 1, 0, -1):
                back = self._look_up(backs[k - 1], at >> SYMBOL_BITS)
                weight = weight + np.where(np.isnan(back), 0, back)
                at = at & ((1 << SYMBOL_BITS * k) - 1)
                p = self._look_up(probs[k - 1], at)
                if k == 1:
                    p = np.where(np.isnan(p), self.unseen, p)
                hit = ~np.isnan(p)
                out[rest[hit]] = (weight + p)[hit]
                rest, weight, at = rest[~hit], weight[~hit], at[~hit]
                if not len(rest):
                    break
        return out

    def log2_prob(self, key: int) -> float:
        """:meth:`log2_probs` of one key."""
        if self._views is None:
            view = lambda table: (memoryview(table[0]), memoryview(table[1])) if table else ((), ())
            self._views = [[view(t) for t in tables] for tables in self._tables()]
        probs, backs = self._views
        weight = 0.0
        for k in range(self.order, 0, -1):
            key &= (1 << SYMBOL_BITS * k) - 1
            entries, values = probs[k - 1]
            at = bisect_left(entries, key)
            if at < len(entries) and entries[at] == key:
                return weight + values[at]
            if k > 1:
                entries, values = backs[k - 2]
                at = bisect_left(entries, key >> SYMBOL_BITS)
                if at < len(entries) and entries[at] == key >> SYMBOL_BITS:
                    weight += values[at]
        return weight + self.unseen

    def text_bits(self, texts: list[str]) -> np.ndarray:
        """Bits of each text."""
        out = np.zeros(len(texts))
        for keys, owners in key_blocks(texts, self.order):
            out += np.bincount(owners, -self.log2_probs(keys), len(texts))
        return out


def kneser_ney(counts: DataFrame, order: int = ORDER) -> NgramModel:
    """The model of an n-gram table (key, n) as :func:`count_ngrams` gives it; the
    table should be written, since each order reads it. Every order's counts, context
    sums and probabilities are written too, so that no order computes another again.
    """
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        mask = (1 << SYMBOL_BITS * k) - 1
        tables[k] = written(tables[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(mask).cast("bigint")).alias("key")).agg(F.count(F.lit(1)).alias("n")), f"ngrams-{k}")
    probs, backs, below, unseen = [], [], None, -float(SYMBOL_BITS)
    for k in range(1, order + 1):
        t = tables[k]
        d1, d2, d3 = _discounts(t)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        t = t.withColumn("context", F.shiftright("key", SYMBOL_BITS))
        stats = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("mass"))
        stats = written(stats.select("context", "total", (F.col("mass") / F.col("total")).alias("back")), f"contexts-{k}")
        joined = t.join(stats, "context")
        own = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        if k == 1:
            p = own + F.col("back") / SYMBOLS
            free = stats.select(F.log2("back").alias("b")).first()
            unseen += float(free["b"]) if free else 0.0
        else:
            mask = (1 << SYMBOL_BITS * (k - 1)) - 1
            joined = joined.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask).cast("bigint"))).join(below.select(F.col("key").alias("suffix"), F.col("p").alias("low")), "suffix")
            p = own + F.col("back") * F.col("low")
        below = written(joined.select("key", p.alias("p")), f"probabilities-{k}")
        probs.append(below.select("key", F.log2("p").cast("float").alias("v")))
        if k > 1:
            backs.append(stats.select(F.col("context").alias("key"), F.log2("back").cast("float").alias("v")))
    name, places = _model_file([*probs, *backs])
    return NgramModel(order, name, places[:order], places[order:], unseen)
