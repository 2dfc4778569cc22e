"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edits.

Texts are compared as lower-case words (ASCII letters folded, runs of other ASCII
characters one space). A document holds an item if a stretch of it that begins and
ends at word boundaries lies within :func:`limit` edits of the item. One formula sets
the limit for all lengths: ``accept`` (15 %) of the bytes beyond the first
``FLOOR`` (20), so short items must be closer and items of less than 27 bytes exact.

1. Gate: each item votes by the rarest quarter of its 5-byte grams (rare among the items
   of its block), 16 at least. By the q-gram lemma a stretch within the limit keeps a
   known share of the item's grams; a place is kept for an item if its window has three
   fifths of that share of the votes. Unlike grams of whole words, 5-byte grams survive
   edits as dense as the limit allows.
2. At the starts that remain (word starts, and every character boundary next to or
   inside non-ASCII characters, since not every script parts its words), a window of
   the item's size is embedded by the CGK random walk: coordinate j is the current
   byte, and a random function of (j, byte) says whether to step on. Edit distance
   becomes Hamming distance.
3. Bit sampling: several walks, each with several samples of a few coordinates. A
   window that agrees with an item in all coordinates of one sample is a candidate.
   The README has the measured recall by rate of edits up to the limit.
4. Candidates that keep as many of all the item's grams as the lemma asks for (no
   loss) are verified by exact edit distance (bit-parallel, free ends), and their ends
   moved to the nearest word boundaries.
5. Verbatim copies are found apart from all this, wherever they begin: one gram of
   each item is looked for, and the bytes around it are compared.

The items are the query set: they go to the workers in blocks of bounded size, each
block against all documents. Documents never meet each other, so no key can be hot.

Defined cases: null or empty documents hold nothing; null or empty items match
nothing; repeated items match each on its own; repeated rows repeat; empty tables give
empty results; extra columns pass through :func:`without_items`. Between characters of
scripts without spaces between words every place is a word boundary.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_buffers

ACCEPT = 0.15
FLOOR = 20
Q = 5
CLASSES = 16
WALKS = 4
SAMPLES = 16
COORDINATES = 4
#: Bytes of items in one block.
BLOCK = 128 << 10
_TABLE_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The share of an item's grams that votes, and the share of the votes that a copy at the
#: limit keeps on average that a window needs.
VOTING = 0.25
NEEDED = 0.6


def limit(size: int, accept: float = ACCEPT) -> int:
    """Edits by which a stretch may differ from an item of ``size`` bytes."""
    return max(0, int(accept * (size - FLOOR)))


_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalised(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, document offsets in them, place of each byte in ``raw``). Every
    document begins and ends without space and is followed by one zero byte."""
    n = len(raw)
    x = _FOLD[raw]
    space = x == 32
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    starts = offs[:-1][offs[:-1] < offs[1:]]
    before[starts] = True
    keep = ~(space & before)
    places = np.flatnonzero(keep)
    x = x[places]
    docs = np.searchsorted(places, offs)
    # a last space of a document goes
    ends = docs[1:][docs[1:] > docs[:-1]] - 1
    last = ends[x[ends] == 32]
    stay = np.ones(len(x), bool)
    stay[last] = False
    x, places = x[stay], places[stay]
    docs = np.searchsorted(places, offs)
    # one zero after each document
    cuts = docs[1:]
    out = np.insert(x, cuts, 0)
    where = np.insert(places, cuts, -1)
    return out, docs + np.arange(len(docs)), where


def normalise_one(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, offs, _ = normalised(raw, np.array([0, len(raw)], np.int64))
    return out[: offs[1] - 1].tobytes()


#: Thai to Myanmar, Khmer, kana and Han: no spaces between words.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _in_word(ch: str) -> bool:
    return ch.isalnum() or unicodedata.category(ch)[0] == "M"


def word_boundary(data: bytes, at: int) -> bool:
    """Whether a word may end before byte ``at`` (a character's first) and one begin."""
    if at == 0 or data[at - 1] in b"\0 " or data[at] in b"\0 ":
        return True
    low = at - 1
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    before = data[low:at].decode("utf-8", "replace")[-1]
    after = data[at : at + 4].decode("utf-8", "replace")[0]
    if _SPACELESS.match(before) or _SPACELESS.match(after):
        return True
    return not (_in_word(before) and _in_word(after))


def gram_slots(x: np.ndarray) -> np.ndarray:
    """A table slot for the Q bytes at each place of ``x``."""
    padded = np.zeros(len(x) + 8, np.uint8)
    padded[: len(x)] = x
    v = np.ndarray((len(x),), np.uint64, buffer=padded, strides=(1,))
    return ((v << np.uint64(64 - 8 * Q)) * _MIX) >> np.uint64(64 - _TABLE_BITS)


def walk(x: np.ndarray, at: np.ndarray, size: int, wanted: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """CGK: the coordinates ``wanted`` (sorted) of the windows of ``size`` bytes at
    ``at``, one row per window; beyond the window all bytes are 0. ``moves[j, byte]`` is
    0 or 1. ``x`` reaches past every window by a byte at least."""
    out = np.zeros((len(wanted), len(at)), np.uint8)
    i, end = at.copy(), at + size
    k = 0
    for j in range(int(wanted[-1]) + 1 if len(wanted) else 0):
        c = x[i]
        if j >= size:  # a walk may have left its window
            c[i >= end] = 0
        while k < len(wanted) and wanted[k] == j:
            out[k] = c
            k += 1
        i += moves[j][c]
        if j >= size:
            np.minimum(i, end, out=i)
    return out


class ItemClass:
    """Items (number in the block, text) of like lengths with their LSH tables."""

    def __init__(self, items: list[tuple[int, bytes]], seed: int):
        self.items = items
        self.least, self.most = min(len(t) for _, t in items), max(len(t) for _, t in items)
        rng = np.random.default_rng(seed)
        self.steps = self.least
        self.walks = []
        x = np.zeros(sum(len(t) + 1 for _, t in items) + self.most, np.uint8)
        at, places = 0, []
        for _, t in items:
            x[at : at + len(t)] = np.frombuffer(t, np.uint8)
            places.append(at)
            at += len(t) + 1
        for _ in range(WALKS):
            moves = rng.integers(0, 2, (self.steps, 256)).astype(np.int32)
            picks = [np.sort(rng.choice(self.steps, min(COORDINATES, self.steps), replace=False)) for _ in range(SAMPLES)]
            wanted = np.unique(np.concatenate(picks))
            rows = [np.searchsorted(wanted, p) for p in picks]
            got = walk(x, np.array(places, np.int32), self.least, wanted, moves)
            tables = []
            for r in rows:
                keys = self.keys(got, r)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order))
            self.walks.append((moves, wanted, rows, tables))

    @staticmethod
    def keys(coordinates: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = np.zeros(coordinates.shape[1], np.uint64)
        for r in rows:
            key = key << np.uint64(8) | coordinates[r]
        return key

    def candidates(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """window * number of items + item of windows that share a sample with an item,
        by their numbers in ``at`` and ``items``; sorted."""
        n, found = len(self.items), []
        for moves, wanted, rows, tables in self.walks:
            got = walk(x, at, self.least, wanted, moves)
            for r, (keys, order) in zip(rows, tables):
                mine = self.keys(got, r)
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                size = hi - lo
                w = np.repeat(np.arange(len(at)), size)
                k = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                found.append(np.unique(w * n + order[k]))
        return np.unique(np.concatenate(found))


def best_match(item: bytes, text: bytes, free: bool = True) -> tuple[int, int]:
    """(edits, end) of the stretch of ``text`` nearest to ``item`` (first of equals):
    bit-parallel dynamic programming with a free start. With ``free`` off the edits
    are those to the whole of ``text``."""
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up ^ up) | eq
        plus = down | ~(xh | up) & mask
        minus = up & xh
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1 | (not free)) & mask, minus << 1 & mask
        up = minus | ~(xv | plus) & mask
        down = plus & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if free else (score, len(text))


def match(item: bytes, text: bytes) -> tuple[int, int, int]:
    """(edits, start, end) of the nearest stretch."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    edits, end = best_match(item, text)
    _, back = best_match(item[::-1], text[:end][::-1])
    return edits, end - back, end


def at_boundaries(item: bytes, data: bytes, lo: int, hi: int, edits: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch whose ends are the word boundaries nearest to
    ``lo`` and ``hi``, inside or outside, with the fewest edits; None beyond ``most``."""

    def near(at: int) -> list[int]:
        if word_boundary(data, at):
            return [at]
        out = []
        for step in (-1, 1):
            to = at
            while abs(to - at) <= most:
                to += step
                if data[to] & 0xC0 != 0x80 and word_boundary(data, to):
                    out.append(to)
                    break
        return out

    starts, ends = near(lo), near(hi)
    if starts == [lo] and ends == [hi]:
        return (edits, lo, hi) if edits <= most else None
    found = [(best_match(item, data[a:b], False)[0], a, b) for a in starts for b in ends if a < b]
    best = min(found, default=None)
    return best if best and best[0] <= most else None


class Block:
    """A block of items (id, text), ready to be searched for."""

    def __init__(self, items: list[tuple[int, str | None]], accept: float = ACCEPT):
        pairs = [(i, t) for i, t in ((i, normalise_one(t)) for i, t in items) if t]
        pairs.sort(key=lambda x: len(x[1]))
        self.items = pairs
        self.most = np.array([limit(len(t), accept) for _, t in pairs], np.int64)
        grams = [gram_slots(np.frombuffer(t, np.uint8))[: max(0, len(t) - Q + 1)] for _, t in pairs]
        self.grams = [np.sort(g) for g in grams]
        #: Items that have a slot.
        spread = np.zeros(1 << _TABLE_BITS, np.int32)
        for g in grams:
            spread[np.unique(g)] += 1
        # items that may differ: classes, and votes by (slot, item)
        near = [i for i in range(len(pairs)) if self.most[i]]
        groups: list[list[tuple[int, bytes]]] = [[]]
        ratio = max(1.12, (len(pairs[near[-1]][1]) / len(pairs[near[0]][1])) ** (1 / CLASSES) + 1e-9) if near else 1.0
        for i in near:
            if groups[-1] and len(pairs[i][1]) > ratio * len(groups[-1][0][1]) and len(groups) < CLASSES:
                groups.append([])
            groups[-1].append((i, pairs[i][1]))
        self.classes = [ItemClass(g, 17 + i) for i, g in enumerate(groups) if g]
        self.need = np.ones(len(pairs), np.int64)
        self.window = np.array([len(t) + most + 1 for (_, t), most in zip(pairs, self.most)], np.int64)
        voters, slots = [], []
        for i in near:
            g = np.unique(grams[i])
            chosen = g[np.argsort(spread[g], kind="stable")][: max(16, int(VOTING * len(g)))]
            kept = max(0.0, 1 - Q * self.most[i] / len(grams[i]))
            self.need[i] = max(1, int(NEEDED * kept * len(chosen)))
            slots.append(chosen)
            voters.append(np.full(len(chosen), i, np.int32))
        slots = np.concatenate(slots) if slots else np.empty(0, np.uint64)
        order = np.argsort(slots, kind="stable")
        self.voters = np.concatenate(voters)[order] if voters else np.empty(0, np.int32)
        #: The votes of slot s are voters[first[s]:first[s + 1]].
        self.first = np.searchsorted(slots[order], np.arange((1 << _TABLE_BITS) + 1)).astype(np.int32)
        self.votes = np.diff(self.first).astype(np.uint16)
        # verbatim: (slot, its place, first slot, last slot, item number), the rarest gram;
        # items without a gram are searched for as they are
        self.anchors, self.short = [], []
        self.anchored = np.zeros(1 << _TABLE_BITS, bool)
        for i, g in enumerate(grams):
            if not len(g):
                self.short.append(i)
                continue
            place = int(np.argmin(spread[g]))
            self.anchors.append((g[place], place, g[0], g[-1], i))
            self.anchored[g[place]] = True

    def _verbatim(self, data: bytes, slots: np.ndarray, note) -> None:
        """Exact copies, wherever they begin."""
        hits = np.flatnonzero(self.anchored[slots])
        order = np.argsort(slots[hits], kind="stable")
        hits = hits[order]
        found = slots[hits]
        for slot, place, first, last, i in self.anchors:
            lo, hi = np.searchsorted(found, slot), np.searchsorted(found, slot, "right")
            if lo == hi:
                continue
            t = self.items[i][1]
            at = hits[lo:hi] - place
            at = at[(at >= 0) & (at + len(t) <= len(slots))]
            at = at[(slots[at] == first) & (slots[at + len(t) - Q] == last)]
            for a in at.tolist():
                if data.startswith(t, a):
                    note(i, 0, a, a + len(t))
        for i in self.short:
            t = self.items[i][1]
            at = data.find(t)
            while at >= 0:
                note(i, 0, at, at + len(t))
                at = data.find(t, at + 1)

    def gate(self, slots: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item, starts) for items with enough votes in some window."""
        size = self.votes[slots]
        places = np.flatnonzero(size)
        if not len(places):
            return []
        size = size[places].astype(np.int64)
        place = np.repeat(places, size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[slots[places]].astype(np.int64), size)
        item = self.voters[at]
        order = np.argsort(item.astype(np.uint16) if len(self.items) < 1 << 16 else item, kind="stable")
        item, place = item[order], place[order]
        out = []
        bounds = np.searchsorted(item, np.arange(len(self.items) + 1))
        for i in np.flatnonzero(np.diff(bounds) >= self.need):
            hits, n, window = place[bounds[i] : bounds[i + 1]], int(self.need[i]), int(self.window[i])
            close = hits[n - 1 :] - hits[: len(hits) - n + 1] < window
            if not close.any():
                continue
            begin = np.searchsorted(starts, hits[n - 1 :][close] - window + 1)
            end = np.searchsorted(starts, hits[: len(hits) - n + 1][close], "right")
            begin[1:] = np.maximum(begin[1:], end[:-1])  # both ascend: what is new to each
            size = np.maximum(end - begin, 0)
            mine = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            if len(mine):
                out.append((int(i), mine))
        return out

    def may_hold(self, i: int, slots: np.ndarray) -> bool:
        """The q-gram lemma for one item over the grams of a stretch."""
        g = self.grams[i]
        found = g[np.minimum(np.searchsorted(g, slots), len(g) - 1)] == slots
        return int(np.count_nonzero(found)) >= len(g) - Q * int(self.most[i])

    def search(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, edits, first and last byte + 1 in the row's text): the best
        stretch for each row and item."""
        x, docs, where = normalised(raw, offs)
        out: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        data = x.tobytes()

        def note(i, edits, lo, hi):
            found = at_boundaries(self.items[i][1], data, lo, hi, edits, int(self.most[i]))
            if found is None:
                return
            edits, lo, hi = found
            key = int(np.searchsorted(docs, lo, "right")) - 1, self.items[i][0], i
            old = out.get(key)
            if old is None or (edits, lo) < old[:2]:
                out[key] = (edits, lo, hi)

        if self.items and len(x) > 1:
            slots = gram_slots(x)
            self._verbatim(data, slots, note)
            if self.classes:
                room = np.zeros(len(x) + max(cls.most for cls in self.classes) + 2, np.uint8)
                room[: len(x)] = x
                first = np.zeros(len(x), bool)
                first[0] = True
                first[1:] = (x[:-1] == 32) | (x[:-1] == 0) | (x[1:] >= 0xC0) | (x[:-1] >= 0x80) & (x[1:] < 0x80) & (x[1:] != 32) & (x[1:] != 0)
                starts = np.flatnonzero(first).astype(np.int32)
                passed = dict(self.gate(slots, starts))
                for cls in self.classes:
                    self._verify(cls, passed, room, starts, data, slots, docs, note)
        return [(row, item, edits, int(where[lo]), int(where[hi - 1]) + 1) for (row, item, _), (edits, lo, hi) in sorted(out.items())]

    def _verify(self, cls: ItemClass, passed, room, starts, data, slots, docs, note) -> None:
        mine = [(k, passed[i]) for k, (i, _) in enumerate(cls.items) if i in passed]
        if not mine:
            return
        n = len(cls.items)
        gated = np.unique(np.concatenate([at * n + k for k, at in mine]))
        windows = np.unique(gated // n)
        done: dict[tuple[int, int], int] = {}
        for lo in range(0, len(windows), 1 << 14):
            part = windows[lo : lo + (1 << 14)]
            near = cls.candidates(room, starts[part])
            near = np.intersect1d(part[near // n] * n + near % n, gated, assume_unique=True)
            for w, k in zip((near // n).tolist(), (near % n).tolist()):
                i, t = cls.items[k]
                at, most = int(starts[w]), int(self.most[i])
                row = int(np.searchsorted(docs, at, "right")) - 1
                if at < done.get((row, i), -1):
                    continue
                begin, end = max(int(docs[row]), at - most), min(int(docs[row + 1]) - 1, at + len(t) + 2 * most)
                done[row, i] = at + most  # the stretch read covers these starts
                if end - begin < len(t) - most or not self.may_hold(i, slots[begin:end]):
                    continue
                edits, a, b = match(t, data[begin:end])
                if edits <= most:
                    note(i, edits, begin + a, begin + b)


def item_blocks(items: DataFrame, id_column: str = "item_id", accept: float = ACCEPT) -> list[Block]:
    """Blocks of at most BLOCK bytes of text (or one item)."""
    blocks, held, size = [], [], 0
    for r in items.select(F.col(id_column).cast("bigint").alias("i"), F.col("text").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        n = len((r["t"] or "").encode())
        if held and size + n > BLOCK:
            blocks.append(Block(held, accept))
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        blocks.append(Block(held, accept))
    return blocks


HIT_SCHEMA = "doc_id bigint, item_id bigint, edits int, span_start bigint, span_end bigint"


def _hit_batches(shared):
    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch.column(1))
            hits = shared.value.search(raw, offs)
            if not hits:
                continue
            ids = batch.column(0)
            rows = []
            for row, item, edits, lo, hi in hits:
                text = raw[offs[row] : offs[row + 1]]
                begin = lo - int(offs[row])
                # code points before: bytes that do not continue a character
                head = int(((text[:begin] & 0xC0) != 0x80).sum())
                body = int(((text[begin : hi - int(offs[row])] & 0xC0) != 0x80).sum())
                rows.append((ids[row].as_py(), item, edits, head, head + body))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "edits", "span_start", "span_end"])

    return run


def find_items(docs: DataFrame, items: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, item_id, edits, span_start, span_end (code points): the best stretch
    of every document that holds an item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], HIT_SCHEMA)
    for i, block in enumerate(item_blocks(items, accept=accept)):
        found = rows.mapInArrow(_hit_batches(spark.sparkContext.broadcast(block)), HIT_SCHEMA)
        out = found if i == 0 else out.unionByName(found)
    return out


def _clean_batches(shared):
    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch.column(batch.schema.get_field_index("text")))
            held = np.zeros(batch.num_rows, bool)
            held[[h[0] for h in shared.value.search(raw, offs)]] = True
            yield batch.filter(pa.array(~held))

    return run


def without_items(docs: DataFrame, items: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The documents that hold no item, all columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for block in item_blocks(items, accept=accept):
        docs = docs.mapInArrow(_clean_batches(spark.sparkContext.broadcast(block)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
