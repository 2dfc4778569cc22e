"""Removal of long repeated byte strings by a common-prefix-aware distributed merge
sort of suffixes.

A byte goes if a ``length``-byte string (100) that covers it also starts earlier:
in a document with a smaller id, or earlier in the same document. Every occurrence
counts, overlapping ones too, and strings are judged on the input.

Which suffixes are sorted. Every window of 100 bytes names one of its 24-byte grams,
the one with the least hash (leftmost of equals): its anchor. The choice depends on
the window alone, so equal windows have the same anchor at the same distance, and
successive windows mostly share theirs: one suffix per run of windows (a family),
about one in 39 bytes, stands for all of them. Anchor hashes are counted first
(distributed duplicate detection, as prefix-doubling string sorters do); only
suffixes whose gram occurs elsewhere go on.

Sorting. Every bucket of documents sorts its suffixes and sends them front-coded: the
length of the prefix shared with the one before, and the rest. Families whose windows
all start earlier in their bucket stay there. A loser tree merges the runs; each
stream carries its common prefix with the last winner, so prefixes known to be equal
are never compared again, and the merged order comes with its common prefix lengths.
These decide: two windows at distance d before their anchors are equal if the
least common prefix between their suffixes in the merged order has the 100 - d bytes from
the anchor on, and the same holds of the d bytes before it in the order of the reversed
left contexts. So at every distance the suffixes fall into runs, cut where a prefix
is too short, and in each run the first place stays (:func:`repeats`). Inside a bucket
the same function reads the bucket's own sorted suffixes.

Hot grams. A gram with more than ``HOT`` contexts (a line that a third of all documents
share, with other text around it) would bring them all into one merge. Its families
are sent window by window instead, each to the part that a hash of the whole window
names: equal windows still meet, different ones spread over all parts.

The whole computation is one plan over one exchange of the texts.

Defined cases: null text counts as empty (and stays null where texts are returned);
a null doc_id comes after all others; rows with the same doc_id are ordered by
bucket and text; texts under 100 bytes lose nothing; an empty table gives an empty
result; extra columns pass through :func:`remove_repeats`. Cut texts drop the bytes
of a character that the cut splits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, table, text_buffers, total_text_bytes

LENGTH = 100
GRAM = 24
#: Text bytes of a bucket, and of the share of the input that one merge handles.
BUCKET = 6 << 20
MERGE = 24 << 20
CHUNK = 1 << 20
#: Contexts of a gram above which each of their windows goes its own way.
HOT = 20_000
#: Cells (members x distances) that are resolved at once.
CELLS = 1 << 21

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 24 bytes at each place."""
    n = len(x) - GRAM + 1
    loads = np.ndarray((len(x) - 7,), np.uint64, buffer=x, strides=(1,))
    h = loads[:n] * _A
    h ^= h >> np.uint64(31)
    h += loads[8 : 8 + n] * _B
    h *= _A
    h ^= h >> np.uint64(29)
    h += loads[16 : 16 + n] * _C
    h *= _B
    h ^= h >> np.uint64(32)
    return h


class Families:
    """Runs of windows with one anchor in a bucket. Arrays, in order of place:
    ``anchor``, ``first`` and ``last`` window start, ``gram`` (hash), and ``ends``, a
    mixture of the hashes of the first and the last gram."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, length: int = LENGTH):
        self.raw, self.data, self.length = raw, raw.tobytes(), length
        parts = [self._chunk(lo, hi) for lo, hi in self._chunks(offs)]
        self.anchor, self.first, self.last = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        self.gram, self.ends = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.uint64) for i in (3, 4))

    def _chunks(self, offs) -> Iterator[tuple[int, np.ndarray]]:
        """(start, document ends inside) of chunks that bound the memory; a long
        document is cut into chunks that overlap by length - 1 bytes."""
        i, n = 0, len(offs) - 1
        while i < n:
            j = int(np.searchsorted(offs, offs[i] + CHUNK, side="right")) - 1
            if j > i:
                yield int(offs[i]), offs[i : j + 1]
                i = j
            else:
                at, end = int(offs[i]), int(offs[i + 1])
                while at + self.length <= end:
                    to = min(end, at + CHUNK + self.length - 1)
                    yield at, np.array([at, to], np.int64)
                    at += CHUNK
                i += 1

    def _chunk(self, start: int, bounds: np.ndarray):
        n = int(bounds[-1]) - start
        empty = np.empty(0, np.int64)
        if n < self.length:
            return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
        h = gram_hashes(np.ascontiguousarray(self.raw[start : start + n]))
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, span = self.length - GRAM + 1, 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: -(width - span)], low[width - span :])
        named = (low & _PLACE).astype(np.int64)
        flags = np.zeros(len(named) + 1, np.int32)
        begin, end = bounds[:-1] - start, bounds[1:] - start - self.length + 1
        some = end > begin
        np.add.at(flags, begin[some], 1)
        np.add.at(flags, end[some], -1)
        valid = np.cumsum(flags[:-1]) > 0
        same = np.zeros(len(named) + 1, bool)
        same[1:-1] = (named[1:] == named[:-1]) & valid[1:] & valid[:-1]
        first = np.flatnonzero(valid & ~same[:-1])
        last = np.flatnonzero(valid & ~same[1:])
        anchor = named[first]
        return anchor + start, first + start, last + start, h[anchor], h[first] * _B ^ h[last + self.length - GRAM]

    def __len__(self):
        return len(self.anchor)

    def right(self, i: int) -> bytes:
        """From the anchor to the end of the last window."""
        return self.data[self.anchor[i] : self.last[i] + self.length]

    def left(self, i: int) -> bytes:
        """From the first window to the anchor."""
        return self.data[self.first[i] : self.anchor[i]]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(grams, about how many different contexts each has in the bucket): families
        with the same extent and the same grams at both ends count once."""
        mixed = self.ends * _A + (self.anchor - self.first).astype(np.uint64) * _B + (self.last - self.anchor + self.length).astype(np.uint64) * _C
        order = np.lexsort((mixed, self.gram))
        g, m = self.gram[order], mixed[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (m[1:] != m[:-1])
        return np.unique(g[new], return_counts=True)

    def local_repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(family, least, greatest distance) of windows that start earlier in the
        bucket."""
        out: list[tuple[int, int, int]] = []
        order = np.argsort(self.gram, kind="stable")
        g = self.gram[order]
        cut = np.ones(len(g) + 1, bool)
        cut[1:-1] = g[1:] != g[:-1]
        cuts = np.flatnonzero(cut)
        low, high = (self.anchor - self.last).tolist(), (self.anchor - self.first).tolist()
        anchor, data, length = self.anchor.tolist(), self.data, self.length
        many = np.flatnonzero(np.diff(cuts) > 1)
        order = order.tolist()
        for lo, hi in zip(cuts[many].tolist(), cuts[many + 1].tolist()):
            strings = sorted((data[anchor[i] : anchor[i] - low[i] + length], data[anchor[i] - high[i] : anchor[i]], i) for i in order[lo:hi])
            shared, before = [], b""
            for x, _, _ in strings:
                shared.append(len(x) if x == before else common_prefix(before, x))
                before = x
            members = [i for _, _, i in strings]
            out += [(members[k], a, b) for k, a, b in repeats(shared, [x for _, x, _ in strings], [low[i] for i in members], members, length)]
        cols = np.array(out, np.int64).reshape(-1, 3)
        return cols[:, 0], cols[:, 1], cols[:, 2]


#: Up to so many different contexts of a gram are compared two by two.
FEW = 6


def repeats(shared: list[int], lefts: list[bytes], lows: list[int], places: list, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(member, least, greatest distance) of windows that a member of an earlier place
    has too. Members come in the order of their suffixes, ``shared`` is the common prefix
    of each with the one before, ``lefts`` the bytes before the anchor, ``lows`` the least
    distance (a suffix has ``length`` - low bytes); the greatest is the length of the
    left context."""
    n = len(lefts)
    if n == 2 and (shared[1] < length - lows[0] or shared[1] < length - lows[1] or lefts[0] != lefts[1]):
        later = int(places[1] > places[0])
        least, most = max(lows[0], lows[1], length - shared[1]), common_suffix(lefts[0], lefts[1])
        return [(later, least, most)] if least <= most else []
    # runs of equal suffixes, and in them of equal left contexts: the first place of
    # such members stands for all
    runs, run = [0], 0
    for i in range(1, n):
        if not shared[i] == length - lows[i] == length - lows[i - 1]:
            run += 1
        runs.append(run)
    order = sorted(range(n), key=lambda i: (runs[i], lefts[i], places[i]))
    out, leads, lead = [], [], -1
    for i in order:
        if lead >= 0 and runs[i] == runs[lead] and lefts[i] == lefts[lead]:
            out.append((i, lows[i], len(lefts[i])))
        else:
            leads.append(i)
            lead = i
    if len(leads) == 1:
        return out
    opens: dict[int, int] = {}
    for i in range(n):
        opens.setdefault(runs[i], i)
    right = [shared[opens[runs[j]]] if runs[i] != runs[j] else length - lows[j] for i, j in zip(leads, leads[1:])]
    if len(leads) <= FEW:
        spans: dict[int, list[tuple[int, int]]] = {}
        for x, i in enumerate(leads[:-1]):
            common = length
            for y in range(x + 1, len(leads)):
                j, common = leads[y], min(common, right[y - 1])
                least, most = max(lows[i], lows[j], length - common), common_suffix(lefts[i], lefts[j])
                if least <= most:
                    spans.setdefault(j if places[j] > places[i] else i, []).append((least, most))
        for i, mine in spans.items():
            mine.sort()
            lo, hi = mine[0]
            for a, b in mine[1:]:
                if a > hi + 1:
                    out.append((i, lo, hi))
                    lo = a
                hi = max(hi, b)
            out.append((i, lo, hi))
        return out
    return out + [(leads[k], lo, hi) for k, lo, hi in _repeats_of_many(right, [lefts[i] for i in leads], [lows[i] for i in leads], [places[i] for i in leads], length)]


def _repeats_of_many(shared: list[int], lefts: list[bytes], lows: list[int], places: list, length: int) -> list[tuple[int, int, int]]:
    """:func:`repeats` of different members; ``shared`` between neighbours."""
    n = len(lefts)
    before = [x[::-1] for x in lefts]
    by_left = sorted(range(n), key=before.__getitem__)
    left_shared = np.array([length, *(common_prefix(before[i], before[j]) for i, j in zip(by_left, by_left[1:]))], np.int64)
    right_shared = np.array([length, *shared], np.int64)
    low, high = np.array(lows, np.int64), np.array([len(x) for x in lefts], np.int64)
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=places.__getitem__)] = np.arange(n)
    width = max(1, CELLS // n)
    marked: list[np.ndarray] = []
    for start in range(int(low.min()), int(high.max()) + 1, width):
        d = np.arange(start, min(start + width, int(high.max()) + 1))
        right = np.cumsum(right_shared[:, None] < length - d, axis=0)
        left = np.empty_like(right)
        left[by_left] = np.cumsum(left_shared[:, None] < d, axis=0)
        member, at = np.nonzero((low[:, None] <= d) & (high[:, None] >= d))
        run = (at * (n + 1) + right[member, at]) * (n + 1) + left[member, at]
        order = np.lexsort((rank[member], run))
        again = order[1:][run[order][1:] == run[order][:-1]]
        marked.append(np.stack([member[again], d[at[again]]], 1))
    rows = np.concatenate(marked)
    if not len(rows):
        return []
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 1)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(rows)]]) - 1
    return list(zip(rows[begin, 0].tolist(), rows[begin, 1].tolist(), rows[end, 1].tolist()))


# --- runs and their merge -----------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to be equal."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    lo, hi = known, most - 1
    while lo < hi:  # first place of difference
        mid = (lo + hi) >> 1
        if a[known : mid + 1] == b[known : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def common_suffix(a: bytes, b: bytes) -> int:
    return common_prefix(a[::-1], b[::-1])


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes]:
    """(shared prefix lengths, concatenated rests) of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.uint8), b"".join(rests)


def decoded(shared, lengths, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, prefix shared with the one before) of a front-coded run."""
    at, before = 0, b""
    for n, m in zip(shared, lengths):
        before = before[:n] + rests[at : at + m - n]
        at += m - n
        yield before, n


def merged(streams: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(stream, string, prefix shared with the string before) in sorted order.

    A loser tree over the streams. ``known[s]`` is the common prefix of stream s with
    the winner it lost to; at a match the longer known prefix wins unseen, and only
    on equal ones are bytes compared, from there on. A finished stream has -1.
    """
    k = 1
    while k < max(1, len(streams)):
        k *= 2
    heads: list[bytes] = [b""] * k
    known = [-1] * k
    nexts = [s.__next__ for s in streams]
    for s in range(len(streams)):
        try:
            heads[s], known[s] = nexts[s]()[0], 0
        except StopIteration:
            pass

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known prefix."""
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = heads[a], heads[b]
        n = common_prefix(s, t, x)
        if n == len(s) and (n < len(t) or a < b) or n < len(s) and n < len(t) and s[n] < t[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * k
    level = list(range(k))
    at = k
    while len(level) > 1:  # the first round
        at //= 2
        won = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[at + i // 2] = lost
            won.append(w)
        level = won
    winner = level[0]
    while known[winner] >= 0:
        yield winner, heads[winner], known[winner]
        try:
            heads[winner], known[winner] = nexts[winner]()
        except StopIteration:
            known[winner] = -1
        node = (winner + k) >> 1
        while node:
            other = losers[node]
            x, y = known[winner], known[other]
            if y > x:
                losers[node], winner = winner, other
            elif x == y and x >= 0:
                winner, losers[node] = play(winner, other)
            node >>= 1


# --- the plan -----------------------------------------------------------------------


def _ordered(docs: pa.Table) -> pa.Table:
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _families_of(docs: pa.Table) -> tuple[pa.Table, np.ndarray, Families]:
    docs = _ordered(docs)
    raw, offs = text_buffers(docs.column("text"))
    return docs, offs, Families(raw, offs)


def _grams(key: tuple, docs: pa.Table) -> pa.Table:
    grams, n = _families_of(docs)[2].contexts()
    return pa.table({"bucket": pa.array(np.full(len(grams), key[0].as_py(), np.int32)), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n.astype(np.int32))})


def _shared_grams(hot: int):
    def run(batches):
        """Rows sorted by gram; those whose gram comes from several buckets, and whether
        it has more than ``hot`` contexts."""
        held = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)]

        def out(bucket, gram, n):
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            size = np.diff(np.r_[first, len(gram)])
            total = np.repeat(np.add.reduceat(n.astype(np.int64), first), size)
            several = np.repeat(size > 1, size)
            return pa.RecordBatch.from_arrays([pa.array(bucket[several]), pa.array(gram[several]), pa.array(total[several] > hot)], ["bucket", "gram", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.r_[h, batch.column(i).to_numpy()] for i, h in enumerate(held)]
            cut = int(np.searchsorted(held[1], held[1][-1]))  # the last gram may go on
            if cut:
                yield out(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[1]):
            yield out(*held)

    return run


RUN_SCHEMA = "part int, bucket int, n int, doc_id binary, place binary, family binary, sizes binary, rests binary, lefts binary"


def _runs(parts: int):
    def run(key: tuple, docs: pa.Table, grams: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        bucket = key[0].as_py()
        if docs.num_rows and grams.num_rows:
            docs, offs, fam = _families_of(docs)
            wanted = grams.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(wanted)
            wanted, hot = wanted[order], grams.column("hot").to_numpy()[order]
            at = np.minimum(np.searchsorted(wanted, fam.gram), len(wanted) - 1)
            keep = wanted[at] == fam.gram
            again, low, high = fam.local_repeats()
            whole = (fam.anchor - fam.last)[again] == low
            whole &= (fam.anchor - fam.first)[again] == high
            keep[again[whole]] = False
            ids = docs.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            #: by part: (suffix, left context, least distance, family, distance of the window)
            sent: dict[int, list[tuple[bytes, bytes, int, int, int]]] = {}
            for i in np.flatnonzero(keep & ~hot[at]).tolist():
                sent.setdefault(int(fam.gram[i] % np.uint64(parts)), []).append((fam.right(i), fam.left(i), int(fam.anchor[i] - fam.last[i]), i, 0))
            inside: dict[int, set[int]] = {}
            for i, lo, hi in zip(again.tolist(), low.tolist(), high.tolist()):
                if hot[at[i]]:
                    inside.setdefault(i, set()).update(range(lo, hi + 1))
            for i in np.flatnonzero(keep & hot[at]).tolist():
                anchor = int(fam.anchor[i])
                for d in range(anchor - int(fam.last[i]), anchor - int(fam.first[i]) + 1):
                    if d not in inside.get(i, ()):
                        window = fam.data[anchor - d : anchor - d + fam.length]
                        sent.setdefault(zlib.crc32(window) % parts, []).append((window, b"", 0, i, d))
            for p, strings in sorted(sent.items()):
                strings.sort()
                family = np.array([x[3] for x in strings])
                doc = np.searchsorted(offs, fam.anchor[family], side="right") - 1
                shared, rests = front_coded([x[0] for x in strings])
                sizes = np.stack([shared, [len(x[0]) for x in strings], [len(x[1]) for x in strings], [x[2] for x in strings], [x[4] for x in strings], no_id[doc]], 1).astype(np.uint8)
                rows.append((p, bucket, len(strings), ids[doc].astype(np.int64).tobytes(), fam.anchor[family].tobytes(), family.astype(np.int32).tobytes(), sizes.tobytes(), rests, b"".join(x[1] for x in strings)))
        names = [x.split()[0] for x in RUN_SCHEMA.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    return run


MARK_SCHEMA = "bucket int, family int, low int, high int"


def _merge_runs(runs: pa.Table) -> pa.Table:
    """The distances of each sent family whose windows start earlier elsewhere."""
    runs = runs.sort_by("bucket")
    meta, streams = [], []
    for i in range(runs.num_rows):
        get = lambda name: runs.column(name)[i].as_py()
        n = get("n")
        sizes = np.frombuffer(get("sizes"), np.uint8).reshape(n, 6)
        ends = np.cumsum(sizes[:, 2].astype(np.int64))
        meta.append((get("bucket"), np.frombuffer(get("doc_id"), np.int64).tolist(), np.frombuffer(get("place"), np.int64).tolist(), np.frombuffer(get("family"), np.int32).tolist(), sizes[:, 2:].tolist(), get("lefts"), ends.tolist()))
        streams.append(decoded(sizes[:, 0].tolist(), sizes[:, 1].tolist(), get("rests")))
    out: list[tuple[int, int, int, int]] = []
    next_of = [0] * len(streams)
    # of the members that share a gram: common prefix with the one before, left context,
    # least distance, place, and (bucket, family, distance of the window)
    shares: list[int] = []
    lefts: list[bytes] = []
    lows: list[int] = []
    places: list[tuple] = []
    names: list[tuple[int, int, int]] = []

    def resolve():
        for k, lo, hi in repeats(shares, lefts, lows, places):
            bucket, family, shift = names[k]
            out.append((bucket, family, lo + shift, hi + shift))

    for s, _, shared in merged(streams):
        if shared < GRAM:
            if len(names) > 1:
                resolve()
            shares, lefts, lows, places, names = [], [], [], [], []
        bucket, ids, at, families, sizes, text, ends = meta[s]
        i = next_of[s]
        next_of[s] = i + 1
        size, low, shift, no_id = sizes[i]
        shares.append(shared)
        lefts.append(text[ends[i] - size : ends[i]])
        lows.append(low)
        places.append((no_id, ids[i], bucket, at[i]))
        names.append((bucket, families[i], shift))
    if len(names) > 1:
        resolve()
    cols = list(zip(*out)) if out else [[]] * 4
    return pa.table([pa.array(c, pa.int32()) for c in cols], ["bucket", "family", "low", "high"])


def removed_bytes(offs: np.ndarray, fam: Families, marks: pa.Table) -> np.ndarray:
    """For every byte of a bucket whether it goes."""
    cover = np.zeros(len(fam.raw) + 1, np.int32)
    family, low, high = fam.local_repeats()
    if marks.num_rows:
        family = np.r_[family, marks.column("family").to_numpy()]
        low, high = np.r_[low, marks.column("low").to_numpy()], np.r_[high, marks.column("high").to_numpy()]
    np.add.at(cover, fam.anchor[family] - high, 1)
    np.add.at(cover, fam.anchor[family] - low + fam.length, -1)
    return np.cumsum(cover[:-1]) > 0


def _report(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    rows = []
    if docs.num_rows:
        docs, offs, fam = _families_of(docs)
        gone = removed_bytes(offs, fam, marks)
        for i, doc_id in enumerate(docs.column("doc_id").to_pylist()):
            lo, hi = int(offs[i]), int(offs[i + 1])
            mine = gone[lo:hi]
            kept = fam.raw[lo:hi][~mine].tobytes() if mine.any() else fam.data[lo:hi]
            rows.append((doc_id, hi - lo, int(mine.sum()), int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)


def _cut_texts(extra: str):
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs, offs, fam = _families_of(docs)
        gone = removed_bytes(offs, fam, marks)
        texts = docs.column("text").to_pylist()
        for i, text in enumerate(texts):
            lo, hi = int(offs[i]), int(offs[i + 1])
            mine = gone[lo:hi]
            if mine.any():
                texts[i] = fam.raw[lo:hi][~mine].tobytes().decode("utf-8", "ignore")
        return docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).drop_columns([extra])

    return run


def _planned(docs: DataFrame, bucket: str) -> tuple[GroupedData, GroupedData]:
    """(documents by bucket, marks by bucket). One partition a bucket and one a part, both
    counted by the input, so a task's share does not grow with it."""
    bounded_batches(docs.sparkSession)
    rows, nbytes = total_text_bytes(docs)
    buckets = max(1, -(-nbytes // BUCKET), -(-rows // 200_000))
    parts = max(12, -(-nbytes // MERGE))
    dealt = docs.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")).repartitionById(buckets, F.col(bucket))
    by_bucket = dealt.groupBy(bucket)
    grams = by_bucket.applyInArrow(_grams, "bucket int, gram bigint, n int")
    shared = grams.repartition(max(parts, 1), "gram").sortWithinPartitions("gram").mapInArrow(_shared_grams(HOT), "bucket int, gram bigint, hot boolean")
    runs = by_bucket.cogroup(shared.repartitionById(buckets, F.col("bucket")).groupBy("bucket")).applyInArrow(_runs(parts), RUN_SCHEMA)
    marks = runs.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(_merge_runs, MARK_SCHEMA)
    return by_bucket, marks.repartitionById(buckets, F.col("bucket")).groupBy("bucket")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    by_bucket, marks = _planned(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), "bucket")
    return by_bucket.cogroup(marks).applyInArrow(_report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with the repeated bytes cut out of ``text``."""
    (bucket,) = fresh(docs, "bucket")
    by_bucket, marks = _planned(docs, bucket)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return by_bucket.cogroup(marks).applyInArrow(_cut_texts(bucket), schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(greatest(n - 99, 0))) AS p FROM h)),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS opens FROM d),
i AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
s AS (SELECT doc_id, island, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY ALL),
e AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS tail,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM e JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
