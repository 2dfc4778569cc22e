"""Document fingerprints from prefix polynomial hashes.

A text of code points c[0..n) has the prefix values H[i] = sum of (c[k] + 1) * B**k for
k < i, under two primes below 2**31. From these arrays

* the hash of any span is a difference, so two spans are compared in a few operations
  (a span that starts later is brought level by a power of B);
* the longest common extension of two places is a binary search for the longest equal
  span, checked against the characters once it is found;
* the arrays of a text that is put together from spans come from those of its pieces.

The fingerprint of a text, as a string of hex digits, is its length, both whole values and
the whole polynomial modulo 2**64. The likeness of two texts is the share of their code
points that lie in common spans: the common prefix, the common suffix, and what extends the
anchors that both have between these. Anchors are windows of ``WINDOW`` code points picked by
their hash alone (the least of every ``SPAN`` in a row, the leftmost of equals), so every
common span of WINDOW + SPAN - 1 code points or more holds one and is found whole. Equal
texts have likeness 1; the likeness of an empty text and any other is 0.

Defined cases: a null text is empty; rows are ordered by doc_id, largest first, rows without
one last, rows of one id by the digest of their text, and every row is kept; a table of one
row has that row as its next; an empty table gives no rows; columns besides doc_id and text
are not read. A task holds two texts at a time, about 60 bytes a code point of the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, written

PRIMES = (2147483647, 2147483629)
BASES = (1304969543, 862151623)
WIDE_BASE = 0x9E3779B97F4A7C15
WINDOW = 32
SPAN = 32
#: Elements worked on at once, and text of one sorted partition.
BLOCK = 1 << 16
PARTITION_BYTES = 64 << 20


class _Powers:
    """B**k modulo p for k = 0, 1, ...; the table doubles when it is too short."""

    def __init__(self, base: int, prime: int | None):
        self.base, self.prime = base, prime
        self.table = np.ones(1, np.uint64 if prime is None else np.uint32)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            m = len(self.table)
            if self.prime is None:
                more = self.table * np.uint64(pow(self.base, m, 1 << 64))
            else:
                more = (self.table.astype(np.uint64) * np.uint64(pow(self.base, m, self.prime)) % np.uint64(self.prime)).astype(np.uint32)
            self.table = np.concatenate([self.table, more])
        return self.table


_POWERS = tuple(_Powers(b, p) for b, p in zip(BASES, PRIMES))
#: Powers of the inverse of the first base: they bring a window's hash down to place 0.
_DOWN = _Powers(pow(BASES[0], -1, PRIMES[0]), PRIMES[0])
_WIDE = _Powers(WIDE_BASE, None)


def _wide(points: np.ndarray) -> int:
    """The polynomial of code points modulo 2**64."""
    total, powers = 0, _WIDE.upto(len(points))
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
        total += int((part * powers[at : at + len(part)]).sum())
    return total & (1 << 64) - 1


class PrefixHashes:
    """The prefix arrays of one text."""

    def __init__(self, points: np.ndarray, sums: tuple[np.ndarray, np.ndarray], wide: int):
        self.points, self.sums, self.wide = points, sums, wide
        self._anchors: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sums = []
        for powers, prime in zip(_POWERS, PRIMES):
            table_, p = powers.upto(len(points)), np.uint64(prime)
            out, carry = np.zeros(len(points) + 1, np.uint32), np.uint64(0)
            for at in range(0, len(points), BLOCK):
                part = points[at : at + BLOCK].astype(np.uint64)
                part += np.uint64(1)
                part *= table_[at : at + len(part)]
                part %= p
                part = (np.cumsum(part) + carry) % p
                out[at + 1 : at + 1 + len(part)] = part
                carry = part[-1]
            sums.append(out)
        return cls(points, tuple(sums), _wide(points))

    def __len__(self) -> int:
        return len(self.points)

    def spliced(self, keep: int, other: PrefixHashes, take: int) -> PrefixHashes:
        """The arrays of the first ``keep`` code points and then the first ``take`` of
        ``other``, from the arrays of both."""
        sums = []
        for powers, prime, mine, theirs in zip(_POWERS, PRIMES, self.sums, other.sums):
            lift, p = np.uint64(powers.upto(keep + 1)[keep]), np.uint64(prime)
            sums.append(np.concatenate([mine[: keep + 1], ((theirs[1 : take + 1] * lift + np.uint64(mine[keep])) % p).astype(np.uint32)]))
        head = self.wide if keep == len(self) else _wide(self.points[:keep])
        tail = other.wide if take == len(other) else _wide(other.points[:take])
        wide = (head + int(_WIDE.upto(keep + 1)[keep]) * tail) & (1 << 64) - 1
        return PrefixHashes(np.concatenate([self.points[:keep], other.points[:take]]), tuple(sums), wide)

    @property
    def fingerprint(self) -> str:
        return f"{len(self):08x}{self.sums[0][-1]:08x}{self.sums[1][-1]:08x}{self.wide:016x}"

    def same_span(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether the spans of that length at i here and at j there have equal hashes."""
        for powers, prime, mine, theirs in zip(_POWERS, PRIMES, self.sums, other.sums):
            a, b = int(mine[i + length]) - int(mine[i]), int(theirs[j + length]) - int(theirs[j])
            if i != j:
                lift = powers.upto(max(i, j) + 1)
                a, b = a * int(lift[j]), b * int(lift[i])
            if (a - b) % prime:
                return False
        return True

    def extension(self, i: int, other: PrefixHashes, j: int, back: bool = False) -> int:
        """Length of the longest common extension of i here and j there, to the right or,
        ``back``, to the left of both places."""
        most = min(i, j) if back else min(len(self) - i, len(other) - j)
        low, high = 0, most
        while low < high:
            mid = (low + high + 1) // 2
            if self.same_span(i - mid, other, j - mid, mid) if back else self.same_span(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        a, b = (self.points[i - low : i], other.points[j - low : j]) if back else (self.points[i : i + low], other.points[j : j + low])
        if np.array_equal(a, b):
            return low
        a, b = (self.points[i - most : i][::-1], other.points[j - most : j][::-1]) if back else (self.points[i : i + most], other.points[j : j + most])
        return int(np.argmax(a != b))  # two different spans had equal hashes

    def extensions(self, i: np.ndarray, other: PrefixHashes, j: np.ndarray, back: bool = False) -> np.ndarray:
        """:meth:`extension` for many pairs of places at once, by hashes alone."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(i, j) if back else np.minimum(len(self) - i, len(other) - j)
        lifts = [powers.upto(max(len(self), len(other)) + 1) for powers in _POWERS]
        while (low < high).any():
            mid = (low + high + 1) // 2
            a, b = (i - mid, j - mid) if back else (i, j)
            equal = np.ones(len(i), bool)
            for lift, prime, mine, theirs in zip(lifts, PRIMES, self.sums, other.sums):
                p = np.uint64(prime)
                x = (mine[a + mid].astype(np.uint64) + p - mine[a]) % p * lift[b] % p
                y = (theirs[b + mid].astype(np.uint64) + p - theirs[b]) % p * lift[a] % p
                equal &= x == y
            low, high = np.where(equal, mid, low), np.where(equal, high, np.maximum(low, mid - 1))
        return low

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows picked by :data:`SPAN`; places ascend."""
        if self._anchors is None:
            windows = len(self) - WINDOW + 1
            if windows < 1:
                self._anchors = (np.empty(0, np.int64), np.empty(0, np.uint64))
            else:
                p, sums, down = np.uint64(PRIMES[0]), self.sums[0], _DOWN.upto(windows)
                places = []
                for at in range(0, max(1, windows - SPAN + 1), BLOCK):
                    end = min(windows, at + BLOCK + SPAN - 1)
                    value = sums[at + WINDOW : end + WINDOW].astype(np.uint64)
                    value += p
                    value -= sums[at:end]
                    value %= p
                    value *= down[at:end]
                    value %= p
                    value <<= np.uint64(32)
                    value |= np.arange(at, end, dtype=np.uint64)
                    places.append(_least_of_each(value, SPAN))
                found = np.concatenate(places)
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
                self._anchors = ((found & np.uint64(0xFFFFFFFF)).astype(np.int64), found >> np.uint64(32))
        return self._anchors


def _least_of_each(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` values in a row (of all if there are fewer), each run of
    equal results once. Least so far from the left and from the right of blocks of ``span``
    meet in every window."""
    if len(values) <= span:
        return values.min(keepdims=True)
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, span)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[span - 1 : span - 1 + n])
    return least[np.concatenate([[True], least[1:] != least[:-1]])]


def _covered(n: int, spans: Iterable[tuple[np.ndarray, np.ndarray]], prefix: int, suffix: int) -> int:
    """How many of n places lie in the prefix, the suffix or a span (starts, ends)."""
    edge = np.zeros(n + 1, np.int64)
    for starts, ends in spans:
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:n]) > 0
    inside[:prefix] = True
    inside[n - suffix :] = True
    return int(inside.sum())


def likeness(a: PrefixHashes, b: PrefixHashes) -> float:
    """The share of the code points of both texts that lie in common spans, 0 to 1."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    prefix = a.extension(0, b, 0)
    if prefix == n == m:
        return 1.0
    suffix = min(a.extension(n, b, m, back=True), min(n, m) - prefix)
    spans_a, spans_b = [], []
    if min(n, m) - prefix - suffix >= WINDOW:
        mine, theirs = _between(a, prefix, n - suffix), _between(b, prefix, m - suffix)
        for (places, hashes), (others, their_hashes), forward in ((mine, theirs, True), (theirs, mine, False)):
            firsts, at = np.unique(their_hashes, return_index=True)
            slot = np.searchsorted(firsts, hashes)
            slot[slot == len(firsts)] = 0
            hit = firsts[slot] == hashes if len(firsts) else np.zeros(len(hashes), bool)
            if not hit.any():
                continue
            i, j = places[hit], others[at[slot[hit]]]
            if not forward:
                i, j = j, i
            right, left = a.extensions(i, b, j), a.extensions(i, b, j, back=True)
            good = right >= WINDOW
            i, j, right, left = i[good], j[good], right[good], left[good]
            spans_a.append((i - left, i + right))
            spans_b.append((j - left, j + right))
    return (_covered(n, spans_a, prefix, suffix) + _covered(m, spans_b, prefix, suffix)) / (n + m)


def _between(x: PrefixHashes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchors whose windows lie in low..high."""
    places, hashes = x.anchors()
    cut = slice(*np.searchsorted(places, [low, high - WINDOW + 1]))
    return places[cut], hashes[cut]


# --- over Spark ---------------------------------------------------------------------

_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]


def _compared(doc_id: int | None, text: str, hashes: PrefixHashes, next_text: str, next_hashes: PrefixHashes) -> tuple:
    half = len(text) // 2
    keep, take = len(text) - half, min(half, len(next_text))
    edited = hashes.spliced(keep, next_hashes, take)
    digest = hashlib.sha256((text[:keep] + next_text[:take]).encode()).hexdigest()
    return doc_id, len(text), digest, hashes.fingerprint, edited.fingerprint, likeness(hashes, edited), likeness(hashes, next_hashes)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _pairs_of_part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order: a result for each row but the last, and the first and the
    last row themselves, which meet those of the neighbouring ranges later."""
    part = TaskContext.get().partitionId()
    kinds = [pa.string(), pa.int32(), pa.string(), *_KINDS]
    names = ["kind", "part", "text", *_NAMES]
    blank = (None,) * (len(_NAMES) - 1)
    before, rows = None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashes = PrefixHashes.of(text)
            if before is None:
                rows.append(("first", part, text, doc_id, *blank))
            else:
                rows.append(("pair", part, None, *_compared(*before, text, hashes)))
            before = (doc_id, text, hashes)
        if rows:
            yield _batch(rows, names, kinds)
            rows = []
    if before is not None:
        yield _batch([("last", part, before[1], before[0], *blank)], names, kinds)


def _pairs_across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_compared(i, x, PrefixHashes.of(x), y, PrefixHashes.of(y)) for i, x, y in zip(*(c.to_pylist() for c in batch.columns))]
        if rows:
            yield _batch(rows, _NAMES, _KINDS)


def edited_prints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next: every text against the next in descending order of doc_id, and against itself
    with its last half replaced by the first half as long of that next one.

    The texts are shuffled once, into ranges of the order. A range is read in order and holds
    two texts at a time; only its first and last row go on, to meet their neighbours. What the
    driver sees is the numbers of the ranges that have rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PARTITION_BYTES, 1 << 20))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("digest")]
    placed = rows.withColumn("digest", F.md5(F.encode("text", "utf-8"))).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = written(placed.select("doc_id", "text").mapInArrow(_pairs_of_part, f"kind string, part int, text string, {_RESULT}"), "prints")
    parts = sorted(r["part"] for r in found.where("kind = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = found.where("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    lasts = found.where("kind = 'last'").select("part", "doc_id", "text").join(F.broadcast(follows), "part")
    across = lasts.join(firsts, "next_part").select("doc_id", "text", "next_text").mapInArrow(_pairs_across, _RESULT)
    return found.where("kind = 'pair'").select(*_NAMES).unionByName(across)


def _plain_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [PrefixHashes.of(x or "") for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, made), pa.int64()), pa.array([m.fingerprint for m in made], pa.string())], ["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, without a shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_plain_prints, "doc_id bigint, n_chars bigint, fingerprint string")


def op12_prefix_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_prints(table(spark, sf_dir, "documents"))
