"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of every 4-word shingle of the lower-cased text; bit b
of the fingerprint is set if it is set in over half of the hashes. Two fingerprints
link at ``radius`` or fewer differing bits.

Candidates: a random linear map sends the 64 bit positions to vectors of
``radius + 1`` bits. For each of the ``2**(radius+1) - 1`` non-zero vectors v, the
mask of v holds the positions whose vector has an odd inner product with v. The
differing positions of a linked pair span at most ``radius`` dimensions, so some v
is orthogonal to all of them: under that mask the pair agrees. Every pair within the
radius therefore meets in at least one of the 31 tables; nothing is lost.

A bucket never emits its pairs. It is read in blocks, links inside it are verified
exactly, and only a spanning forest (at most members - 1 edges) leaves it. Large
buckets are cut further by the pigeonhole principle on the bits outside the mask:
of ``radius + 1`` groups of those bits a linked pair agrees in one. Exact copies are
one node from the start. Components come from alternating large-star / small-star
rounds over a table in the shared folder.

Defined cases: null or empty text has fingerprint zero and links like any other;
texts under four words are one shingle; a null doc_id takes part but never names a
component (its component_id is null only if no member has an id); repeated rows
are kept, one output row each; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, hub_join, table, text_buffers, written

SHINGLE = 4
RADIUS = 4
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _LOWER.tobytes()


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    """Unsigned XXH64 of every k-word shingle, repeats included."""
    words = text.translate(_LOWER_TABLE).split()  # bytes.split() cuts at the six ASCII white-space characters
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    hashes = shingle_hashes(text or b"", k)
    if not hashes:
        return 0
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        raw, offs = text_buffers(batch.column(batch.schema.get_field_index("text")))
        data = raw.tobytes()
        fps = np.array([fingerprint(data[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])


def row_key() -> Column:
    """What names a row: its doc_id and a digest of its text."""
    return F.concat(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")))


def fingerprints(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed 64-bit integer; ``key`` is
    :func:`row_key` if asked for, else null."""
    bounded_batches(docs.sparkSession)
    key = row_key() if with_key else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), "text").mapInArrow(_fingerprint_batches, "doc_id bigint, key string, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """The masks of the covering family, as unsigned integers. Positions are dealt
    evenly over the non-zero vectors, so every mask holds about half the bits."""
    dims = radius + 1
    vectors = [1 + i % ((1 << dims) - 1) for i in range(bits)]
    np.random.default_rng(seed).shuffle(vectors)
    return [sum(1 << b for b in range(bits) if bin(vectors[b] & v).count("1") & 1) for v in range(1, 1 << dims)]


class _Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _link_block(fps: np.ndarray, rows: np.ndarray, radius: int, forest: _Forest, out: list) -> None:
    """Join all rows of one block that are within the radius; blocks of 1024 rows
    bound the memory."""
    for at in range(0, len(rows), 1024):
        left = rows[at : at + 1024]
        for to in range(at, len(rows), 1024):
            right = rows[to : to + 1024]
            near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
            if to == at:
                near = np.triu(near, 1)
            for i, j in zip(*np.nonzero(near)):
                a, b = int(left[i]), int(right[j])
                if forest.join(a, b):
                    out.append((a, b))


def bucket_forest(fps: np.ndarray, mask: int, radius: int = RADIUS, large: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints that agree under
    ``mask``; (i, j) are row numbers."""
    n = len(fps)
    forest, out = _Forest(n), []
    rows = np.arange(n)
    if n <= large:
        _link_block(fps, rows, radius, forest, out)
        return out
    rest = [b for b in range(64) if not mask >> b & 1]
    for g in range(radius + 1):
        sub = np.uint64(sum(1 << b for b in rest[g :: radius + 1]))
        keys = fps & sub
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for part in np.split(order, cuts):
            if len(part) > 1:
                _link_block(fps, part, radius, forest, out)
    return out


def _links_of_part(masks: list[int], radius: int):
    def run(batches):
        """Rows come sorted by (table, key); a bucket may go over batches."""
        held: list[np.ndarray] = []
        at = None

        def flush():
            if at is None or not held:
                return None
            fps = np.unique(np.concatenate(held))
            if len(fps) < 2:
                return None
            pairs = bucket_forest(fps, masks[at[0]], radius)
            if not pairs:
                return None
            p = np.array(pairs)
            s = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(s[p[:, 0]]), pa.array(s[p[:, 1]])], ["a", "b"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = batch.column(0).to_numpy()
            k = batch.column(1).to_numpy()
            fp = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(t)]
            sizes = np.diff(bounds)
            for i in range(len(sizes)):
                lo, hi = bounds[i], bounds[i + 1]
                key = (int(t[lo]), int(k[lo]))
                if key != at:
                    done = flush() if held and (len(held) > 1 or len(held[0]) > 1) else None
                    if done is not None:
                        yield done
                    at, held = key, []
                held.append(fp[lo:hi].copy() if hi == len(t) else fp[lo:hi])
        done = flush() if held and (len(held) > 1 or len(held[0]) > 1) else None
        if done is not None:
            yield done

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) of a spanning forest per bucket, over a table of distinct
    fingerprints (column fp)."""
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("t", "key"))
    dealt = keyed.select("t", "key", "fp").repartition(F.col("t"), F.col("key")).sortWithinPartitions("t", "key")
    return dealt.mapInArrow(_links_of_part(masks, radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): alternating large-star and
    small-star. Large-star hangs every larger neighbour on the smallest one,
    small-star every smaller one; the edge count never grows. Each star is a table
    in the shared folder; the end is when a round changes nothing. If that takes more than
    ``max_rounds`` it is an error: unfinished roots are never returned. The nodes of most
    edges are looked up by broadcast (:func:`hub_join`), so a hub is no hot task."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    total, seen = now.count(), None
    for done in count():
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError(f"components: not finished after {max_rounds} rounds")
        # large star
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "m").alias("m"), "many")
        large = written(hub_join(both, low, "u", total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # small star
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many"))
        small = hub_join(large, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _grouped(docs: DataFrame, radius: int, with_key: bool) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): one row per document, and one per fingerprint with the number of
    its documents, its component's root, the row that leads its documents (``own``) and the
    one that leads the component (``lead``): (no_id, doc_id, key), smallest id first."""
    prints = written(fingerprints(docs, with_key), "simhash")
    lead = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = written(prints.groupBy("fp").agg(F.min(lead).alias("own"), F.count(F.lit(1)).alias("many")), "simhash-classes")
    roots = components(fingerprint_links(classes.select("fp"), radius))
    linked = written(classes.join(roots, classes.fp == roots.node).select("fp", "root", "own"), "simhash-linked")
    heads = linked.groupBy("root").agg(F.min("own").alias("lead"), F.count(F.lit(1)).alias("many"))
    members = hub_join(linked.select("fp", "root"), heads, "root", linked.count())
    named = classes.join(members, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "own", F.coalesce("lead", "own").alias("lead"), "many")
    return prints, written(named, "simhash-named")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed), component_id: smallest doc_id reachable over links."""
    prints, classes = _grouped(docs, radius, False)
    found = classes.select("fp", F.col("lead.doc_id").alias("component_id"), "many")
    return hub_join(prints.select("doc_id", "fp"), found, "fp", prints.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (all columns as they are) that stand for their group: the
    smallest id; of rows that repeat that id the least by digest of the text, of rows that
    repeat both one by hash of the row; in a group without any id the least by digest."""
    _, classes = _grouped(docs, radius, True)
    key, rank = fresh(docs, "key", "rank")
    leads = classes.where("own <=> lead").select(F.col("lead.key").alias(key))
    hashed = [f.name for f in docs.schema.fields if not _has_map(f.dataType)]
    first = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    # one row a key before the shuffle and after it; then the join, on the same keys
    kept = docs.withColumn(key, row_key()).withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    return kept.join(leads, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
