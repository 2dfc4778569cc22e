"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and words of the whole text. The trees are trained on
the driver from a bounded sample of labelled rows (``max_rows``, taken by the hash of
the id), flattened into five arrays and walked by numpy for all rows of a batch and
all trees at once.

Defined cases: null text counts as empty, and empty texts get a score like any
other; null labels are left out; without any label every score is 0.5; a null
doc_id counts as held out; repeated rows repeat; extra columns pass through
:func:`classify` untouched (its own columns are ``quality_score`` and
``quality_keep`` unless named otherwise, which replace any of that name) and through
:func:`accepted`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, table, text_buffers

MAX_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes log_words word_bytes upper digit space newline stop comma other_punct symbol bang pipe high_bytes byte_entropy "
    "distinct_words top_word same_as_before longest_run dup_lines log_lines line_words caps_words odd_end one_byte repeat_trigrams"
).split()

_CLASS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "other_punct": b"'\"()[]{}-_/\\",
    "symbol": b"#*$%&<>@^~`+=",
    "bang": b"!",
    "pipe": b"|",
}
_CLASS_ROWS = np.zeros((256, len(_CLASS)))
for _j, _bytes in enumerate(_CLASS.values()):
    _CLASS_ROWS[list(_bytes), _j] = 1
_ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?\"')")


def document_statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of FEATURES."""
    n = len(text)
    if n == 0:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (hist @ _CLASS_ROWS / n).tolist()
    high = float(hist[128:].sum()) / n
    p = hist[hist > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    words = text.split()
    m = len(words)
    if m == 0:
        return [np.log1p(n), 0.0, 0.0, *shares, high, entropy, *[0.0] * 11]
    counts = Counter(words)
    same = list(map(eq, words, words[1:]))
    run = most = 0
    if any(same):
        for x in same:
            run = run + 1 if x else 0
            most = max(most, run)
    lines = [x for x in text.split(b"\n") if x.strip()]
    caps = sum(map(bytes.isupper, words))
    odd = sum(w[-1] not in _ENDS and w[-1] < 128 for w in words)
    single = sum(len(w) == 1 for w in words)
    tri = m - 2
    repeat = 1 - len(set(zip(words, words[1:], words[2:]))) / tri if tri > 0 else 0.0
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / m, *shares, high, entropy,
        len(counts) / m**0.8, max(counts.values()) / m, sum(same) / m, most / m,
        1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))), m / len(lines), caps / m, odd / m, single / m, repeat,
    ]


def statistics_matrix(column) -> np.ndarray:
    raw, offs = text_buffers(column)
    data = raw.tobytes()
    rows = [document_statistics(data[offs[i] : offs[i + 1]]) for i in range(len(offs) - 1)]
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


class FlatTrees:
    """All trees in five arrays; a leaf points at itself."""

    def __init__(self, base: float, feature, threshold, left, right, value, roots, depth):
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.left, self.right, self.value, self.roots = (np.asarray(x) for x in (feature, threshold, left, right, value, roots))

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 10) -> FlatTrees:
    """Logistic loss, second-order gains, level by level, histograms of ``bins``
    quantile bins. Deterministic for given rows and order."""
    n, k = x.shape if x.ndim == 2 else (0, len(FEATURES))
    if n == 0:
        return FlatTrees(0.0, [], [], [], [], [], [], depth)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def leaf(v):
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(value))
        right.append(len(value))
        value.append(v)
        return len(value) - 1

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(leaf(0.0))
        node = np.full(n, roots[-1])
        level = [roots[-1]]
        for _ in range(depth):
            rank = {v: i for i, v in enumerate(level)}
            slot = np.full(len(value), -1)
            slot[level] = range(len(level))
            mine = slot[node]
            inside = mine >= 0
            best = {v: (0.0, -1, -1) for v in level}
            for j in range(k):
                width = len(cuts[j]) + 1
                if width < 2:
                    continue
                key = mine[inside] * width + binned[inside, j]
                shape = (len(level), width)
                sg = np.bincount(key, g[inside], len(level) * width).reshape(shape).cumsum(1)
                sh = np.bincount(key, h[inside], len(level) * width).reshape(shape).cumsum(1)
                sc = np.bincount(key, minlength=len(level) * width).reshape(shape).cumsum(1)
                tg, th, tc = sg[:, -1:], sh[:, -1:], sc[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sc < least) | (tc - sc < least)] = 0
                at = gain[:, :-1].argmax(1)
                for v in level:
                    i = rank[v]
                    if gain[i, at[i]] > best[v][0] + 1e-9:
                        best[v] = (float(gain[i, at[i]]), j, int(at[i]))
            below = []
            for v in level:
                gain, j, b = best[v]
                if j < 0:
                    continue
                a, c = leaf(0.0), leaf(0.0)
                feature[v], threshold[v], left[v], right[v] = j, float(cuts[j][b]), a, c
                rows = np.flatnonzero(node == v)
                node[rows] = np.where(binned[rows, j] <= b, a, c)
                below += [a, c]
            level = below
            if not level:
                break
        sums = np.bincount(node, g, len(value)), np.bincount(node, h, len(value))
        for v in np.unique(node):
            value[v] = float(rate * sums[0][v] / (sums[1][v] + l2))
        margin += np.array(value)[node]
    return FlatTrees(base, feature, threshold, left, right, value, roots, depth)


def held_out(doc_id: Column) -> Column:
    return (F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0)


def label_sample(labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, by hash of the id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label"))
    known = known.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)


def _feature_batches(batches):
    names = ["doc_id", "label", "x"]
    for batch in batches:
        x = statistics_matrix(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> FlatTrees:
    """Train on a bounded sample; the only rows that come to the driver."""
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(label_sample(labels, "quality", max_rows))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id").select("doc_id", "label", "text")
    rows = joined.mapInArrow(_feature_batches, "doc_id bigint, label int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x").limit(max_rows).collect()
    return train_trees(np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], np.float64), **options)


def _score_batches(shared, threshold: float, names: Sequence[str] = ()):
    """Scores with the ids or, with ``names`` for them and the verdicts, with all columns."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = shared.value.score(statistics_matrix(batch.column(at)))
            if names:
                ok = pa.array(scores >= threshold)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), ok], [*batch.schema.names, *names])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, names: Sequence[str] = ("quality_score", "quality_keep")) -> DataFrame:
    """All columns of ``docs`` plus the score and the verdict under ``names``, which replace
    any of those names."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(fit(docs, labels, max_rows))
    schema = docs.withColumn(names[0], F.lit(0.0)).withColumn(names[1], F.lit(True)).schema
    return docs.mapInArrow(_score_batches(shared, threshold, names), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that the classifier keeps, with their columns as they are."""
    names = fresh(docs, "score", "keep")
    return classify(docs, labels, threshold, max_rows, names).where(F.col(names[1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score_batches(shared, THRESHOLD), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
