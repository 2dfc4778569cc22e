"""What the review of round 3 found, each with what would have failed before."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.functions import chunk
from passagelake.operators import evaluate, index, metric
from passagelake.plans.queries import QUERIES, SQL
from passagelake.sources import files, wiki

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def by_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(SQL[name]).fetchall(), key=repr)


def test_pages_of_one_address(spark, tmp_path):  # F1
    rows = [(1, "http://x/a", "one"), (2, "http://x/a", "two"), (3, "http://x/a", "three"), (6, "http://x/b", "six"), (7, None, "seven")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_cache"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == by_sql(tmp_path, "page_cache", "pages") and len(got) == 5


def counted(monkeypatch, name):
    """How often metric.NAME is called."""
    calls, made = [], getattr(metric, name)
    monkeypatch.setattr(metric, name, lambda *a: calls.append(1) or made(*a))
    return calls


def test_even_vectors_meet_on_a_grid(spark, monkeypatch):  # F2, F7, F8, F10, F13: cells leave nothing out, a row a cell was sent
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 32))
    v[:40] = v[40]
    monkeypatch.setattr(metric, "PART", 128)
    on_grid = counted(monkeypatch, "_grid")
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_pos long, embedding array<double>")
    found, _ = metric.knn_by_cells(rows.withColumnRenamed("chunk_pos", "q_id"), rows, 5, 16)
    d = np.round(metric.squared(v, v), 9)
    order = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), axis=1)[:, :5]
    want = [(i, int(j), r) for i in range(700) for r, j in enumerate(order[i], 1)]
    assert sorted((r["q_id"], r["chunk_pos"], r["rank"]) for r in found.collect()) == sorted(want) and on_grid


@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e20, 1e200])
def test_screening_loses_nothing(scale):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(300, 16)) * scale
    v = np.concatenate([rng.normal(size=(5000, 16)) * scale, q[:50], q[:50]])
    places = rng.permutation(len(v))
    best = metric.Nearest(q, 7)
    for lo in (0, 5, 4000):
        hi = {0: 5, 5: 4000, 4000: len(v)}[lo]
        best.add(v[lo:hi], places[lo:hi])
    d = np.round(metric.squared(q, v), 9)
    order = np.lexsort((np.broadcast_to(places, d.shape), d), axis=1)[:, :7]
    row, place, dist = best.found()
    assert (place.reshape(300, 7) == places[order]).all() and (dist.reshape(300, 7) == np.take_along_axis(d, order, 1)).all()


class Narrow:
    """Takes no more text at once than a few batches may have."""

    name, dim = "narrow", 1

    def embed_documents(self, texts):
        if sum(map(len, texts)) > 2 * files.BATCH_BYTES:
            raise ValueError("too much text at once")
        return np.ones((len(texts), 1))

    def embed_query(self, text):
        return np.ones(1)


def long_texts(spark, n=120, each=200_000):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("chunk_pos"), F.repeat(F.lit("word "), each // 5).alias("text"))


@pytest.mark.parametrize("step", [index.forward, index.embedded])
def test_python_gets_little_text_at_once(spark, step):  # F5, F9, F11, F12, F14 to F17, F19, F21: ten thousand rows of any length were a batch
    spark.conf.unset(LIMIT)
    assert step(long_texts(spark), Narrow()).count() == 120


@pytest.mark.parametrize("step", [lambda d: index.chunk_documents(d, 800, 150, "chunk_pos"), lambda d: wiki.chapters_of(d.select(F.lit("B/c").alias("title"), F.col("text").alias("html")), "B", "A", "http://h"), lambda d: evaluate.locate_by_grams(QUESTION(d), d.select(F.lit("c").alias("chapter"), F.lit(1).alias("chapter_no"), "text"))])
def test_texts_are_cut_into_bounded_batches(spark, step):  # F3, F4, F18
    spark.conf.unset(LIMIT)
    step(long_texts(spark, 2, 50))
    assert int(spark.conf.get(LIMIT)) == files.BATCH_BYTES


def QUESTION(d):
    return d.limit(1).select(F.col("chunk_pos").alias("q_id"), F.lit(True).alias("answerable"), F.array(F.lit("word")).alias("evidence_keywords"))


def test_pieces_are_packed_as_before():  # by bisection now, against piece by piece
    def pack(spans, size, overlap):
        out, first, total = [], 0, 0
        for i, (lo, hi) in enumerate(spans):
            if total + hi - lo > size and first < i:
                out.append((spans[first][0], spans[i - 1][1]))
                while first < i and (total > overlap or (total + hi - lo > size and total > 0)):
                    total -= spans[first][1] - spans[first][0]
                    first += 1
            total += hi - lo
        return [*out, (spans[first][0], spans[-1][1])]

    rng = np.random.default_rng(7)
    for _ in range(500):
        size = int(rng.integers(2, 30))
        ends = np.cumsum(rng.integers(1, size, rng.integers(1, 40))).tolist()
        overlap = int(rng.integers(0, size))
        assert chunk._pack(0, ends, size, overlap) == pack(list(zip([0, *ends], ends)), size, overlap)


def test_tokens_of_plain_python():  # one pass over the text; the same tokens
    assert index.plain_tokens("Ab‌C [দ‍ূর] x—y\x1cZ9 K") == ["abc", "দূর", "x", "y", "z9", "k"] and index.plain_tokens(None) == []
