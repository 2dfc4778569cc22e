"""The index: forward rows, versions, positions; search in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from passagelake.operators import index, retrieve
from passagelake.plans import build

WORDS = "ka lo mi su ter nal vi do".split()


def passages(spark, n=80, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 9, 30])))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "chunk_pos long, text string")


class Broken(index.HashingEmbedder):
    def embed_tokens(self, rows):
        raise RuntimeError("out of memory")


def test_a_build_that_fails_leaves_the_old_index(spark, tmp_path):
    e, path = index.HashingEmbedder(8), f"{tmp_path}/index"
    assert not index.index_exists(spark, path) and index.versions(spark, path) == []
    with pytest.raises(Exception, match="out of memory"):
        index.build_index(passages(spark), Broken(8), path)
    assert not index.index_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path)
    first = index.build_index(passages(spark, 10), e, path, {"book": "one"})
    held = index.load_index(spark, path, e)
    with pytest.raises(Exception, match="out of memory"):
        index.build_index(passages(spark, 20), Broken(8), path, {"book": "two"})
    assert index.versions(spark, path) == [first] and index.index_info(spark, path)["book"] == "one"
    assert index.load_index(spark, path, e)["chunks"].count() == 11
    second = index.build_index(passages(spark, 20), e, path, {"book": "two"})
    assert index.versions(spark, path) == [second, first] and index.index_info(spark, path)["book"] == "two"
    assert index.load_index(spark, path, e)["vectors"].count() == 21
    assert held["postings"].count() > 0 and held["chunks"].count() == 11  # who reads the old version goes on


def test_forward_rows_hold_postings_and_vectors(spark):
    df, e = passages(spark), index.HashingEmbedder(16)
    rows = index.forward(df, e)
    plain = lambda x: sorted(map(tuple, x.select("chunk_pos", "term", "tf", "dl").collect()))
    assert plain(index.postings_of(rows)) == plain(index.postings(df))
    vectors = lambda x: {r["chunk_pos"]: list(r["embedding"]) for r in x.collect()}
    assert vectors(index.vectors_of(rows)) == vectors(index.embedded(df, e).select("chunk_pos", "embedding"))
    assert index.lengths_of(rows).first() == index.lengths(df).first()
    stats = index.lengths(df)
    assert sorted(map(tuple, index.terms_of(rows, stats).collect())) == sorted(map(tuple, index.terms(index.postings(df), stats).collect()))
    # an embedder that takes texts sees them with its prefix
    p = index.PrefixEmbedder(e)
    assert vectors(index.vectors_of(index.forward(df, p))) == vectors(index.embedded(df, p).select("chunk_pos", "embedding"))
    none = index.forward(df.limit(0), e)
    assert none.count() == 0 and index.lengths_of(none).first()["avgdl"] == 1.0


@pytest.mark.parametrize("block,cells", [(4096, 1 << 22), (3, 64)])
def test_one_pass_against_postings_and_vectors(spark, monkeypatch, block, cells):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    monkeypatch.setattr(retrieve, "CELLS", cells)
    df, e = passages(spark, 70, 5), index.HashingEmbedder(8)
    qs = spark.createDataFrame([(1, "ka ka mi"), (2, "nothing"), (3, ""), (4, "vi do"), (5, "ter nal"), (6, None), (7, "su lo zz")], "q_id long, question string")
    rows, stats = index.forward(df, e), index.lengths(df)
    terms = index.terms_of(rows, stats)
    spread = qs.select("q_id", F.posexplode(F.array("question", F.reverse("question"))).alias("v", "text")).select("q_id", (F.col("q_id") * 4 + F.col("v")).alias("v_id"), "text")
    variants = index.embedded(spread, e, query=True).select("q_id", "v_id", "embedding")
    near, best = retrieve.one_pass(qs, rows, terms, stats, 6, 9, variants)
    scores = retrieve.bm25(retrieve.question_terms(qs), index.postings(df), terms, stats)
    want = retrieve.ranked(scores, ["q_id"], [F.desc("bm25"), F.col("chunk_pos")], 9)
    pairs = lambda x: sorted((r["q_id"], r["chunk_pos"], round(r["bm25"], 8)) for r in x.collect())
    assert pairs(best) == pairs(want)
    dense = retrieve.dense_topk(variants.select(F.col("v_id").alias("q_id"), "embedding"), index.vectors_of(rows), 6)
    true = {(r["q_id"], r["chunk_pos"]): r["bm25"] for r in scores.collect()}
    got = sorted((r["v_id"], r["chunk_pos"], r["dist"], round(r["bm25"], 8)) for r in near.collect())
    assert got == sorted((r["q_id"], r["chunk_pos"], r["dist"], round(true.get((r["q_id"] // 4, r["chunk_pos"]), 0.0), 8)) for r in dense.collect())
    whole = lambda x: sorted((r["q_id"], r["rank"], r["chunk_pos"]) for r in x.collect())
    assert whole(retrieve.lexical_search(qs, rows, terms, stats, 9)) == whole(retrieve.lexical_topk(qs, scores, df, 9))


def test_one_pass_without_questions_or_passages(spark):
    df, e = passages(spark), index.HashingEmbedder(8)
    qs = spark.createDataFrame([(1, "ka")], "q_id long, question string")
    for d, q in ((df, qs.limit(0)), (df.limit(0), qs)):
        rows, stats = index.forward(d, e), index.lengths(d)
        near, best = retrieve.one_pass(q, rows, index.terms_of(rows, stats), stats, 3, 3, index.embedded(q.select("q_id", F.col("q_id").alias("v_id"), F.col("question").alias("text")), e, query=True).select("q_id", "v_id", "embedding"))
        assert near.count() == 0 and best.count() == 0


def chapters(spark, n):
    rng = random.Random(3)
    numbers = [rng.choice([None, 0, *range(1, 40)]) for _ in range(n)]
    rows = [("b", f"c{i % 60}", numbers[i], f"u{i}", "word " * rng.randint(1, 60)) for i in range(n)]
    return spark.createDataFrame(rows, "book string, chapter string, chapter_no int, url string, text string")


def test_positions_without_a_window_over_all(spark):
    chunks = index.split_chapters(chapters(spark, 200), 60, 10)
    placed = index.with_positions(chunks)
    plan = placed._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and all("pl_range" in line for line in plan.split("\n") if "Window " in line or "Window [" in line)
    rows = placed.collect()
    order = sorted(rows, key=lambda r: (r["chapter_no"] or 1_000_000, r["chapter"], r["source"], r["chunk_index"]))
    assert [r["chunk_pos"] for r in order] == list(range(1, len(rows) + 1))
    assert index.with_positions(chunks.limit(0)).count() == 0


def test_build_writes_one_version(spark, tmp_path):
    from passagelake.config import Config

    build.build(spark, chapters(spark, 20), f"{tmp_path}/i", Config(chunk_size=60, chunk_overlap=10), "b")
    assert len(index.versions(spark, f"{tmp_path}/i")) == 1 and index.index_info(spark, f"{tmp_path}/i")["num_chapters"] == 20
