"""Retrieval, answers and evaluation against plain Python."""

import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from passagelake.config import Config
from passagelake.functions import lang
from passagelake.operators import answer, evaluate, index, retrieve
from passagelake.streaming.questions import retrieve_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests

WORDS = "ka lo mi su ter nal vi do".split()
PASSAGES = "chunk_pos long, text string, chapter string, section string, source string"


def passages(spark, n=60, seed=1, extra=()):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))), f"c{i % 4}", f"s{i}", "") for i in range(n)]
    return spark.createDataFrame([*rows, *extra], PASSAGES), rows


def brute_bm25(rows, question, k1=1.5, b=0.75):
    docs = [index.plain_tokens(t) for _, t, *_ in rows]
    avg = sum(map(len, docs)) / len(docs)
    terms = list(dict.fromkeys(t for t in index.plain_tokens(question) if len(t) > 1))
    out = []
    for d in docs:
        s = 0.0
        for t in terms:
            df = sum(t in x for x in docs)
            tf = d.count(t)
            if tf:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
        out.append(round(s, 9))
    return out


def test_bm25_and_padding(spark):
    df, rows = passages(spark)
    qs = spark.createDataFrame([(1, "ka ka mi"), (2, "nothing here"), (3, ""), (4, "vi")], "q_id long, question string")
    post, stats = index.postings(df), index.lengths(df)
    scores = retrieve.bm25(retrieve.question_terms(qs), post, index.terms(post, stats), stats)
    got = {(r["q_id"], r["rank"]): (r["chunk_pos"], r["bm25"]) for r in retrieve.lexical_topk(qs, scores, df, 40).collect()}
    assert len(got) == 160
    for q, text in ((1, "ka mi"), (2, "nothing here"), (3, ""), (4, "vi")):
        want = brute_bm25(rows, text)
        order = sorted(range(len(rows)), key=lambda i: (-want[i], i))[:40]
        assert [got[q, r + 1][0] for r in range(40)] == order
        assert np.allclose([got[q, r + 1][1] for r in range(40)], [want[i] for i in order], atol=1e-8)


def test_no_passages(spark):
    df, _ = passages(spark)
    empty = df.limit(0)
    assert index.lengths(empty).first().asDict() == {"n": 0, "avgdl": 1.0}
    assert index.terms(index.postings(empty), index.lengths(empty)).count() == 0


@pytest.mark.parametrize("k", [1, 5, 24])
def test_nearest_neighbours(spark, k):
    rng = np.random.default_rng(k)
    v = np.round(rng.normal(size=(80, 6)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_pos long, embedding array<double>").repartition(5)
    q = df.where("chunk_pos < 9").selectExpr("chunk_pos as q_id", "embedding")
    got = retrieve.dense_topk(q, df, k).orderBy("q_id", "rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in retrieve.dense_topk_native(q, df, k).orderBy("q_id", "rank").collect()]
    for i in range(9):
        d = np.round(((v - v[i]) ** 2).sum(1), 9)
        want = sorted(range(80), key=lambda j: (d[j], j))[:k]
        assert [r["chunk_pos"] for r in got if r["q_id"] == i] == want
    assert retrieve.dense_topk(q.limit(0), df, k).count() == 0


def test_query_blocks_agree(spark, monkeypatch):
    v = np.random.default_rng(0).normal(size=(30, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_pos long, embedding array<double>")
    q = df.selectExpr("chunk_pos as q_id", "embedding")
    whole = sorted(map(tuple, retrieve.dense_topk(q, df, 3).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, retrieve.dense_topk(q, df, 3).collect())) == whole


def brute_hybrid(rows, question, k, conf=Config()):
    e = index.HashingEmbedder(16)
    v = e.embed_documents([r[1] for r in rows])
    variants = [question, question + " " + " ".join(lang.HINTS["what"])]
    dist = {}
    for t in variants:
        d = np.round(((v - e.embed_query(t)) ** 2).sum(1), 9)
        for i in sorted(range(len(rows)), key=lambda i: (d[i], i))[: conf.semantic_k]:
            dist[i] = min(dist.get(i, 9), d[i])
    lex = brute_bm25(rows, question)
    pool = set(dist) | set(sorted(range(len(rows)), key=lambda i: (-lex[i], i))[: max(40, 5 * k)])

    def scaled(x, reverse=False):
        lo, hi = min(x.values()), max(x.values())
        return {i: 1.0 if hi - lo < 1e-12 else ((hi - y) if reverse else (y - lo)) / (hi - lo) for i, y in x.items()}

    sem, low = scaled({i: dist.get(i, 2.0) for i in pool}, True), scaled({i: lex[i] for i in pool})
    total = {i: round(0.58 * sem[i] + 0.30 * low[i], 9) for i in pool}
    out, seen = [], set()
    for i in sorted(pool, key=lambda i: (-total[i], i)):
        if rows[i][1] and rows[i][1] not in seen:
            seen.add(rows[i][1])
            out.append((i, total[i]))
    return out[:k]


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_hybrid(spark, partitions):
    df, rows = passages(spark, 90, 3)
    e = index.HashingEmbedder(16)
    qs = spark.createDataFrame([(1, "ka lo"), (2, "ter ter vi"), (3, "unknown words")], "q_id long, question string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = retrieve.retrieve(qs, index.memory_index(df, e), e, 8).orderBy("q_id", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for q, t in ((1, "ka lo"), (2, "ter ter vi"), (3, "unknown words")):
        want = brute_hybrid(rows, t, 8)
        mine = [r for r in got if r["q_id"] == q]
        assert [r["rank"] for r in mine] == list(range(1, 9))
        assert [r["chunk_pos"] for r in mine] == [i for i, _ in want]
        assert np.allclose([r["score"] for r in mine], [s for _, s in want])


def test_hybrid_fills_up_beyond_the_pool(spark):
    df, rows = passages(spark, 200, 4)
    e = index.HashingEmbedder(16)
    qs = spark.createDataFrame([(1, "zzz")], "q_id long, question string")
    got = retrieve.retrieve(qs, index.memory_index(df, e), e, 60).collect()
    texts = [r["text"] for r in got]
    assert len(set(texts)) == len(texts) and sorted(r["rank"] for r in got) == list(range(1, len(got) + 1))
    assert len(got) >= 60 or len(got) == len({t for _, t, *_ in rows if t})


def test_store_and_guards(spark, tmp_path):
    df, _ = passages(spark)
    e = index.HashingEmbedder(16)
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, f"{tmp_path}/none")
    index.build_index(df, e, f"{tmp_path}/i", {"book": "B", "num_chunks": 7})
    info = index.index_info(spark, f"{tmp_path}/i")
    assert info["num_chunks"] == 7 and info["embedding_model"] == "hashing-16" and index.index_info(spark, f"{tmp_path}/x") == {}
    with pytest.raises(ValueError):
        index.load_index(spark, f"{tmp_path}/i", index.HashingEmbedder(8))
    loaded = index.load_index(spark, f"{tmp_path}/i", e)
    assert loaded["vectors"].count() == 60
    assert index.find_index(spark, "", [f"{tmp_path}/none", f"{tmp_path}/i"]) == f"{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        index.find_index(spark, "nowhere", [])
    qs = spark.createDataFrame([(1, "ka lo")], "q_id long, question string")
    same = retrieve.retrieve(qs, index.memory_index(df, e), e, 5).select("q_id", "rank", "chunk_pos")
    assert sorted(map(tuple, retrieve.retrieve(qs, loaded, e, 5).select("q_id", "rank", "chunk_pos").collect())) == sorted(map(tuple, same.collect()))


def test_embedders():
    e = index.make_embedder(Config(embedding_model="hashing-32"))
    v = e.embed_documents(["ka lo ka", "", None])
    assert v.shape == (3, 32) and np.isclose(np.linalg.norm(v[0]), 1) and not v[1].any()
    p = index.make_embedder(Config(embedding_model="some/e5-base"))
    assert isinstance(p, index.PrefixEmbedder) and p.name == "some/e5-base"
    q = index.PrefixEmbedder(e)
    assert np.allclose(q.embed_query("ka"), e.embed_query("query: ka"))


def test_streamed_questions(spark, tmp_path):
    df, _ = passages(spark)
    e = index.HashingEmbedder(16)
    spark.createDataFrame([(1, "ka lo"), (2, "vi")], "q_id long, question string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q_id long, question string").parquet(f"{tmp_path}/in")
    retrieve_stream(stream, index.memory_index(df, e), e, f"{tmp_path}/out", f"{tmp_path}/state", 3).awaitTermination(120)
    assert sorted(r["q_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 1, 1, 2, 2, 2]


# --- answers ------------------------------------------------------------------------


class Says:
    """A generator with fixed answers by question; the last part of a list repeats."""

    name = "says"

    def __init__(self, answers):
        self.answers = answers

    def generate(self, prompt):
        for key, value in self.answers.items():
            if key in prompt:
                if isinstance(value, Exception):
                    raise value
                return value[1] if isinstance(value, tuple) and "These passages bear" in prompt else value[0] if isinstance(value, tuple) else value
        return "nothing"


def asked(spark, answers, questions, messages=answer.Messages(), found=None):
    qs = spark.createDataFrame(questions, "q_id long, question string")
    rows = [(q, r, f"{t} ka. More", f"c{r}", f"sec{r}" if r > 1 else f"c{r}", "http://x" if r == 1 else "") for q, t in questions if t and t.strip() and (found is None or q in found) for r in (1, 2, 3)]
    retrieved = spark.createDataFrame(rows, "q_id long, rank long, text string, chapter string, section string, source string")
    return {r["q_id"]: r for r in answer.answer_questions(qs, retrieved, Says(answers), messages).collect()}


def test_answer_paths(spark):
    got = asked(
        spark,
        {"q-cited": "Yes [2, 3] [9]", "q-bare": "Answer: Yes", "q-none": "not found", "q-retry": ("not found", "It is [2]"), "q-again": ("not found", "cannot answer"), "q-limit": RuntimeError("Error 429"), "q-uncited": ("not found", "It is so")},
        [(1, "q-cited"), (2, "q-bare"), (3, "q-none zz"), (4, "q-retry"), (5, "q-limit"), (6, ""), (7, "  "), (8, None), (9, "q-lost"), (10, "q-uncited"), (11, "q-again")],
        found={1, 2, 3, 4, 5, 10, 11},
    )
    assert (got[1]["citations"], got[1]["found"], [s["chapter"] for s in got[1]["sources"]]) == ([2, 3], True, ["c2", "c3"])
    assert (got[2]["answer"], got[2]["citations"]) == ("Yes [1]", [1])
    assert (got[4]["answer"], got[4]["citations"], got[4]["found"]) == ("It is [2]", [2], True)
    assert (got[5]["error"], got[5]["found"], got[5]["citations"], got[5]["retrieved_ranks"]) == (answer.RATE_LIMITED, False, [], [1, 2, 3])
    for i in (6, 7, 8):
        assert got[i]["answer"] == lang.EMPTY_QUESTION and not got[i]["found"]
    assert got[9]["answer"] == "not found" and not got[9]["found"] and got[9]["sources"] == []
    assert (got[10]["answer"], got[10]["citations"]) == ("It is so [1]", [1])
    assert not got[11]["found"] and not got[3]["found"]
    with pytest.raises(Exception, match="broken"):
        asked(spark, {"q": RuntimeError("broken")}, [(1, "q")])


def test_place_rule(spark):
    q = lang.nfc("q-place কোথায়?")
    rule = answer.PlaceRule(("ka", "more"), "At ka.")
    got = asked(spark, {"q-place": "not found"}, [(1, q)], answer.Messages(place_rules=(answer.PlaceRule(("zz",), "no"), rule)))
    assert (got[1]["answer"], got[1]["citations"], got[1]["found"]) == ("At ka.", [1], True)


def test_context(spark):
    rows = [(1, 2, " b ", "", "S", None), (1, 1, "a", "C", "C", "u"), (1, 10, "j", None, None, "")]
    df = spark.createDataFrame(rows, "q_id long, rank long, text string, chapter string, section string, source string")
    c, s, u = lang.LABEL_CHAPTER, lang.LABEL_SOURCE, lang.LABEL_UNKNOWN
    assert answer.contexts(df).first()["context"] == f"[1] {c}: C | {s}: u\na\n\n[2] {c}: S\nb\n\n[10] {c}: {u}\nj"


def test_ask_end_to_end(spark):
    df, _ = passages(spark)
    e = index.HashingEmbedder(16)
    qs = spark.createDataFrame([(1, "ka lo"), (2, "")], "q_id long, question string")
    got = {r["q_id"]: r for r in answer.ask(qs, index.memory_index(df, e), e, answer.ExtractiveGenerator(), 0).collect()}
    assert got[1]["found"] and got[1]["citations"] == [1] and got[1]["retrieved_ranks"] == [1] and not got[2]["found"]


# --- evaluation ---------------------------------------------------------------------


def test_hits(spark):
    rows = [("c1", "a key", ["c1"], ["key"], True), ("c2", "a key", ["c1"], ["key"], False), ("c1", "none", ["c1"], ["key"], False), ("c1", "none", ["c1"], [], True), ("c9", "a key", [], ["no", "key"], True), ("c9", "x", [], [], False), (None, "key", ["c1"], ["key"], False)]
    df = spark.createDataFrame(rows, "c string, t string, e array<string>, k array<string>, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", evaluate.is_hit(F.col("c"), F.col("t"), F.col("e"), F.col("k")).alias("got")).collect())


def test_rates_without_questions(spark):
    firsts = spark.createDataFrame([], "q_id long, rank long")
    assert [r["rate"] for r in evaluate.hit_rates(firsts).collect()] == [None] * 3
    some = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 3)], "q_id long, rank long")
    assert [(r["k"], r["hits"], r["rate"]) for r in evaluate.hit_rates(some).orderBy("k").collect()] == [(1, 1, 0.25), (3, 2, 0.5), (5, 3, 0.75)]


def test_locate_and_fill(spark):
    ch = spark.createDataFrame([("A", 1, "aaa x.y aa"), ("B", 2, "aa"), ("C", None, "aaaaaa")], "chapter string, chapter_no int, text string")
    qs = spark.createDataFrame([(1, True, ["aa"], []), (2, True, ["x.y"], ["Z"]), (3, False, ["aa"], []), (4, True, ["none"], [])], "q_id long, answerable boolean, evidence_keywords array<string>, expected_source array<string>")
    found = {(r["q_id"], r["chapter"]): r["n"] for r in evaluate.locate(qs, ch).collect()}
    assert found == {(1, "A"): 2, (1, "B"): 1, (1, "C"): 3, (2, "A"): 1}
    filled = {r["q_id"]: r["expected_source"] for r in evaluate.fill_sources(qs, ch).collect()}
    assert filled == {1: ["C", "A"], 2: ["Z"], 3: [], 4: []}


def test_behaviour_and_tables(spark):
    source = [(1, "c1", "s1", "u", "t")]
    responses = spark.createDataFrame([(1, "a|b", True, source), (2, "x", True, source), (3, "n", False, []), (4, "y", True, source)], "q_id long, answer string, found boolean, sources array<struct<citation:int,chapter:string,section:string,source:string,text:string>>")
    qs = spark.createDataFrame([(1, "q1", "e", True, ["c1"]), (2, "q2", "e", True, ["c2"]), (3, "q3", "e", False, []), (4, "q4", "e", False, [])], "q_id long, question string, expected_answer string, answerable boolean, expected_source array<string>")
    report = evaluate.behaviour(responses, qs)
    assert {r["q_id"]: r["ok"] for r in report.collect()} == {1: True, 2: False, 3: True, 4: False}
    md = evaluate.qa_table(report, "header")
    assert "a\\|b" in md and "**2/4**" in md and "[1] s1" in md
    assert "not in the book" in evaluate.question_table(qs)


def test_compare(spark):
    ch = spark.createDataFrame([("B", "A", "t", "one", 1, "u1", "ka lo mi\n" * 30), ("B", "A", "t", "two", 2, "u2", "su ter nal\n" * 30)], "book string, author string, title string, chapter string, chapter_no int, url string, text string")
    qs = spark.createDataFrame([(1, "ka lo mi", True, ["ka"], ["one"]), (2, "su ter", True, [], ["two"]), (3, "zz", False, [], [])], "q_id long, question string, answerable boolean, evidence_keywords array<string>, expected_source array<string>")
    rows = evaluate.compare_chunkings(ch, qs, ["60:10", "120:20"], index.HashingEmbedder(32)).orderBy("approach").collect()
    assert [r["hit_at_1"] for r in rows] == [1.0, 1.0] and rows[0]["n_chunks"] < rows[1]["n_chunks"]
    md = evaluate.comparison_table(spark.createDataFrame(rows), "T")
    assert "100%" in md and evaluate.parse_sizes("400:80") == (400, 80)
    two = evaluate.compare_embedders(ch, qs, [index.HashingEmbedder(16), index.HashingEmbedder(64)])
    assert two.count() == 2


def test_chat_generator(monkeypatch):
    """The request that a chat model gets, its answer, quota and other errors."""
    import json

    sent = []

    def transport(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body)))
        asked = sent[-1][2]["messages"][0]["content"]
        if asked == "quota":
            return 429, b"later"
        if asked == "bad":
            return 400, b"no"
        return 200, json.dumps({"choices": [{"message": {"content": asked.upper()}}]}).encode() if asked else b"{}"

    g = answer.ChatGenerator("https://h/v1/", "some-model", "A_KEY", transport=transport)
    monkeypatch.setenv("A_KEY", " secret ")
    assert g.generate("hello") == "HELLO" and g.generate("") == ""
    url, headers, body = sent[0]
    assert url == "https://h/v1/chat/completions" and headers["Authorization"] == "Bearer secret" and body["model"] == "some-model"
    with pytest.raises(answer.RateLimit):
        g.generate("quota")
    with pytest.raises(RuntimeError, match="400"):
        g.generate("bad")


def test_many_queries_leave_the_native_way(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieve, "CELLS", 8)
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(20)], "chunk_pos long, embedding array<double>")
    q = v.select(F.col("chunk_pos").alias("q_id"), "embedding")
    few = sorted(map(tuple, retrieve.dense_topk_native(q.where("q_id < 3"), v, 4).collect()))
    assert few == sorted(map(tuple, retrieve.dense_topk(q.where("q_id < 3"), v, 4).collect()))
    assert len(retrieve.dense_topk_native(q, v, 4).collect()) == 80

