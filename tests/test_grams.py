"""Keywords located by rare grams against plain search."""

import random

import numpy as np

from passagelake.operators import evaluate, grams


def brute(keywords, bodies):
    return sorted((k, c, n, b.count(k)) for k in keywords for c, n, b in bodies if k in b)


def run(spark, keywords, bodies):
    k = spark.createDataFrame([(x,) for x in keywords], "keyword string")
    b = spark.createDataFrame(bodies, "chapter string, chapter_no int, text string")
    return sorted((r["keyword"], r["chapter"], r["chapter_no"], r["n"]) for r in grams.occurrences(k, b).collect())


def test_grams_of_a_text():
    assert len(grams.grams("abcabc", 3)) == 3 and len(grams.grams("ab", 3)) == 0 and len(grams.grams("", 1)) == 0
    assert set(grams.grams("xabcdefghy", 8)) >= set(grams.grams("abcdefgh", 8))
    assert not set(grams.grams("ab", 1)) & set(grams.grams("ab", 2))


def test_against_plain_search(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé漢😀 .") for _ in range(n))
    bodies = [(f"c{i}", i, text(rng.choice([0, 1, 5, 200, 3000]))) for i in range(30)]
    bodies += [("c1", 1, "same"), ("c1", 1, "same"), ("c2", 2, "aaaa" * 20)]
    keywords = {"a", "ab", "same", "aaa", "aaaaaaaaaa", "never there", "é漢", "😀", ".", "[.]*", "漢" * 9}
    for c, _, b in bodies:
        if len(b) > 50:
            at = rng.randrange(len(b) - 40)
            keywords |= {b[at : at + 12], b[at : at + 40], b[at : at + 8], b[at : at + 3] + "zz", b[at : at + 20] + "!"}
    assert run(spark, sorted(keywords), bodies) == brute(sorted(keywords), bodies)


def test_nothing_to_find(spark):
    assert run(spark, [], [("c", 1, "text")]) == [] and run(spark, ["text"], []) == [] and run(spark, ["x"], [("c", 1, "")]) == []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(grams, "FILTER_BITS", 64)
    bodies = [(f"c{i}", i, f"the number {i} of the chapters of the book {i * i}") for i in range(40)]
    keywords = [f"number {i} of" for i in range(60)] + ["the chapters of the"]
    assert run(spark, keywords, bodies) == brute(keywords, bodies)


def test_both_ways_agree(spark, monkeypatch):
    qs = spark.createDataFrame([(1, True, ["river", "dawn", ""]), (2, True, ["dawn", "stair"]), (3, False, ["river"]), (4, True, None)], "q_id long, answerable boolean, evidence_keywords array<string>")
    ch = spark.createDataFrame([("one", 1, "river at dawn, river"), ("two", 2, None), ("three", None, "the stair")], "chapter string, chapter_no int, text string")
    plain = lambda x: sorted(map(str, x.collect()))
    one = plain(evaluate.locate(qs, ch))
    assert len(one) == 4 and plain(evaluate.locate_by_grams(qs, ch)) == one
    monkeypatch.setattr(evaluate, "KEYWORD_BLOCK", 2)
    assert plain(evaluate.locate(qs, ch)) == one


def test_the_filter_passes_what_was_put_in():
    bits = np.zeros(4, np.int64)
    for g in (-1, -(2**63), 5):
        bits[(g & 255) >> 6] |= np.int64(1) << np.int64(g & 63)
    assert grams.passes(bits, np.array([-1, -(2**63), 5])).all() and not grams.passes(bits, np.array([6, 77])).any()
