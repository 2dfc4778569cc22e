"""What the review of round 4 found, each with what would have failed before."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from passagelake.functions import lang, text
from passagelake.plans.queries import QUERIES, SQL


def by_sql(folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(SQL[name]).fetchall(), key=repr)


def test_passages_of_questions_with_few_hits(spark, tmp_path):  # pairs that share a term were shuffled, and only those were ranked
    texts = ["alpha beta", "gamma", None, "alpha alpha delta", "", "beta gamma", "epsilon"]
    docs = [(10 * i + 3, x, "s", "en", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(1, "alpha"), (2, "beta gamma delta epsilon"), (3, "unheard"), (4, ""), (5, None), (6, "gamma unheard")]
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["bm25_passages"](spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == by_sql(tmp_path, "bm25_passages", "documents", "benchmark") and len(rows) == 30
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()  # the texts are not shuffled


def turns(spark, folder):
    odd = ["plain", "", " ", None, "\u200c\u200d", "[] <>", "a\u200cb —\u2003c\n\n d", "\x1c\x85x\u3000", "\u2028\u00a0 ‌ \t", "Ünï  CODE", "x" * 3000 + " y"]
    odd += lang.nfc(["তাহার মৃত্যু  কলকাতা", "বিয়ে বাড়ি", "সে কে", "কে\u00a0?", "[কে]", "কোন সময়", "কী\u200dভাবে", "বিবাহ স্বামী পতি"])
    rows = [(i, j, "user", x) for i in range(12) for j, x in enumerate(odd)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return len(rows) - 12


@pytest.mark.parametrize("name, lowered", [("expanded_queries", 3), ("question_types", 1), ("hint_score", 2)])
def test_questions_are_normalised_once(spark, tmp_path, name, lowered):  # once for each word that was looked for, and once more for a filter
    n = turns(spark, tmp_path)
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == by_sql(tmp_path, name, "conversations")
    assert name != "expanded_queries" or got.count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= lowered and plan.count("Contains(") < 80


def test_white_space(spark):
    rng = random.Random(4)
    signs = [c for c in map(chr, range(0x3100)) if c.isspace()] + list("ab—–[]<>|*_#`~\u200b\u200c\u200d\u180e\ufeffক😀$\\")
    rows = ["", None, *signs, *("".join(rng.choices(signs, k=rng.randrange(1, 12))) for _ in range(3000))]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    got = df.select("x", text.strip("x").alias("s"), text.collapse("x").alias("c"), text.normalize_text("x").alias("n")).collect()
    # the patterns that stood here before
    was = df.select(F.regexp_replace("x", rf"^[{text.SPACE}]+|[{text.SPACE}]+$", "").alias("s"), F.trim(F.regexp_replace("x", rf"[{text.SPACE}]+", " ")).alias("c")).collect()
    assert [(r["s"], r["c"]) for r in got] == [(r["s"], r["c"]) for r in was]
    for r in got:
        plain = re.sub(f"[{re.escape(text.BRACKETS)}]", " ", re.sub("[—–]", "-", re.sub("[\u200c\u200d]", "", r["x"] or "")))
        assert r["n"] == " ".join(plain.split()).lower()
