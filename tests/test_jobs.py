"""The jobs: growing input, reruns, odd rows, command lines."""

import json
import os
import pathlib
import re
import subprocess
import sys

import pytest
from pyspark.sql import Row

from jobs import chat_digest, refresh_passages
from jobs.common import configured
from jobs.queries import QUERIES, SQL
from passagelake.functions import lang
from passagelake.functions.chunk import split_text

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("append").parquet(path)


BODY = "One sentence here. Another one there? A third, which is somewhat longer! " * 12


def expected(rows, size, overlap):
    out = []
    for doc_id, text, language, source, _ in rows:
        parts = split_text(text, size, overlap)
        for i, (start, part) in enumerate(parts, 1):
            out.append((doc_id, i, len(parts), start, part, source, language or "und"))
    return sorted(out, key=str)


def found(spark, output):
    rows = refresh_passages.passages(spark, output).collect()
    return sorted(((r["chapter_no"], r["chunk_index"], r["chunks_in_chapter"], r["start_index"], r["text"], r["source"], r["lang_key"]) for r in rows), key=str)


def test_passages_of_growing_input(spark, tmp_path):
    settings = refresh_passages.Settings(chunk_size=200, chunk_overlap=40, files_per_batch=1)
    inputs, output, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    first = [(1, BODY, "en", "a", 3), (2, None, "en", "a", 0), (3, "  \n ", None, None, 0), (4, "short", "", "b", 5)]
    documents(spark, inputs, first)
    assert refresh_passages.refresh(spark, inputs, output, checkpoint, settings) == {"documents": 4, "passages": len(expected(first, 200, 40))}
    assert found(spark, output) == expected(first, 200, 40)
    # nothing new
    assert refresh_passages.refresh(spark, inputs, output, checkpoint, settings) == {"documents": 0, "passages": 0}
    assert found(spark, output) == expected(first, 200, 40)
    # two more files, in batches of one file
    second, third = [(5, BODY[:300], "fr", "b", 1), (None, "no id", "fr", "b", 1)], [(5, "again " * 90, "fr", "b", 1)] * 2
    documents(spark, inputs, second)
    documents(spark, inputs, third)
    counts = refresh_passages.refresh(spark, inputs, output, checkpoint, settings)
    assert counts == {"documents": 4, "passages": len(expected(second + third, 200, 40))}
    assert found(spark, output) == expected(first + second + third, 200, 40)
    assert sorted(p.name for p in pathlib.Path(output).iterdir() if p.is_dir() and "=" in p.name) == ["lang_key=en", "lang_key=fr", "lang_key=und"]


def test_a_run_that_fails_is_made_good(spark, tmp_path, monkeypatch):
    """The second batch of a run fails; the next run writes what is missing, once."""
    settings = refresh_passages.Settings(chunk_size=200, chunk_overlap=40, files_per_batch=1)
    inputs, output, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    rows = [(i, BODY[: 100 * i], "en", "a", 1) for i in range(1, 4)]
    for r in rows[:2]:
        documents(spark, inputs, [r])
    broken = pathlib.Path(inputs) / "zz-broken.parquet"
    broken.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        refresh_passages.refresh(spark, inputs, output, checkpoint, settings)
    broken.unlink()
    documents(spark, f"{tmp_path}/more", [rows[2]])
    next(pathlib.Path(f"{tmp_path}/more").glob("*.parquet")).rename(broken)
    refresh_passages.refresh(spark, inputs, output, checkpoint, settings)
    assert found(spark, output) == expected(rows, 200, 40)


def test_passages_of_one_file_and_of_no_file(spark, tmp_path):
    documents(spark, f"{tmp_path}/in", [(1, "text", "en", "a", 4)])
    one = str(next(pathlib.Path(f"{tmp_path}/in").glob("*.parquet")))
    for n in (1, 0):
        assert refresh_passages.refresh(spark, one, f"{tmp_path}/out", f"{tmp_path}/checkpoint") == {"documents": n, "passages": n}
    (tmp_path / "empty").mkdir()
    assert refresh_passages.refresh(spark, f"{tmp_path}/empty", f"{tmp_path}/none", f"{tmp_path}/other")["documents"] == 0


def test_refresh_changes_no_setting(spark, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll
    documents(spark, f"{tmp_path}/in", [(1, "text", "en", "a", 4)])
    refresh_passages.refresh(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll) == before


# --- digest -------------------------------------------------------------------------

NO = lang.ABSTENTION[0]
WHERE = lang.nfc(["নায়ক কোথায় মারা যায়?"])[0]
TURNS = [
    (1, 0, "user", "Who is  HE?"), (1, 1, "assistant", "```text\nHe is one [2].\n```"), (1, 2, "user", "who is he?"), (1, 3, "assistant", f"so {NO} it is"),
    (2, 5, "user", "Who is he?"), (2, 6, "user", "And now?"), (2, 7, "assistant", "Nothing cited [11]"), (2, 8, "user", "   "),
    (3, 0, "user", WHERE), (3, 2, "assistant", "too late [1]"), (3, 4, "system", "x"), (None, 1, "user", "lost"), (3, None, "user", "lost"), (4, 1, None, "lost"),
    (4, 2, "user", None), (5, 1, "user", "twice b"), (5, 1, "user", "twice a"), (5, 2, "assistant", "  "),
]


def test_digest(spark):
    got = {r["question_key"]: r for r in chat_digest.digest(spark.createDataFrame(TURNS, chat_digest.TURNS)).collect()}
    assert set(got) == {"who is he?", "and now?", "twice a", WHERE}
    he = got["who is he?"]
    assert (he["asked"], he["conversations"], he["cited"], he["uncited"], he["abstained"], he["unanswered"], he["outcome"]) == (3, 2, 1, 0, 1, 1, "cited")
    assert (he["first_conv_id"], he["first_turn"], he["question"], he["answer"], he["terms"]) == (1, 0, "Who is  HE?", "He is one [2].", "who is he")
    assert got["and now?"]["outcome"] == "uncited" and got["twice a"]["outcome"] == "unanswered"
    assert got[WHERE]["kind"] == "where" and got[WHERE]["outcome"] == "unanswered"


def test_digest_reruns_and_settings(spark, tmp_path):
    spark.createDataFrame([Row(conv_id=c, turn=t, role=r, text=x, outcome="clash", first=1) for c, t, r, x in TURNS], chat_digest.TURNS + ", outcome string, first int").write.parquet(f"{tmp_path}/turns")
    settings = chat_digest.Settings(most_passages=11)
    shown = []
    for _ in range(2):
        assert chat_digest.write_digest(spark, f"{tmp_path}/turns", f"{tmp_path}/out", settings) == {"turns": len(TURNS), "unplaced": 3, "questions": 4}
        shown.append(sorted(map(tuple, chat_digest.read_digest(spark, f"{tmp_path}/out").collect())))
    assert shown[0] == shown[1] and len(shown[0]) == 4
    assert {p.name for p in pathlib.Path(f"{tmp_path}/out").glob("outcome=*")} == {"outcome=cited", "outcome=unanswered"}
    # an outcome that goes leaves no rows behind
    spark.createDataFrame(TURNS[:2], chat_digest.TURNS).write.parquet(f"{tmp_path}/fewer")
    chat_digest.write_digest(spark, f"{tmp_path}/fewer", f"{tmp_path}/out", settings)
    assert [r["outcome"] for r in chat_digest.read_digest(spark, f"{tmp_path}/out").collect()] == ["cited"]


def test_digest_of_nothing_and_of_one_question(spark, tmp_path):
    spark.createDataFrame([], chat_digest.TURNS).write.parquet(f"{tmp_path}/turns")
    assert chat_digest.write_digest(spark, f"{tmp_path}/turns", f"{tmp_path}/out")["questions"] == 0
    assert chat_digest.read_digest(spark, f"{tmp_path}/out").count() == 0
    same = spark.range(20_000).selectExpr("id % 7 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id % 2 = 0, 'Same?', 'yes [1]') as text")
    only = chat_digest.digest(same).collect()
    assert len(only) == 1 and only[0]["asked"] == 10_000 and only[0]["conversations"] == 7


# --- the rest -----------------------------------------------------------------------


def test_configuration(spark, tmp_path):
    for kind, name in ((refresh_passages.Settings, "refresh_passages"), (chat_digest.Settings, "chat_digest")):
        assert configured(spark, kind, (ROOT / "jobs" / f"{name}.json").as_uri()) == kind() == configured(spark, kind, None)
    (tmp_path / "wrong.json").write_text(json.dumps({"sizes": 3}))
    with pytest.raises(ValueError, match="sizes"):
        configured(spark, chat_digest.Settings, str(tmp_path / "wrong.json"))


def test_jobs_stand_alone():
    for path in [*ROOT.joinpath("jobs").glob("*.py"), pathlib.Path(__file__)]:
        assert not re.search(r"^\s*(?:from|import)\s+\S*(?:\bllm\b|corpus_pipeline)", path.read_text(), re.M)


def test_command_lines(spark, tmp_path):
    spark.createDataFrame(TURNS, chat_digest.TURNS).write.parquet(f"{tmp_path}/turns")
    documents(spark, f"{tmp_path}/in", [(1, BODY, "en", "a", 1)])
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    done = run("jobs.chat_digest", "--conversations", f"{tmp_path}/turns", "--output", f"{tmp_path}/digest")
    assert done.returncode == 0 and "wrote 4 questions" in done.stderr, done.stderr[-2000:]
    done = run("jobs.refresh_passages", "--documents", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint")
    assert done.returncode == 0 and "read 1 documents" in done.stderr, done.stderr[-2000:]
    assert found(spark, f"{tmp_path}/out") == expected([(1, BODY, "en", "a", 1)], 800, 150)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_job_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA), con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
