"""Building, asking and evaluating from the command line, on a small book."""

import json

from passagelake.config import Config
from passagelake.operators import index
from passagelake.plans import build, cli
from passagelake.sources import files

TEXTS = {"one": "The ferry crossed the wide river at dawn.\n" * 6, "two": "A lantern hung above the narrow stair.\n" * 6}


def test_build_ask_and_evaluate(spark, tmp_path, capsys):
    rows = [("B", "A", f"B/{c}", c, n, f"http://x/{c}", t) for n, (c, t) in enumerate(TEXTS.items(), 1)]
    ch = spark.createDataFrame(rows, "book string, author string, title string, chapter string, chapter_no int, url string, text string")
    files.write_chapters(ch, f"{tmp_path}/chapters")
    conf = Config(chunk_size=120, chunk_overlap=20)
    build.build(spark, files.read_chapters(spark, f"{tmp_path}/chapters"), f"{tmp_path}/index", conf, "B")
    info = index.index_info(spark, f"{tmp_path}/index")
    assert info["chapters"] == ["one", "two"] and info["num_chapters"] == 2 and info["num_chunks"] > 2
    assert build.chapter_totals(ch).first()["characters"] == sum(map(len, TEXTS.values()))
    q = tmp_path / "q.json"
    rows = [{"id": 1, "question": "ferry river", "expected_answer": "dawn", "answerable": True, "evidence_keywords": ["ferry"], "expected_source": []}, {"id": 2, "question": "lantern stair", "expected_answer": "above", "answerable": True, "evidence_keywords": ["lantern"], "expected_source": ["two"]}]
    q.write_text(json.dumps(rows), encoding="utf-8")
    common = ["evaluate", "--questions", str(q), "--chapters", f"{tmp_path}/chapters", "--index", f"{tmp_path}/index", "--results", f"{tmp_path}/results"]
    cli.main([*common, "--locate", "--write", "--retrieval", "--qa", "--delay", "0", "--compare-chunking", "120:20"])
    said = capsys.readouterr().out
    assert "Hit@1: 100%" in said and "**2/2**" in said and "chunk_size=120, overlap=20" in said
    assert json.loads(q.read_text(encoding="utf-8"))[0]["expected_source"] == ["one"]
    assert (tmp_path / "results" / "qa_results.md").exists()
    cli.main(["ask", "lantern stair", "--index", f"{tmp_path}/index"])
    assert "lantern" in capsys.readouterr().out
    cli.main(["ask", "lantern stair", "--index", f"{tmp_path}/index", "--debug", "--k", "2"])
    assert "#1 score=" in capsys.readouterr().out
