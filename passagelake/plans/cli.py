"""Command lines: asking and evaluating.

    python -m passagelake.plans.cli ask --index DIR "question" [--k 5] [--debug]
    python -m passagelake.plans.cli evaluate --questions FILE --chapters DIR --index DIR
        [--locate [--write]] [--write-table] [--retrieval] [--qa [--delay 20]]
        [--compare-chunking 400:80 800:150] [--compare-embeddings MODEL ...]
"""

from __future__ import annotations

import argparse
import pathlib
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..config import Config, from_environment
from ..operators import answer, evaluate, index, retrieve
from ..sources import files


def ask(spark: SparkSession, path: str, question: str, k: int | None, debug: bool, conf: Config, generator: answer.Generator) -> str:
    """What the console prints: the answer and its sources, or the ranked passages."""
    embedder = index.make_embedder(conf)
    ix = index.load_index(spark, path, embedder)
    q = spark.createDataFrame([(1, question)], "q_id long, question string")
    if debug:
        found = retrieve.retrieve(q, ix, embedder, k or conf.final_k, conf)
        return "\n\n".join(r["line"] for r in files.console_lines(found).orderBy("rank").collect())
    row = answer.ask(q, ix, embedder, generator, k, conf).first()
    return "\n".join([row["answer"], *[f"[{s['citation']}] {s['section'] or s['chapter'] or ''} {s['source'] or ''}".rstrip() for s in row["sources"]]])


def run_evaluation(spark: SparkSession, a: argparse.Namespace, conf: Config, generator: answer.Generator) -> dict[str, str]:
    """The reports that were asked for, by name; also written to ``a.results``."""
    embedder = index.make_embedder(conf)
    questions = files.read_questions(spark, a.questions)
    out: dict[str, str] = {}
    if a.locate:
        chapters = files.read_chapters(spark, a.chapters)
        if a.write:
            questions = evaluate.fill_sources(questions, chapters).cache()
            files.write_questions(questions, a.questions)
        lines = evaluate.located_lines(evaluate.locate(questions, chapters)).orderBy("q_id", "place")
        out["located"] = "\n".join(r["line"] for r in lines.collect())
    if a.write_table or a.write:
        out["questions"] = evaluate.question_table(questions)
    if a.retrieval:
        firsts = evaluate.dense_hits(questions, index.load_index(spark, a.index, embedder), embedder).cache()
        rates = evaluate.hit_rates(firsts).orderBy("k").collect()
        out["retrieval"] = "\n".join([f"Hit@{r['k']}: {'-' if r['rate'] is None else format(r['rate'], '.0%')}" for r in rates] + [f"Q{r['q_id']}: {r['rank']}" for r in firsts.orderBy("q_id").collect()])
    if a.qa:
        ix = index.load_index(spark, a.index, embedder)
        responses = answer.ask(questions, ix, embedder, generator, conf=conf, delay=a.delay)
        out["qa_results"] = evaluate.qa_table(evaluate.behaviour(responses, questions), f"Generator: {generator.name}; embeddings: {embedder.name}; chunks {conf.chunk_size}/{conf.chunk_overlap}; top {conf.context_k}")
    if a.compare_chunking:
        rows = evaluate.compare_chunkings(files.read_chapters(spark, a.chapters), questions, a.compare_chunking, embedder)
        out["chunkings"] = evaluate.comparison_table(rows, f"Chunkings ({embedder.name})")
    if a.compare_embeddings:
        models = [index.make_embedder(Config(**{**conf.__dict__, "embedding_model": m})) for m in a.compare_embeddings]
        out["embeddings"] = evaluate.comparison_table(evaluate.compare_embedders(files.read_chapters(spark, a.chapters), questions, models, conf), f"Embedders (chunks {conf.chunk_size}/{conf.chunk_overlap})")
    pathlib.Path(a.results).mkdir(parents=True, exist_ok=True)
    for name, body in out.items():
        files.write_report(body + "\n", f"{a.results}/{name}.md")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("ask")
    q.add_argument("question")
    q.add_argument("--index", default="")
    q.add_argument("--k", type=int)
    q.add_argument("--debug", action="store_true", help="the ranked passages instead of an answer")
    e = sub.add_parser("evaluate")
    e.add_argument("--questions", required=True)
    e.add_argument("--chapters", default="data/chapters")
    e.add_argument("--index", default="index")
    e.add_argument("--results", default="results")
    for flag in ("locate", "write", "write-table", "retrieval", "qa"):
        e.add_argument(f"--{flag}", action="store_true")
    e.add_argument("--delay", type=float, default=20.0)
    e.add_argument("--compare-chunking", nargs="+", metavar="SIZE:OVERLAP")
    e.add_argument("--compare-embeddings", nargs="+", metavar="MODEL")
    return p


def main(args: Sequence[str] | None = None, generator: answer.Generator | None = None) -> None:
    a = parser().parse_args(args)
    conf, generator = from_environment(), generator or answer.ExtractiveGenerator()
    spark = SparkSession.builder.getOrCreate()
    if a.command == "ask":
        print(ask(spark, index.find_index(spark, a.index), a.question, a.k, a.debug, conf, generator))
        return
    for name, body in run_evaluation(spark, a, conf, generator).items():
        print(f"## {name}\n{body}\n")


if __name__ == "__main__":
    main()
