"""Evaluation: where the evidence is, hit rates, comparisons, behaviour."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text
from ..sources import files
from .answer import citation_label
from .grams import occurrences
from .index import Embedder, embedded, split_chapters_by, vectors_of, with_positions
from .retrieve import dense_topk, ranked

KS = (1, 3, 5)


def is_hit(chapter: Column, body: Column, expected: Column, keywords: Column) -> Column:
    """In an expected chapter (if any are named) and with a keyword (if any are)."""
    sources, words = F.coalesce(expected, F.array().cast("array<string>")), F.coalesce(keywords, F.array().cast("array<string>"))
    return F.when((F.size(sources) > 0) & ~F.coalesce(F.array_contains(sources, chapter), F.lit(False)), F.lit(False)).when(F.size(words) > 0, F.exists(words, lambda k: F.contains(body, k))).otherwise(F.size(sources) > 0)


def first_hit(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, rank, top_chapters) of every question: the rank of the first hit (null:
    none). ``found`` is (q_id, rank, chapter, text)."""
    rows = questions.select("q_id", "expected_source", "evidence_keywords").join(found, "q_id", "left")
    hit = is_hit(F.col("chapter"), F.col("text"), F.col("expected_source"), F.col("evidence_keywords"))
    return rows.groupBy("q_id").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"), F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "chapter")))), lambda x: x["chapter"]).alias("top_chapters"))


def hit_rates(firsts: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(k, hits, n, rate): one row per k; the rate of no questions is null."""
    aggs = [F.coalesce(F.sum((F.col("rank") <= k).cast("bigint")), F.lit(0)).alias(f"h{k}") for k in ks]
    one = firsts.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"h{k}").alias("hits"), F.col("n")) for k in ks])).alias("r")
    return one.select(rows).select("r.k", "r.hits", "r.n", F.when(F.col("r.n") > 0, F.col("r.hits") / F.col("r.n")).alias("rate"))


def dense_hits(questions: DataFrame, index: dict[str, DataFrame], embedder: Embedder, ks: Sequence[int] = KS) -> DataFrame:
    """First hits of dense retrieval over the answerable questions."""
    q = questions.where("answerable").withColumn("question", text.nfc("question"))
    vectors = embedded(q.select("q_id", F.col("question").alias("text")), embedder, query=True).select("q_id", "embedding")
    found = dense_topk(vectors, index["vectors"], max(ks)).join(index["chunks"].select("chunk_pos", "chapter", "text"), "chunk_pos")
    return first_hit(found, q)


#: Keywords that one pass over the chapters looks for.
KEYWORD_BLOCK = 4096


def _finder(words: Sequence[str]):
    """The keywords that a text holds: one pass of an Aho-Corasick automaton, or one
    search a keyword where that package is missing."""
    try:
        import ahocorasick
    except ImportError:
        return lambda body: [k for k in words if k in body]
    automaton = ahocorasick.Automaton()
    for k in words:
        automaton.add_word(k, k)
    automaton.make_automaton()
    return lambda body: {k for _, k in automaton.iter(body)}


def _occurrences(shared):
    def run(batches):
        find = _finder(shared.value)
        for batch in batches:
            rows = ([], [], [], [])
            for chapter, number, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k in find(body):
                    for out, value in zip(rows, (chapter, number, k, body.count(k))):
                        out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], batch.column(1).type), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.int64())], ["chapter", "chapter_no", "keyword", "n"])

    return run


def _keywords(questions: DataFrame) -> DataFrame:
    return questions.where("answerable").select("q_id", F.explode("evidence_keywords").alias("keyword")).where("keyword <> ''").distinct()


def _bodies(chapters: DataFrame) -> DataFrame:
    return chapters.select("chapter", "chapter_no", text.nfc(F.coalesce("text", F.lit(""))).alias("text"))


def locate(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """(q_id, chapter, chapter_no, keyword, n): non-overlapping occurrences of each
    keyword. Up to ``KEYWORD_BLOCK`` keywords are held by every worker and looked for in one
    pass; more stay a table (:func:`locate_by_grams`)."""
    keys, body = _keywords(questions), _bodies(chapters)
    held = [r["keyword"] for r in keys.select("keyword").distinct().take(KEYWORD_BLOCK + 1)]
    if len(held) > KEYWORD_BLOCK:
        return locate_by_grams(questions, chapters)
    schema = f"chapter string, chapter_no {body.schema['chapter_no'].dataType.simpleString()}, keyword string, n bigint"
    found = files.bounded(body).mapInArrow(_occurrences(body.sparkSession.sparkContext.broadcast(sorted(held))), schema)
    return found.join(keys, "keyword").select("q_id", "chapter", "chapter_no", "keyword", "n")


def locate_by_grams(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """:func:`locate` as a join of keywords and chapters by rare grams, for keyword sets of
    any size."""
    keys = files.kept(_keywords(questions), "keywords")
    found = occurrences(keys.select("keyword").distinct(), _bodies(chapters))
    return found.join(keys, "keyword").select("q_id", "chapter", "chapter_no", "keyword", "n")


def located_lines(found: DataFrame) -> DataFrame:
    """(q_id, place, line): chapters by the number of their occurrences, as they are shown."""
    totals = found.groupBy("q_id", "chapter").agg(F.sum("n").alias("n"))
    placed = ranked(totals, ["q_id"], [F.desc("n"), F.col("chapter")], None, "place")
    return placed.select("q_id", F.col("place").cast("bigint").alias("place"), F.concat_ws("\t", F.col("q_id"), "chapter", F.col("n")).alias("line"))


def suggested_sources(found: DataFrame, k: int = 2) -> DataFrame:
    """(q_id, suggested): the k chapters with most keyword occurrences; ties keep the
    order of the chapters."""
    totals = found.groupBy("q_id", "chapter").agg(F.sum("n").alias("n"), F.min("chapter_no").alias("chapter_no"))
    best = ranked(totals, ["q_id"], [F.desc("n"), F.asc_nulls_last("chapter_no"), F.col("chapter")], k)
    return best.groupBy("q_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chapter"))), lambda x: x["chapter"]).alias("suggested"))


def fill_sources(questions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Questions without an expected source take the suggestion."""
    got = questions.join(suggested_sources(locate(questions, chapters)), "q_id", "left")
    empty = F.size(F.coalesce("expected_source", F.array().cast("array<string>"))) == 0
    return got.withColumn("expected_source", F.when(empty, F.coalesce("suggested", "expected_source")).otherwise(F.col("expected_source"))).drop("suggested")


def parse_sizes(spec: str) -> tuple[int, int]:
    """SIZE:OVERLAP"""
    size, _, overlap = spec.partition(":")
    return int(size), int(overlap)


def _rates_of_runs(placed: DataFrame, runs: Sequence[tuple[str, int, Embedder]], questions: DataFrame) -> DataFrame:
    """approach, n_chunks, hit_at_1/3/5 of each run (name, configuration, embedder) over
    ``placed`` (config, chunk_pos, chapter, text). A run searches the chunks of its
    configuration; hits and rates of all runs are one grouping."""
    asked = files.kept(questions.where("answerable").withColumn("question", text.nfc("question")), "asked")
    n, found, vectors = len(runs), None, {}
    for i, (_, config, embedder) in enumerate(runs):
        if embedder.name not in vectors:
            vectors[embedder.name] = files.kept(embedded(asked.select("q_id", F.col("question").alias("text")), embedder, query=True).select("q_id", "embedding"), "asked-vectors")
        rows = vectors_of(embedded(placed.where(F.col("config") == config).select("chunk_pos", "text"), embedder))
        part = dense_topk(vectors[embedder.name], rows, max(KS)).select((F.col("q_id") * n + i).alias("q_id"), "rank", "chunk_pos")
        found = part if found is None else found.unionByName(part)
    met = found.join(placed.select("chunk_pos", "chapter", "text"), "chunk_pos")
    spread = asked.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    every = spread.select((F.col("q_id") * n + F.col("run")).alias("q_id"), "expected_source", "evidence_keywords")
    hits = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in KS]
    rates = first_hit(met, every).groupBy(F.pmod("q_id", F.lit(n)).cast("int").alias("run")).agg(*hits)
    names = placed.sparkSession.createDataFrame([(i, name, config) for i, (name, config, _) in enumerate(runs)], "run int, approach string, config int")
    sizes = placed.groupBy("config").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = F.broadcast(names).join(sizes, "config", "left").join(rates, "run", "left")
    return out.select("approach", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), *[f"hit_at_{k}" for k in KS])


def _placed(chapters: DataFrame, sizes: Sequence[tuple[int, int]]) -> DataFrame:
    chunks = files.kept(split_chapters_by(files.bounded(chapters), sizes), "chunkings")
    return files.kept(with_positions(chunks, ("config",)).select("config", "chunk_pos", "chapter", "text"), "placed")


def compare_chunkings(chapters: DataFrame, questions: DataFrame, specs: Sequence[str], embedder: Embedder) -> DataFrame:
    """approach, n_chunks, hit_at_1/3/5: one row per SIZE:OVERLAP. The chapters are read once."""
    sizes = [parse_sizes(spec) for spec in specs]
    runs = [(f"chunk_size={size}, overlap={overlap}", i, embedder) for i, (size, overlap) in enumerate(sizes)]
    return _rates_of_runs(_placed(chapters, sizes), runs, questions)


def compare_embedders(chapters: DataFrame, questions: DataFrame, embedders: Sequence[Embedder], conf: Config = Config()) -> DataFrame:
    """The same, one row per embedder, over one set of chunks."""
    placed = _placed(chapters, [(conf.chunk_size, conf.chunk_overlap)])
    return _rates_of_runs(placed, [(e.name, 0, e) for e in embedders], questions)


def behaviour(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, question, answer, cited, expected_answer, ok: found as it should be, and
    if sources are expected and it was found, one cited chapter is among them."""
    rows = responses.select("q_id", "answer", "found", "sources").join(questions.select("q_id", "question", "expected_answer", "answerable", "expected_source"), "q_id")
    expected = F.coalesce("expected_source", F.array().cast("array<string>"))
    cited = F.transform("sources", lambda s: s["chapter"])
    right = F.when((F.size(expected) > 0) & F.col("found"), F.arrays_overlap(cited, expected)).otherwise(F.lit(True))
    ok = (F.col("found") == F.col("answerable")) & F.coalesce(right, F.lit(False))
    return rows.select("q_id", "question", "answer", citation_label(F.col("sources")).alias("cited"), "expected_answer", ok.alias("ok"))


def passed(report: DataFrame) -> DataFrame:
    """One row (passed, n)."""
    return report.agg(F.coalesce(F.sum(F.col("ok").cast("bigint")), F.lit(0)).alias("passed"), F.count(F.lit(1)).alias("n"))


# --- Markdown -----------------------------------------------------------------------


def _lines(df: DataFrame, line: Column, order: str) -> list[str]:
    """A report is small: one line per question or configuration."""
    return [r["line"] for r in df.select(F.col(order), line.alias("line")).orderBy(order).collect()]


def _row(*cells: Column) -> Column:
    parts = [F.lit("| ")]
    for i, c in enumerate(cells):
        parts += [F.lit(" | ")] * bool(i) + [F.coalesce(c.cast("string"), F.lit("—"))]
    return F.concat(*parts, F.lit(" |"))


def question_table(questions: DataFrame) -> str:
    where = F.when(F.size(F.coalesce("expected_source", F.array().cast("array<string>"))) > 0, text.md_escape(F.array_join("expected_source", ", "))).when(~F.col("answerable"), F.lit("— (not in the book)")).otherwise(F.lit("to be located"))
    line = _row(F.col("q_id"), text.md_escape("question"), text.md_escape("expected_answer"), where)
    return "\n".join(["# Test questions", "", "| # | Question | Expected answer | Source |", "|---|---|---|---|", *_lines(questions, line, "q_id")]) + "\n"


def comparison_table(rows: DataFrame, title: str) -> str:
    line = _row(F.col("approach"), F.col("n_chunks"), *[text.percent(f"hit_at_{k}") for k in KS])
    return "\n".join([f"### {title}", "", "| Approach | # chunks | Hit@1 | Hit@3 | Hit@5 |", "|---|---|---|---|---|", *_lines(rows, line, "approach")]) + "\n"


def qa_table(report: DataFrame, header: str) -> str:
    """The report of a run; ``header`` names what was used."""
    line = _row(F.col("q_id"), text.md_escape("question"), text.md_escape("answer"), text.md_escape(F.coalesce(F.nullif(F.col("cited"), F.lit("")), F.lit("—"))), text.md_escape("expected_answer"), F.when(F.col("ok"), F.lit("yes")).otherwise(F.lit("no")))
    total = passed(report).first()
    return "\n".join(["# QA results", "", header, "", "| # | Question | Answer | Cited | Expected | OK |", "|---|---|---|---|---|---|", *_lines(report, line, "q_id"), "", f"**{total['passed']}/{total['n']}** as expected."]) + "\n"
