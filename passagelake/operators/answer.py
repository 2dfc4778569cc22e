"""Grounded answers: context, prompt, generation, guards, citations."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import lang, text
from ..sources import files
from .responses import RATE_LIMITED, Pace, RateLimit, call_once, is_rate_limit  # noqa: F401

class Generator(Protocol):
    """What answers prompts."""

    name: str

    def generate(self, prompt: str) -> str: ...


class ExtractiveGenerator:
    """Answers with the first sentence of the first passage and cites it; abstains
    without passages. Deterministic, for tests and offline use."""

    name = "extractive"

    def generate(self, prompt: str) -> str:
        body = prompt.rpartition("CONTEXT:\n")[2].partition("[1] ")[2].partition("\n")[2]
        line = body.split("\n")[0].strip()
        for mark in ("।", ". ", "? ", "! "):
            if mark in line:
                line = line[: line.index(mark) + len(mark)].strip()
                break
        return f"{line} [1]" if line else "not found"


#: (status, body) of a POST request: address, headers, body, seconds.
ChatTransport = Callable[[str, dict, bytes, float], tuple[int, bytes]]


def http_post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


class ChatGenerator:
    """A chat model behind the common ``/chat/completions`` interface. The key is read
    from the environment of the worker that calls, so it travels in no plan."""

    def __init__(self, url: str, model: str, key_variable: str = "CHAT_API_KEY", temperature: float = 0.0, max_tokens: int = 1024, timeout: float = 60.0, transport: ChatTransport = http_post):
        self.url, self.name, self.key_variable, self.transport = url.rstrip("/"), model, key_variable, transport
        self.temperature, self.max_tokens, self.timeout = temperature, max_tokens, timeout

    def generate(self, prompt: str) -> str:
        headers = {"Content-Type": "application/json"}
        key = os.environ.get(self.key_variable, "").strip()
        if key:
            headers["Authorization"] = f"Bearer {key}"
        body = {"model": self.name, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens}
        status, answer = self.transport(f"{self.url}/chat/completions", headers, json.dumps(body).encode(), self.timeout)
        if status == 429:
            raise RateLimit(f"429: {answer[:200].decode(errors='replace')}")
        if status >= 400:
            raise RuntimeError(f"status {status}: {answer[:200].decode(errors='replace')}")
        choices = json.loads(answer).get("choices") or [{}]
        return (choices[0].get("message") or {}).get("content") or ""


@dataclass(frozen=True)
class PlaceRule:
    """Evidence for a place: all words in the passages give the answer; the first
    passage with the last word is cited."""

    words: tuple[str, ...]
    answer: str


@dataclass(frozen=True)
class Messages:
    """What the answers and prompts say; all of it can be replaced."""

    empty_question: str = lang.EMPTY_QUESTION
    no_answer: str = "not found"
    rate_limited: str = "The generator is out of quota; try again later."
    rules: tuple[str, ...] = (
        "Use the passages only; add nothing of your own.",
        "If a passage supports an answer, answer.",
        "Do not decline while there is evidence.",
        "Answer what was asked, not something beside it.",
        "A place for where, a reason for why, a time for when, a person for who.",
        "One to three sentences in the language of the question.",
        "End each claim with the number of its passage, such as [1] or [1][3].",
        "Numbers must be those of the passages.",
        "Decline only if the passages hold no evidence.",
    )
    by_type: dict = field(
        default_factory=lambda: {
            "where": "The question asks for a place.",
            "when": "The question asks for a time.",
            "who": "The question asks for a person.",
            "why": "The question asks for a reason.",
            "how": "The question asks for a manner.",
            "marriage": "The question asks about a marriage.",
            "what": "The question asks for a fact.",
        }
    )
    evidence_first: str = "These passages bear on the question. Answer it in one sentence with one citation."
    place_rules: tuple[PlaceRule, ...] = ()


def context_entry(number: Column, chapter: Column, section: Column, source: Column, body: Column) -> Column:
    """One passage of a context: [n], chapter, section if it differs, source."""
    name = F.coalesce(F.nullif(chapter, F.lit("")), F.nullif(section, F.lit("")), F.lit(lang.LABEL_UNKNOWN))
    head = F.concat(F.lit("["), number.cast("string"), F.lit(f"] {lang.LABEL_CHAPTER}: "), name)
    part = F.when((F.coalesce(section, F.lit("")) != "") & (section != name), F.concat(F.lit(f" | {lang.LABEL_SECTION}: "), section)).otherwise("")
    where = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit(f" | {lang.LABEL_SOURCE}: "), source)).otherwise("")
    return F.concat(head, part, where, F.lit("\n"), text.strip(body))


def contexts(retrieved: DataFrame) -> DataFrame:
    """(q_id, context): the passages of a question in the order of their ranks."""
    entry = context_entry(F.col("rank"), F.col("chapter"), F.col("section"), F.col("source"), F.col("text"))
    return retrieved.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("context"))


def prompt_column(question: Column, context: Column, messages: Messages = Messages()) -> Column:
    rules = "\n".join(f"{i}. {r}" for i, r in enumerate(messages.rules, 1))
    kind = text.by_type(text.question_type(question), messages.by_type)
    return F.concat(F.lit(rules + "\n\n"), kind, F.lit("\n\nQUESTION:\n"), question, F.lit("\n\nCONTEXT:\n"), context)


def evidence_flags(questions: DataFrame, retrieved: DataFrame, subjects: Sequence[str] = ()) -> DataFrame:
    """(q_id, evidence): whether a passage among the first eight has a term of the
    question, exact or by stem; for where-questions also a subject with a place."""
    q = questions.select("q_id", text.query_terms("question").alias("terms"), text.question_type("question").alias("kind"))
    rows = retrieved.where("rank <= 8").select("q_id", "text").join(q, "q_id")
    tokens = text.tokenize("text")
    shared = F.arrays_overlap("terms", tokens) | F.arrays_overlap(F.transform("terms", text.stem), F.transform(tokens, text.stem))
    norm = text.normalize_text("text")
    place = (F.col("kind") == "where") & text.any_of(norm, list(subjects)) & text.any_of(norm, lang.PLACE_MARKERS)
    return rows.groupBy("q_id").agg(F.bool_or((F.size("terms") > 0) & (F.coalesce(shared, F.lit(False)) | place)).alias("evidence"))


def place_answers(retrieved: DataFrame, rules: Sequence[PlaceRule]) -> DataFrame:
    """(q_id, place_answer, place_rank): the first rule whose words the first eight
    passages hold together."""
    rows = retrieved.where("rank <= 8").select("q_id", "rank", text.normalize_text("text").alias("norm"))
    aggs = []
    for i, rule in enumerate(rules):
        for j, word in enumerate(rule.words):
            aggs.append(F.min(F.when(F.contains("norm", F.lit(word)), F.col("rank"))).alias(f"r{i}_{j}"))
    found = rows.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), *aggs)
    answer, rank = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, rule in reversed(list(enumerate(rules))):
        whole = F.lit(True)
        for j in range(len(rule.words)):
            whole = whole & F.col(f"r{i}_{j}").isNotNull()
        answer = F.when(whole, F.lit(rule.answer)).otherwise(answer)
        rank = F.when(whole, F.col(f"r{i}_0").cast("bigint")).otherwise(rank)
    return found.select("q_id", answer.alias("place_answer"), rank.alias("place_rank"))


def with_default_citation(answer: Column, citations: Column, abstained: Column) -> tuple[Column, Column]:
    """A substantive answer without citations cites the first passage."""
    missing = ~abstained & (F.size(citations) == 0)
    return F.when(missing, F.concat(F.rtrim(answer), F.lit(" [1]"))).otherwise(answer), F.when(missing, F.array(F.lit(1))).otherwise(citations)


def source_rows(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(q_id, sources): the passages that the citations of ``cited`` name, in order."""
    each = cited.select("q_id", F.posexplode("citations").alias("at", "citation"))
    got = each.join(retrieved.withColumnRenamed("rank", "citation_rank"), (each.q_id == retrieved.q_id) & (F.col("citation") == F.col("citation_rank"))).select(
        each.q_id, "at", F.struct("citation", "chapter", text.first_truthy("section", "title" if "title" in retrieved.columns else "section").alias("section"), "source", "text").alias("s")
    )
    return got.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("sources"))


def answer_questions(questions: DataFrame, retrieved: DataFrame, generator: Generator, messages: Messages = Messages(), subjects: Sequence[str] = (), conf: Config = Config(), delay: float = 0.0, log: str | None = None, lanes: int = 1) -> DataFrame:
    """q_id, question, answer, citations, sources, retrieved_ranks, found, error.

    The generator is called here, once a different prompt, and its answers go to ``log`` (a
    path; without one to a table of this call): all columns of a row come from the same
    answer, and a second run with the same log calls for nothing that it has. ``lanes`` tasks
    share the quota of one call each ``delay`` seconds.

    ``retrieved`` is what retrieval gave for the questions. Empty questions and those
    without passages get fixed answers; rate limits become errors; where-questions
    that miss their target may take a rule's answer; an abstention in the face of
    evidence is asked once more with a shorter prompt, outside the rate-limit guard.
    """
    q = questions.select(F.col("q_id").cast("bigint").alias("q_id"), text.strip(F.coalesce("question", F.lit(""))).alias("question"))
    retrieved = files.kept(retrieved, "retrieved")
    log = log or files.scratch(q.sparkSession, "responses")
    pace = Pace(delay, lanes)
    context = contexts(retrieved)
    counts = retrieved.groupBy("q_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ready = q.join(context, "q_id", "left").join(counts, "q_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    asked = ready.where("question <> '' and n > 0").withColumn("prompt", prompt_column(F.col("question"), F.col("context"), messages))
    first = call_once(asked, generator, log, pace=pace).withColumn("answer", text.clean_answer("raw"))
    first = first.withColumn("citations", text.extract_citations("answer", F.col("n"))).withColumn("abstained", text.abstains("answer"))
    flags = evidence_flags(q, retrieved, subjects)
    first = first.join(flags, "q_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(False)))
    if messages.place_rules:
        wrong = text.any_of(text.normalize_text("answer"), lang.CAUSE_WORDS)
        first = first.join(place_answers(retrieved, messages.place_rules), "q_id", "left")
        use = (text.question_type("question") == "where") & (F.col("abstained") | wrong) & F.col("place_answer").isNotNull() & F.col("error").isNull()
        first = first.withColumns({"answer": F.when(use, F.col("place_answer")).otherwise(F.col("answer")), "citations": F.when(use, F.array(F.col("place_rank").cast("int"))).otherwise(F.col("citations")), "abstained": ~use & F.col("abstained")}).drop("place_answer", "place_rank")
    answer, citations = with_default_citation(F.col("answer"), F.col("citations"), F.col("abstained") | F.col("error").isNotNull())
    first = files.kept(first.withColumns({"answer": answer, "citations": citations}), "first")
    again = first.where("abstained and evidence and error is null").select("q_id", "n", F.concat(F.col("question"), F.lit(f"\n\n{messages.evidence_first}\n\n"), F.col("context")).alias("prompt"))
    second = call_once(again, generator, log, pace=pace, catch=False).withColumn("retry", text.clean_answer("raw")).withColumn("retry_cites", text.extract_citations("retry", F.col("n")))
    second = second.where((F.col("retry") != "") & ~text.abstains("retry"))
    retry, cites = with_default_citation(F.col("retry"), F.col("retry_cites"), F.lit(False))
    second = second.select("q_id", retry.alias("retry"), cites.alias("retry_cites"))
    done = first.join(second, "q_id", "left").select("q_id", "question", F.coalesce("retry", "answer").alias("answer"), F.coalesce("retry_cites", "citations").alias("citations"), (~F.col("abstained") | F.col("retry").isNotNull()).alias("ok"), "error")
    limited = F.col("error").isNotNull()
    none = F.array().cast("array<int>")
    done = done.select("q_id", "question", F.when(limited, F.lit(messages.rate_limited)).otherwise(F.col("answer")).alias("answer"), F.when(limited, none).otherwise(F.col("citations")).alias("citations"), (~limited & F.col("ok")).alias("found"), "error")
    rest = ready.where("question = '' or n = 0").select("q_id", "question", F.when(F.col("question") == "", F.lit(messages.empty_question)).otherwise(F.lit(messages.no_answer)).alias("answer"), none.alias("citations"), F.lit(False).alias("found"), F.lit(None).cast("string").alias("error"))
    both = files.kept(done.unionByName(rest), "answered")
    ranks = retrieved.groupBy("q_id").agg(F.sort_array(F.collect_list(F.col("rank").cast("int"))).alias("retrieved_ranks"))
    out = both.join(source_rows(both, retrieved), "q_id", "left").join(ranks, "q_id", "left")
    return out.select("q_id", "question", "answer", "citations", F.coalesce("sources", F.array().cast(f"array<{_SOURCE}>")).alias("sources"), F.coalesce("retrieved_ranks", none).alias("retrieved_ranks"), "found", "error")


_SOURCE = "struct<citation:int,chapter:string,section:string,source:string,text:string>"


def citation_label(sources: Column) -> Column:
    """[n] section, in order, joined by semicolons."""
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("["), s["citation"].cast("string"), F.lit("] "), F.coalesce(F.nullif(s["section"], F.lit("")), s["chapter"], F.lit("")))), "; ")


def ask(questions: DataFrame, index: dict[str, DataFrame], embedder, generator: Generator, k: int | None = None, conf: Config = Config(), **more) -> DataFrame:
    """Retrieval and answers in one; ``k`` passages (at least one) make the context."""
    from .retrieve import retrieve

    k = max(1, int(k if k is not None else conf.context_k))
    wanted = questions.where(text.strip(F.coalesce("question", F.lit(""))) != "")
    return answer_questions(questions, retrieve(wanted, index, embedder, k, conf), generator, conf=conf, **more)


#: Other names of the same operation.
invoke = answer = get_answer = answer_question = ask
