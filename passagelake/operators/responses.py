"""Calls of an outside service that costs money, time or quota: made once and kept.

Answers are appended to a log, a Parquet table keyed by the digest of the prompt and the
name of what answered. :func:`call_once` reduces its rows to their different prompts, leaves
out those that the log has an answer for (anti join), calls for the rest and joins the log to
the rows. All later steps read the log, so the number of calls is the number of different
prompts, however often a plan is run.

* A call that fails is a value, not the end of its task: what the others answered is kept,
  and only then the error is raised. A rate limit is kept as an error of its own.
* The calls are made in rounds of at most ``per_task`` a task; each round is appended before
  the next begins. A lost executor repeats at most one task's calls, a lost driver at most
  one round.
* Quota is shared out by phase: lane i of n may call at the moments start + (i + n * k) *
  delay only. No two calls are closer than the delay, whichever tasks run at which time, and
  no lane waits for another.
"""

from __future__ import annotations

import datetime
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import files

RATE_LIMITED = "rate_limit"
LOG = "prompt_key string, generator string, raw string, error string, called_at timestamp"


class Answers(Protocol):
    """What is called; ``name`` and the prompt identify an answer."""

    name: str

    def generate(self, prompt: str) -> str: ...


class RateLimit(RuntimeError):
    """The service is out of quota for now."""


def is_rate_limit(error: BaseException) -> bool:
    message = str(error).lower()
    return isinstance(error, RateLimit) or "429" in message or "rate limit" in message or "rate_limit_exceeded" in message


@dataclass(frozen=True)
class Pace:
    """At least ``delay`` seconds between calls, dealt out to ``lanes`` tasks. ``start`` is
    the wall-clock time of the first slot. Clock and sleep can be replaced."""

    delay: float = 0.0
    lanes: int = 1
    start: float = 0.0
    now: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep

    def slots(self, lane: int) -> Iterator[None]:
        """Returns from each step when the next slot of the lane has come."""
        k = 0
        while True:
            due = math.ceil(((self.now() - self.start) / self.delay - lane) / self.lanes - 1e-9)
            k = max(k, due)
            wait = self.start + (lane + self.lanes * k) * self.delay - self.now()
            if wait > 0:
                self.sleep(wait)
            k += 1
            yield


def prompt_key(prompt: Column) -> Column:
    return F.sha2(F.coalesce(prompt, F.lit("")), 256)


def answered(prompts: list[str], generator: Answers, slots: Iterator[None] | None = None) -> Iterator[tuple[str | None, str | None]]:
    """(answer, error) of each prompt, one call each."""
    for prompt in prompts:
        if slots is not None:
            next(slots)
        try:
            yield generator.generate(prompt or "") or "", None
        except Exception as e:
            yield None, RATE_LIMITED if is_rate_limit(e) else f"{type(e).__name__}: {e}"[:2000]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(path)


def best_answers(log: DataFrame, generator: str) -> DataFrame:
    """(prompt_key, raw, error): of each prompt the last answer, or the last error if it was
    never answered."""
    last = F.max_by(F.struct("raw", "error"), F.struct(F.col("raw").isNotNull().alias("ok"), "called_at")).alias("a")
    return log.where(F.col("generator") == generator).groupBy("prompt_key").agg(last).select("prompt_key", "a.raw", "a.error")


def call_once(rows: DataFrame, generator: Answers, log: str, prompt: str = "prompt", pace: Pace = Pace(), catch: bool = True, per_task: int = 32) -> DataFrame:
    """``rows`` with ``raw`` and ``error``; calls at once, not when the result is read.

    ``log`` is the path of the log. With ``catch`` a rate limit becomes an error value (and
    is called for again by the next run); any other failure is raised after the round that
    has it was kept.
    """
    spark = rows.sparkSession
    asked = files.kept(rows.withColumn("pl_key", prompt_key(F.col(prompt))), "asked")
    known = read_log(spark, log).where((F.col("generator") == generator.name) & F.col("raw").isNotNull()).select(F.col("prompt_key").alias("pl_key")).distinct()
    open_ = files.kept(asked.groupBy("pl_key").agg(F.min(F.coalesce(prompt, F.lit(""))).alias("prompt")).join(known, "pl_key", "left_anti"), "prompts")
    n = open_.count()
    tasks = pace.lanes if pace.delay else spark.sparkContext.defaultParallelism
    rounds = -(-n // (tasks * per_task))
    if pace.delay and not pace.start:
        pace = Pace(pace.delay, pace.lanes, pace.now() + pace.delay, pace.now, pace.sleep)

    def calls(batches):
        slots = pace.slots(TaskContext.get().partitionId() % pace.lanes) if pace.delay else None
        for pdf in batches:
            found = list(answered(pdf["prompt"].tolist(), generator, slots))
            yield pd.DataFrame({"prompt_key": pdf["pl_key"], "generator": generator.name, "raw": [r for r, _ in found], "error": [e for _, e in found], "called_at": datetime.datetime.now()}).astype({"raw": object, "error": object})

    failed = F.col("error").isNotNull() & ((F.col("error") != RATE_LIMITED) | F.lit(not catch))
    for i in range(rounds):
        part = open_.where(F.pmod(F.xxhash64("pl_key"), F.lit(rounds)) == i).repartition(tasks)
        seen = Observation()
        made = part.mapInPandas(calls, LOG).observe(seen, F.min(F.when(failed, F.col("error"))).alias("error"))
        made.write.mode("append").parquet(log)
        error = seen.get.get("error")
        if error:
            raise RateLimit(error) if error == RATE_LIMITED else RuntimeError(error)
    answers = best_answers(read_log(spark, log), generator.name).withColumnRenamed("prompt_key", "pl_key")
    return asked.join(answers, "pl_key", "left").drop("pl_key")
