"""What is asked in conversations, how often, and how it was answered.

    python -m jobs.chat_digest --conversations PATH --output PATH

Reads turns (conv_id, turn, role, text), pairs each question of a user with the reply in the
next turn, and writes one row per different question (normalised: case, joiners, dashes and
white space) with its type, terms, how often and in how many conversations it was asked, how
many replies cite a passage, cite none, decline or are missing, and its first place with the
question and the cleaned reply. Partitioned by ``outcome``, the best that was achieved:
``cited``, ``uncited``, ``abstained``, ``unanswered``. Whoever keeps the passages reads the
last two first.

Questions and replies meet by a grouping on (conv_id, turn), and copies are counted before
they are shuffled on, so neither a long conversation nor a common question is one task's
work. Of several texts for one turn the least counts. Turns without conv_id, turn or role
are not paired; the log says how many. Each run replaces the output as a whole, so it may be
run again at any time.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.functions import text

from .common import beside, configured

log = logging.getLogger("jobs.chat_digest")

TURNS = "conv_id bigint, turn bigint, role string, text string"
STATES = ("cited", "uncited", "abstained", "unanswered")
DIGEST = (
    "question_key string, kind string, terms string, asked bigint, conversations bigint, cited bigint, uncited bigint, "
    "abstained bigint, unanswered bigint, first_conv_id bigint, first_turn bigint, question string, answer string, outcome string"
)


@dataclass(frozen=True)
class Settings:
    asking_role: str = "user"
    replying_role: str = "assistant"
    #: The largest passage number that a reply can cite.
    most_passages: int = 10


def exchanges(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(conv_id, turn, question, answer): a question and the reply in the next turn, if any."""
    known = turns.where("conv_id is not null and turn is not null")
    none = F.lit(None).cast("string")
    asked = known.where(F.col("role") == settings.asking_role).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"), none.alias("answer"))
    replied = known.where(F.col("role") == settings.replying_role).select("conv_id", (F.col("turn") - 1).alias("turn"), none.alias("question"), F.col("text").alias("answer"))
    both = asked.unionByName(replied).groupBy("conv_id", "turn").agg(F.min("question").alias("question"), F.min("answer").alias("answer"))
    return both.where("question is not null")


def digest(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per different question, as :data:`DIGEST`."""
    rows = exchanges(turns, settings).withColumn("question_key", text.normalize_text("question")).where("question_key <> ''")
    rows = rows.withColumn("answer", text.clean_answer(F.coalesce("answer", F.lit(""))))
    cites = F.size(text.extract_citations("answer", F.lit(settings.most_passages))) > 0
    state = F.when(F.col("answer") == "", "unanswered").when(text.abstains("answer"), "abstained").when(cites, "cited").otherwise("uncited")
    rows = rows.withColumn("state", state)
    counted = rows.groupBy("question_key").agg(
        F.count(F.lit(1)).alias("asked"), F.countDistinct("conv_id").alias("conversations"),
        *[F.sum((F.col("state") == s).cast("bigint")).alias(s) for s in STATES],
        F.min(F.struct("conv_id", "turn", "question", "answer")).alias("first"),
    )
    outcome = F.coalesce(*[F.when(F.col(s) > 0, s) for s in STATES])
    return counted.select(
        "question_key", text.question_type("question_key").alias("kind"), F.array_join(text.query_terms("question_key"), " ").alias("terms"), "asked", "conversations", *STATES,
        F.col("first.conv_id").alias("first_conv_id"), F.col("first.turn").alias("first_turn"), "first.question", "first.answer", outcome.alias("outcome"),
    )


def read_digest(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DIGEST).parquet(output)


def write_digest(spark: SparkSession, conversations: str, output: str, settings: Settings = Settings()) -> dict[str, int]:
    """One run; returns and logs how many turns it read and questions it wrote."""
    turns = spark.read.schema(TURNS).parquet(conversations)
    digest(turns, settings).write.mode("overwrite").partitionBy("outcome").parquet(output)
    read = turns.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("conv_id").isNull() | F.col("turn").isNull() | F.col("role").isNull()).alias("unplaced")).first()
    counts = {"turns": read["turns"], "unplaced": read["unplaced"], "questions": 0}
    by_outcome = {r["outcome"]: r["count"] for r in read_digest(spark, output).groupBy("outcome").count().collect()}
    counts["questions"] = sum(by_outcome.values())
    log.info("read %d turns from %s (%d without a place), wrote %d questions to %s: %s", counts["turns"], conversations, counts["unplaced"], counts["questions"], output, by_outcome)
    return counts


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--conversations", required=True, help="Parquet: conv_id, turn, role, text")
    p.add_argument("--output", required=True)
    p.add_argument("--config", default=beside(__file__, "chat_digest.json"))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("chat_digest").getOrCreate()
    try:
        write_digest(spark, a.conversations, a.output, configured(spark, Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
