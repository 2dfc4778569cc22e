"""Passages of the documents that are new since the last run.

    python -m jobs.refresh_passages --documents PATH --output PATH --checkpoint PATH

The documents are Parquet files that are added to a folder (one file will do as well). Each
run takes the files that no earlier run with the same checkpoint took, cuts their texts into
overlapping passages with what a citation needs (chapter, section, address, offset, chunk id)
and adds these to the output, partitioned by language. It is a stream that ends when it has
read what is there: Spark's file source keeps which files were read, its checkpoint keeps
which batches were written, and its file sink lists a batch's files only once the batch is
done. A run that fails and starts again, or one that finds nothing new, neither loses nor
repeats a passage. The output is to be read as a whole with Spark (:func:`passages`).

A file under a known path counts as read even if its content changed. Texts without a word
give no passage; a language that is missing or empty is ``und``; a document without an id has
chapter null. No row is shuffled.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.operators.index import split_chapters
from passagelake.sources import files

from .common import beside, configured

log = logging.getLogger("jobs.refresh_passages")

DOCUMENTS = "doc_id bigint, text string, lang string, source string"
PASSAGES = (
    "text string, book string, chapter string, chapter_no int, section string, source string, "
    "chunk_index int, chunks_in_chapter int, start_index int, chunk_id string, lang_key string"
)


@dataclass(frozen=True)
class Settings:
    book: str = "documents"
    chunk_size: int = 800
    chunk_overlap: int = 150
    #: Files of one batch; a run makes as many batches as it takes.
    files_per_batch: int = 1000


def cut(docs: DataFrame, settings: Settings) -> DataFrame:
    """The passages of documents, as :data:`PASSAGES`."""
    language = F.coalesce(F.nullif("lang", F.lit("")), F.lit("und"))
    # the language rides along with the address and is taken apart from it afterwards
    chapters = docs.select(
        F.lit(settings.book).alias("book"), F.concat(F.lit("d"), "doc_id").alias("chapter"), F.col("doc_id").cast("int").alias("chapter_no"),
        F.struct("source", language.alias("lang_key")).alias("url"), "text",
    )
    out = split_chapters(chapters, settings.chunk_size, settings.chunk_overlap)
    return out.withColumns({"lang_key": F.col("source.lang_key"), "source": F.col("source.source")}).select(*[x.split()[0] for x in PASSAGES.split(", ")])


def passages(spark: SparkSession, output: str) -> DataFrame:
    """All that the runs have written so far."""
    return spark.read.schema(PASSAGES).parquet(output)


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """One run; returns and logs how many documents it read and passages it added."""
    taken = f"{documents[:-1]}[{documents[-1]}]" if files.is_file(spark, documents) else documents  # a stream takes folders and patterns
    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", settings.files_per_batch).parquet(taken)
    before = spark.conf.get(files.BATCH_LIMIT, None)
    rows = cut(files.bounded(docs).observe("read", F.count(F.lit(1)).alias("n")), settings).observe("written", F.count(F.lit(1)).alias("n"))
    try:  # a stream keeps the settings that it starts with
        stream = (
            rows.writeStream.format("parquet").partitionBy("lang_key").outputMode("append")
            .option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(files.BATCH_LIMIT) if before is None else spark.conf.set(files.BATCH_LIMIT, before)
    batches: dict[int, dict] = {}  # Spark keeps the last progress reports only, so they are gathered on the way
    ended = False
    while not ended:
        ended = stream.awaitTermination(5)
        batches |= {p.batchId: p.observedMetrics for p in stream.recentProgress if p.numInputRows}
    counts = {name: sum(m[seen]["n"] for m in batches.values() if seen in m) for name, seen in (("documents", "read"), ("passages", "written"))}
    log.info("read %d documents from %s in %d batches, wrote %d passages to %s", counts["documents"], documents, len(batches), counts["passages"], output)
    return counts


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("--documents", required=True, help="folder or file of Parquet: doc_id, text, lang, source")
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True, help="where the stream keeps what it has read; belongs to one output")
    p.add_argument("--config", default=beside(__file__, "refresh_passages.json"))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("refresh_passages").getOrCreate()
    try:
        refresh(spark, a.documents, a.output, a.checkpoint, configured(spark, Settings, a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
