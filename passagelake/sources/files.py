"""Scans and sinks of the working files: pages, chapters, chunks, questions."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schema import CHAPTERS, CHUNKS, QUESTIONS, RAW_PAGES


#: Bytes of rows that Python is given at once.
BATCH_BYTES = 4 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands Python batches of at most ``BATCH_BYTES``, where by
    default ten thousand rows of any length make one."""
    df.sparkSession.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local
    master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pl_shared_"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to a fresh path of the shared folder and read again: computed once,
    whatever is built on it."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file, in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(place) and store.getFileStatus(place).isFile()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/passagelake/{what}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


_scratch: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session may be gone; its folder goes with it
            return


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A small one that lies in fewer files than there are cores would be
    read, and worked on, by as few tasks: its rows are dealt out first."""
    df = bounded(spark.read.parquet(path))
    cores = spark.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * (64 << 20) and len(df.inputFiles()) < cores // 2:
        return df.repartition(cores)
    return df


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing file raises."""
    return spark.read.schema(CHAPTERS).json(path).where("chapter is not null or text is not null")


def write_chapters(chapters: DataFrame, path: str) -> None:
    chapters.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Text and metadata, flat, one object a line."""
    chunks.write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; lists in NFC, missing ones empty; ``q_id``."""
    none = F.array().cast("array<string>")
    q = spark.read.schema(QUESTIONS).option("multiLine", True).json(path)
    q = q.withColumns({c: F.coalesce(F.col(c), none) for c in ("evidence_keywords", "expected_source")})
    return q.withColumns({c: text.nfc_all(F.col(c)) for c in ("evidence_keywords", "expected_source")}).withColumn("q_id", F.col("id").cast("bigint"))


def write_questions(questions: DataFrame, path: str) -> None:
    """One JSON array in a local file; question sets are small."""
    names = [c for c in questions.columns if c not in ("q_id",)]
    rows = [{c: r[c] for c in names} for r in questions.orderBy("id").collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(rows, ensure_ascii=False, indent=2) + "\n")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_PAGES).parquet(path)


def append_pages(pages: DataFrame, path: str) -> None:
    """Adds fetched pages to the cache."""
    pages.write.mode("append").parquet(path)


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row per requested title, the one fetched last."""
    last = F.max_by(F.struct("title", "html", "fetched_at"), F.struct("fetched_at", "title", "html")).alias("p")
    return pages.groupBy("requested_title").agg(last).select("p.title", "requested_title", "p.html", "p.fetched_at")


def console_lines(retrieved: DataFrame, most: int = 2500) -> DataFrame:
    """(q_id, rank, line): ranked passages with their scores, for a debug print."""
    head = F.format_string("#%d score=%.4f sem=%.4f lex=%.4f hint=%.4f", F.col("rank"), *[F.coalesce(F.col(c), F.lit(0.0)) for c in ("score", "semantic_score", "lexical_score", "hint_score")])
    return retrieved.select("q_id", "rank", F.concat(head, F.lit("\n"), F.left("text", F.lit(most))).alias("line"))


def write_report(markdown: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(markdown)
