"""An index that takes additions and withdrawals without being built again.

An index is a list of segments. A segment holds the passages that came with it, their forward
rows, the documents that it withdraws from the segments before it, and by how much it changes
the document frequencies, the number of passages and their length. A document that is added
again replaces what the index has of it. What is read is merged on the way: a passage counts
if no later segment withdraws its document, and frequencies are sums of differences, so the
postings are never counted again. :func:`compact` writes what is live as one segment.

Readers find the segments in the last row of ``path``/current, which is added when a segment
is complete: a step that fails changes nothing for them. There is one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from .index import Embedder, forward, postings_of, vectors_of

CURRENT = "segments array<string>, embedding_model string, built_at double"


def segments(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """(segments in order, embedder's name) of an index; none if there is no index yet."""
    if not files.exists(spark, f"{path}/current"):
        return [], None
    last = spark.read.schema(CURRENT).parquet(f"{path}/current").orderBy(F.desc("built_at")).first()
    return list(last["segments"]), last["embedding_model"]


def _switch(spark: SparkSession, path: str, names: list[str], model: str) -> None:
    spark.createDataFrame([(names, model, time.time())], CURRENT).coalesce(1).write.mode("append").parquet(f"{path}/current")


def _all(spark: SparkSession, path: str, names: list[str], what: str) -> DataFrame | None:
    """One table of all segments, with the number of the segment."""
    parts = [spark.read.parquet(f"{path}/segments/{s}/{what}").withColumn("segment", F.lit(i)) for i, s in enumerate(names) if files.exists(spark, f"{path}/segments/{s}/{what}")]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _live(spark: SparkSession, path: str, names: list[str], what: str) -> DataFrame:
    """The rows whose document no later segment withdraws."""
    rows, gone = _all(spark, path, names, what), _all(spark, path, names, "withdrawn")
    if gone is None:
        return rows.drop("segment")
    last = gone.groupBy("document").agg(F.max("segment").alias("gone_at"))
    met = rows.join(last, "document", "left").where(F.col("gone_at").isNull() | (F.col("gone_at") <= F.col("segment")))
    return met.drop("segment", "gone_at")


def _changes(rows: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, total) differences of forward rows that come (1) or go (-1)."""
    terms = rows.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"))
    return terms, rows.agg((F.count(F.lit(1)) * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).alias("total"))


def _write(spark: SparkSession, path: str, passages: DataFrame | None, gone: DataFrame | None, embedder: Embedder) -> list[str]:
    names, model = segments(spark, path)
    if model is not None and model != embedder.name:
        raise ValueError(f"the index was made with {model}, not with {embedder.name}")
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    changes = []
    if passages is not None:
        passages.write.parquet(f"{at}/chunks")
        came = spark.read.schema(passages.schema).parquet(f"{at}/chunks")
        forward(came, embedder).join(came.select("chunk_pos", "document"), "chunk_pos").write.parquet(f"{at}/forward")
        changes.append(_changes(spark.read.parquet(f"{at}/forward"), 1))
        gone = came.select("document").distinct() if gone is None else gone
    if names:
        gone.where("document is not null").distinct().write.parquet(f"{at}/withdrawn")
        lost = _live(spark, path, names, "forward").join(spark.read.parquet(f"{at}/withdrawn"), "document", "left_semi")
        changes.append(_changes(lost, -1))
    if changes:
        for what, tables in (("terms", [c[0] for c in changes]), ("stats", [c[1] for c in changes])):
            reduce(DataFrame.unionByName, tables).write.parquet(f"{at}/{what}")
    names.append(name)
    _switch(spark, path, names, embedder.name)
    return names


def add(passages: DataFrame, embedder: Embedder, path: str) -> list[str]:
    """Adds passages (document, chunk_pos, text and more); documents that the index has are
    replaced whole. ``chunk_pos`` is the reading order, unique over the index. A passage
    without a document can be added but never withdrawn. Returns the segments."""
    return _write(passages.sparkSession, path, passages, None, embedder)


def withdraw(documents: DataFrame, embedder: Embedder, path: str) -> list[str]:
    """Takes documents (document) out of the index; those that it lacks do not matter."""
    return _write(documents.sparkSession, path, None, documents.select("document"), embedder)


def load(spark: SparkSession, path: str, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """The tables of an index as they are now, as :func:`index.load_index` gives them."""
    names, model = segments(spark, path)
    if not names:
        raise FileNotFoundError(f"no index at {path}")
    if embedder is not None and model != embedder.name:
        raise ValueError(f"the index was made with {model}, not with {embedder.name}")
    rows = _live(spark, path, names, "forward").drop("document")
    stats = _all(spark, path, names, "stats").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    stats = stats.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))
    df = _all(spark, path, names, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    terms = df.join(F.broadcast(stats.select("n"))).select("term", "df", _idf(F.greatest(F.col("n"), F.lit(1)), F.col("df")).alias("idf"))
    return {"chunks": _live(spark, path, names, "chunks"), "forward": rows, "stats": stats, "terms": terms, "vectors": vectors_of(rows), "postings": postings_of(rows)}


def _idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def compact(spark: SparkSession, path: str) -> list[str]:
    """Writes what is live as one segment and switches to it; the others stay for whoever
    reads them now."""
    names, model = segments(spark, path)
    if not names:
        return names
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    for what in ("chunks", "forward"):
        _live(spark, path, names, what).write.parquet(f"{at}/{what}")
    _all(spark, path, names, "terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").write.parquet(f"{at}/terms")
    _all(spark, path, names, "stats").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).write.parquet(f"{at}/stats")
    _switch(spark, path, [name], model)
    return [name]
