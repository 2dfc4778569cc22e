"""Chunks, embeddings and the inverted index as tables, and their store."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections import Counter
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import chunk, lang
from ..schema import INDEX_INFO
from ..sources import files


def split_chapters(chapters: DataFrame, size: int, overlap: int, searched_starts: bool = False) -> DataFrame:
    """Chunks of chapters (book, chapter, chapter_no, url, text and more) with the
    metadata that citations use. ``chunk_pos`` is the reading order: chapter number,
    chapter, place in the chapter."""
    return split_chapters_by(chapters, [(size, overlap)], searched_starts).drop("config")


def split_chapters_by(chapters: DataFrame, sizes: Sequence[tuple[int, int]], searched_starts: bool = False) -> DataFrame:
    """The chunks of several (size, overlap) in one pass over the chapters; ``config`` is
    the place in ``sizes``."""
    parts = chapters.withColumns({f"pl_parts_{i}": chunk.split_column(F.col("text"), *s, searched_starts) for i, s in enumerate(sizes)})
    each = F.array(*[F.struct(F.lit(i).alias("config"), F.col(f"pl_parts_{i}").alias("parts")) for i in range(len(sizes))])
    rows = parts.select("book", "chapter", "chapter_no", F.col("url").alias("source"), F.explode(each).alias("c"))
    out = rows.select("book", "chapter", "chapter_no", "source", "c.config", F.size("c.parts").alias("chunks_in_chapter"), F.explode("c.parts").alias("part"))
    label = F.concat(F.col("chapter"), F.lit(f" — {lang.LABEL_PART} "), F.col("part.pos"), F.lit("/"), F.col("chunks_in_chapter"))
    return out.select(
        F.col("part.text").alias("text"), "book", "chapter", "chapter_no", label.alias("section"), "source",
        F.col("part.pos").alias("chunk_index"), "chunks_in_chapter", F.col("part.start").alias("start_index"),
        F.format_string("ch%02d-%03d", F.coalesce("chapter_no", F.lit(0)), F.col("part.pos")).alias("chunk_id"), "config",
    )


def chunk_documents(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunks_in_chapter, start_index, text."""
    parts = files.bounded(docs).select(F.col(key), chunk.split_column(F.col(column), size, overlap).alias("parts"))
    return parts.select(key, F.size("parts").cast("bigint").alias("chunks_in_chapter"), F.explode("parts").alias("p")).select(
        key, F.col("p.pos").cast("bigint").alias("chunk_index"), "chunks_in_chapter", F.col("p.start").cast("bigint").alias("start_index"), F.col("p.text").alias("text")
    )


def with_positions(chunks: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """``chunk_pos``: dense reading order over all chapters, by the columns ``first`` before
    all else.

    Chapters are sorted into ranges; each range adds up its own, and what comes before a
    range is added from the totals of the ranges, one number each. No task sees all
    chapters; rows add their place in the chapter."""
    spark = chunks.sparkSession
    keys = (*first, "chapter_no", "chapter", "source")
    order = [*map(F.col, first), F.coalesce(F.nullif("chapter_no", F.lit(0)), F.lit(1_000_000)), F.col("chapter"), F.col("source")]
    chapters = chunks.groupBy(*keys).agg(F.max("chunks_in_chapter").cast("bigint").alias("n"))
    ranges = files.kept(chapters.repartitionByRange(*order).withColumn("pl_range", F.spark_partition_id()), "chapter-order")
    totals, before = [], 0
    for r in ranges.groupBy("pl_range").agg(F.sum("n").alias("n")).orderBy("pl_range").collect():
        totals.append((r["pl_range"], before))
        before += r["n"]
    starts = spark.createDataFrame(totals, "pl_range int, pl_start bigint")
    within = Window.partitionBy("pl_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn("pl_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), "pl_range")
    offsets = placed.select(*[F.col(c).alias(f"pl_{c}") for c in keys], (F.col("pl_start") + F.col("pl_within")).alias("pl_before"))
    joined = chunks.join(offsets, F.expr(" and ".join(f"{c} <=> pl_{c}" for c in keys)))
    return joined.select(*chunks.columns, (F.col("pl_before") + F.col("chunk_index")).cast("bigint").alias("chunk_pos"))


# --- lexical ------------------------------------------------------------------------


def _count_terms(batches):
    for batch in batches:
        pos, terms, tfs, dls = [], [], [], []
        for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = plain_tokens(body)
            found = Counter(tokens)
            pos += [p] * len(found)
            terms += found
            tfs += found.values()
            dls += [len(tokens)] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(dls, pa.int64())], ["chunk_pos", "term", "tf", "dl"])


def postings(passages: DataFrame, pos: str = "chunk_pos", column: str = "text") -> DataFrame:
    """(chunk_pos, term, tf, dl). A passage is one row, so its terms are counted where
    it lies: no shuffle, where exploding and grouping would move every token."""
    rows = files.bounded(passages).select(F.col(pos).cast("bigint").alias("chunk_pos"), F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(_count_terms, "chunk_pos bigint, term string, tf bigint, dl bigint")


def _count_tokens(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(plain_tokens(x)) for x in batch.column(0).to_pylist()], pa.int64())], ["dl"])


def lengths(passages: DataFrame, column: str = "text") -> DataFrame:
    """One row (n, avgdl); passages without tokens count, avgdl is 1 without any."""
    each = files.bounded(passages).select(F.col(column).cast("string").alias("text")).mapInArrow(_count_tokens, "dl bigint")
    return each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def stats_of(post: DataFrame, passages: DataFrame) -> DataFrame:
    """The row of :func:`lengths` from written postings: the texts are not read again."""
    n = passages.agg(F.count(F.lit(1)).alias("n"))
    total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return n.join(F.broadcast(total)).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))


def terms(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf). ``stats`` is one row."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.greatest(F.col("n"), F.lit(1))
    return df.join(F.broadcast(stats.select("n"))).select("term", "df", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


# --- dense --------------------------------------------------------------------------


class Embedder(Protocol):
    """What turns texts into vectors. ``name`` guards against mixing indexes."""

    name: str
    dim: int

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Feature hashing of tokens: bucket = first 8 hex digits of md5 modulo the
    dimension; unit length. Deterministic, no model."""

    def __init__(self, dim: int = 64):
        self.dim, self.name = dim, f"hashing-{dim}"
        self._known: dict[str, int] = {}

    def _bucket(self, token: str) -> int:
        got = self._known.get(token)
        if got is None:
            if len(self._known) > 50_000:
                self._known.clear()
            got = self._known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return got

    def embed_tokens(self, rows: Sequence[Sequence[str]]) -> np.ndarray:
        out = np.zeros((len(rows), self.dim))
        for i, tokens in enumerate(rows):
            if tokens:
                found = Counter(tokens)
                out[i] = np.bincount([self._bucket(t) for t in found], list(found.values()), self.dim)
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm == 0, 1, norm)

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        return self.embed_tokens([plain_tokens(t) for t in texts])

    def embed_query(self, query: str) -> np.ndarray:
        return self.embed_documents([query])[0]


class PrefixEmbedder:
    """Adds the prefixes that some models want in front of passages and queries."""

    def __init__(self, inner: Embedder, passage: str = "passage: ", query: str = "query: "):
        self.inner, self.passage, self.query, self.name, self.dim = inner, passage, query, inner.name, inner.dim

    def embed_documents(self, texts):
        return self.inner.embed_documents([self.passage + t for t in texts])

    def embed_query(self, query):
        return self.inner.embed_query(self.query + query)


class ModelEmbedder:
    """A sentence-transformers model, loaded once per Python worker (optional)."""

    def __init__(self, name: str, conf: Config):
        self.name, self.conf, self.dim, self._model = name, conf, 0, None

    def __getstate__(self):
        return {**self.__dict__, "_model": None}

    def _load(self):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name, device=None if self.conf.embedding_device == "auto" else self.conf.embedding_device)
            self._model.max_seq_length = self.conf.max_seq_length
        return self._model

    def embed_documents(self, texts):
        return np.asarray(self._load().encode(list(texts), batch_size=self.conf.embedding_batch, normalize_embeddings=True), np.float64)

    def embed_query(self, query):
        return self.embed_documents([query])[0]


def make_embedder(conf: Config) -> Embedder:
    """By the model's name: ``hashing-N`` needs no model; names with e5 get prefixes."""
    m = re.fullmatch(r"hashing-(\d+)", conf.embedding_model)
    inner: Embedder = HashingEmbedder(int(m[1])) if m else ModelEmbedder(conf.embedding_model, conf)
    return PrefixEmbedder(inner) if "e5" in conf.embedding_model.lower() else inner


_TOKEN = re.compile(r"[ঀ-৿]+|[a-zA-Z0-9]+")


def plain_tokens(x: str | None) -> list[str]:
    """The tokens of :func:`functions.text.tokenize`, in plain Python: of what is replaced there
    only the joiners matter, as all else stays between tokens."""
    return _TOKEN.findall((x or "").replace("\u200c", "").replace("\u200d", "").lower())


def embedded(rows: DataFrame, embedder: Embedder, column: str = "text", query: bool = False) -> DataFrame:
    """``rows`` with an ``embedding`` column, one Arrow batch at a time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, embedding array<double>"

    def run(batches):
        for pdf in batches:
            texts = pdf[column].fillna("").tolist()
            vectors = np.array([embedder.embed_query(t) for t in texts]) if query else np.asarray(embedder.embed_documents(texts))
            yield pdf.assign(embedding=list(vectors.reshape(len(texts), -1)))

    return files.bounded(rows).mapInPandas(run, schema)


# --- forward rows -------------------------------------------------------------------


def forward(passages: DataFrame, embedder: Embedder | None = None, pos: str = "chunk_pos", column: str = "text") -> DataFrame:
    """(chunk_pos, dl, terms, tfs, embedding): what lexical and dense search know of a
    passage, in one row, from one pass over its text. Without an embedder the vector is
    null. Postings and vectors are views of it (:func:`postings_of`, :func:`vectors_of`)."""
    rows = files.bounded(passages).select(F.col(pos).cast("bigint").alias("chunk_pos"), F.col(column).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [plain_tokens(x) for x in texts]
            counts = [Counter(t) for t in tokens]
            if embedder is None:
                vectors = pa.nulls(len(texts), pa.list_(pa.float64()))
            else:
                found = embedder.embed_tokens(tokens) if hasattr(embedder, "embed_tokens") else embedder.embed_documents(texts)
                vectors = pa.array(list(np.asarray(found, np.float64).reshape(len(texts), -1)), pa.list_(pa.float64()))
            columns = [batch.column(0), pa.array(map(len, tokens), pa.int64()), pa.array(map(list, counts), pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())), vectors]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_pos", "dl", "terms", "tfs", "embedding"])

    return rows.mapInArrow(run, "chunk_pos bigint, dl bigint, terms array<string>, tfs array<bigint>, embedding array<double>")


def postings_of(rows: DataFrame) -> DataFrame:
    """(chunk_pos, term, tf, dl) of forward rows."""
    return rows.select("chunk_pos", F.explode(F.arrays_zip("terms", "tfs")).alias("p"), "dl").select("chunk_pos", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), "dl")


def vectors_of(rows: DataFrame) -> DataFrame:
    return rows.select("chunk_pos", "embedding")


def lengths_of(rows: DataFrame) -> DataFrame:
    """The row of :func:`lengths` from forward rows."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def terms_of(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """:func:`terms` from forward rows; only the terms are read."""
    return terms(rows.select(F.explode("terms").alias("term")), stats)


def _views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {**tables, "vectors": vectors_of(tables["forward"]), "postings": postings_of(tables["forward"])}


# --- store --------------------------------------------------------------------------

TABLES = ("chunks", "forward", "terms", "stats", "info")


def build_index(chunks: DataFrame, embedder: Embedder, path: str, info: dict | None = None) -> str:
    """Writes a version of the index: chunks, forward rows, terms, stats and one row of info
    (``num_chunks`` and what the caller adds; the caller wins); returns its name.

    A version is a folder of its own. Readers find it by the last row of ``path``/current,
    which is added when all tables are there: until then, and if the build fails, they read
    the version before."""
    spark = chunks.sparkSession
    if "chunk_pos" not in chunks.columns:
        chunks = with_positions(chunks)
    version = uuid.uuid4().hex
    at = f"{path}/{version}"
    chunks.write.parquet(f"{at}/chunks")
    chunks = spark.read.parquet(f"{at}/chunks")
    forward(chunks, embedder).write.parquet(f"{at}/forward")
    rows = spark.read.parquet(f"{at}/forward")
    lengths_of(rows).write.parquet(f"{at}/stats")
    stats = spark.read.parquet(f"{at}/stats")
    terms_of(rows, stats).write.parquet(f"{at}/terms")
    row = {"num_chunks": int(stats.first()["n"]), "embedding_model": embedder.name, **(info or {})}
    known = [f"{name} {kind}" for name, kind in (x.split(" ") for x in INDEX_INFO.split(", ")) if name in row]
    more = [k for k in row if f" {k} " not in f" {INDEX_INFO} ".replace(", ", " , ")]
    schema = T.StructType([*T._parse_datatype_string(", ".join(known)).fields, *(spark.createDataFrame([{k: row[k] for k in more}]).schema.fields if more else [])])
    spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema).write.parquet(f"{at}/info")
    spark.createDataFrame([(version, time.time())], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


VERSIONS = "version string, built_at double"


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of an index, the current one first."""
    if not files.exists(spark, f"{path}/current"):
        return []
    return [r["version"] for r in spark.read.schema(VERSIONS).parquet(f"{path}/current").orderBy(F.desc("built_at"), "version").collect()]


def index_exists(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


# Places where an index is looked for.
PLACES = ("faiss_index", "vectorstore", "vector_store", "index", "data/faiss_index", "data/vectorstore")


def find_index(spark: SparkSession, configured: str = "", places: Sequence[str] = PLACES) -> str:
    """The configured path or the first place that holds an index."""
    tried = [p for p in (configured, *places) if p]
    for path in tried:
        if index_exists(spark, path):
            return path
    raise FileNotFoundError(f"no index in any of: {', '.join(tried)}")


def index_info(spark: SparkSession, path: str) -> dict:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/{found[0]}/info").first().asDict(recursive=True) if found else {}


def load_index(spark: SparkSession, path: str, embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """The tables of an index's current version, with vectors and postings as views. Raises
    if it is missing or made by another embedder."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    made_by = index_info(spark, path).get("embedding_model")
    if embedder is not None and made_by != embedder.name:
        raise ValueError(f"the index was made with {made_by}, not with {embedder.name}")
    return _views({t: spark.read.parquet(f"{path}/{found[0]}/{t}") for t in TABLES})


def memory_index(passages: DataFrame, embedder: Embedder, pos: str = "chunk_pos", column: str = "text") -> dict[str, DataFrame]:
    """The same tables for the use of this session: forward rows and terms are written to the
    shared folder once, and go when the driver ends."""
    chunks = passages.withColumn("chunk_pos", F.col(pos).cast("bigint")).withColumn("text", F.col(column))
    rows = files.kept(forward(chunks, embedder), "forward")
    stats = files.kept(lengths_of(rows), "stats")
    return _views({"chunks": chunks, "forward": rows, "stats": stats, "terms": files.kept(terms_of(rows, stats), "terms")})
