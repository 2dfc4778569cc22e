"""Retrieval for a table of questions: dense, lexical and hybrid.

Every operator takes all questions at once and returns rows keyed by ``q_id``. Scores
are rounded to nine decimals before they are ranked, so that the order of a sum does
not decide; ties go to the passage that comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import lang, text
from ..sources import files
from .index import Embedder, embedded
from .metric import Nearest, knn_by_cells, matrix

DIGITS = 9
#: Query vectors that one pass over the passages holds in a worker.
QUERY_BLOCK = 4096
#: Numbers that a worker holds at once while it compares.
CELLS = 1 << 20


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None, name: str = "rank") -> DataFrame:
    """Row numbers per group; with ``k`` only the first k rows (Spark prunes below the
    shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= k) if k is not None else out


# --- dense --------------------------------------------------------------------------


def _block_search(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, pos: str) -> DataFrame:
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((ids, queries))

    def run(batches):
        q_ids, q = shared.value
        best = Nearest(q, k)
        for batch in batches:
            best.add(matrix(batch.column(1)), batch.column(0).to_numpy())
        row, place, dist = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[row], pa.int64()), pa.array(place, pa.int64()), pa.array(dist)], ["q_id", "pos", "dist"])

    rows = vectors.select(F.col(pos).cast("bigint").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "q_id bigint, pos bigint, dist double")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, pos: str = "chunk_pos") -> DataFrame:
    """(q_id, chunk_pos, dist, rank): the k nearest passages by squared distance.

    ``queries`` is (q_id, embedding), one row per id. Up to ``QUERY_BLOCK`` of them are held
    by every worker, which streams the passages past them and sends on k a query. More
    queries than that stay a table and are routed to cells of the vectors
    (:func:`passagelake.operators.metric.knn_by_cells`).
    """
    q = queries.select(F.col("q_id").cast("bigint").alias("q_id"), "embedding")
    held = q.take(QUERY_BLOCK + 1)
    if not held:
        return vectors.sparkSession.createDataFrame([], "q_id bigint, chunk_pos bigint, dist double, rank bigint")
    if len(held) > QUERY_BLOCK:
        return knn_by_cells(q, vectors, k, pos=pos)[0]
    held.sort(key=lambda r: r["q_id"])
    found = _block_search(vectors, np.array([r["q_id"] for r in held]), np.array([r["embedding"] for r in held], np.float64), k, pos)
    best = ranked(found, ["q_id"], [F.col("dist"), F.col("pos")], k)
    return best.select("q_id", F.col("pos").alias("chunk_pos"), "dist", F.col("rank").cast("bigint").alias("rank"))


def dense_topk_native(queries: DataFrame, vectors: DataFrame, k: int, pos: str = "chunk_pos") -> DataFrame:
    """The same in DataFrame operations only, for query sets of one block; larger ones
    go the way of :func:`dense_topk`."""
    if len(queries.select("q_id").take(QUERY_BLOCK + 1)) > QUERY_BLOCK:
        return dense_topk(queries, vectors, k, pos)
    v = vectors.select(F.col(pos).cast("bigint").alias("chunk_pos"), F.col("embedding").cast("array<double>").alias("v"))
    q = queries.select(F.col("q_id").cast("bigint").alias("q_id"), F.col("embedding").cast("array<double>").alias("q"))
    squares = F.zip_with("q", "v", lambda a, b: (a - b) * (a - b))
    pairs = v.join(F.broadcast(q)).select("q_id", "chunk_pos", F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), DIGITS).alias("dist"))
    best = ranked(pairs, ["q_id"], [F.col("dist"), F.col("chunk_pos")], k)
    return best.select("q_id", "chunk_pos", "dist", F.col("rank").cast("bigint").alias("rank"))


def min_over_variants(found: DataFrame) -> DataFrame:
    """(q_id, chunk_pos, dist): the least distance over the variants of a question;
    ``found`` is (q_id, variant, chunk_pos, dist)."""
    return found.groupBy("q_id", "chunk_pos").agg(F.min("dist").alias("dist"))


# --- lexical ------------------------------------------------------------------------


def question_terms(questions: DataFrame) -> DataFrame:
    """(q_id, term), distinct terms."""
    return questions.select("q_id", F.explode(text.query_terms("question")).alias("term"))


def bm25(q_terms: DataFrame, postings: DataFrame, terms: DataFrame, stats: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q_id, chunk_pos, bm25) of the pairs that share a term. The terms of the
    questions meet the term table first, so only their postings are read on."""
    known = q_terms.join(terms.select("term", "idf"), "term")
    hits = postings.join(known, "term").join(F.broadcast(stats.select("avgdl")))
    norm = k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * ((F.col("tf") * (k1 + 1.0)) / (F.col("tf") + norm))
    return hits.groupBy("q_id", "chunk_pos").agg(F.round(F.sum(part), DIGITS).alias("bm25"))


def lexical_topk(questions: DataFrame, scores: DataFrame, passages: DataFrame, m: int) -> DataFrame:
    """(q_id, chunk_pos, bm25, rank): the top m of **all** passages, so those with
    score zero fill up in reading order. The first 2 m passages hold enough of them:
    fewer than m are positive whenever any is needed. Those 2 m positions are all that
    comes to the driver; only questions short of m rows take them."""
    top = ranked(scores, ["q_id"], [F.desc("bm25"), F.col("chunk_pos")], m).drop("rank")
    first = [r[0] for r in passages.select(F.col("chunk_pos").cast("bigint")).orderBy("chunk_pos").limit(2 * m).collect()]
    if not first:
        return top.withColumn("rank", F.lit(0).cast("bigint"))
    full = top.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= m).select("q_id")
    short = questions.select(F.col("q_id").cast("bigint").alias("q_id")).join(full, "q_id", "left_anti")
    blank = short.select("q_id", F.explode(F.array(*map(F.lit, first)).cast("array<bigint>")).alias("chunk_pos")).join(top.select("q_id", "chunk_pos"), ["q_id", "chunk_pos"], "left_anti")
    both = top.unionByName(blank.withColumn("bm25", F.lit(0.0)))
    out = ranked(both, ["q_id"], [F.desc("bm25"), F.col("chunk_pos")], m)
    return out.select("q_id", "chunk_pos", "bm25", F.col("rank").cast("bigint").alias("rank"))


# --- one pass -----------------------------------------------------------------------


def _least(values: np.ndarray, places: np.ndarray, k: int, keep: np.ndarray | None = None):
    """Per row the k least values (ties by place): (row, place, value) arrays, sorted. Only
    columns that may be among them are sorted."""
    cut = np.partition(values, k - 1, 1)[:, k - 1 : k] if values.shape[1] > k else np.full((len(values), 1), np.inf)
    near = values <= cut if keep is None else (values <= cut) & keep
    row, col = np.nonzero(near)
    value, place = values[row, col], places[col]
    order = np.lexsort((place, value, row))
    row, place, value = row[order], place[order], value[order]
    first = np.searchsorted(row, row)  # where each row begins
    fit = np.arange(len(row)) - first < k
    return row[fit], place[fit], value[fit]


class _Block:
    """A block of questions as a worker holds it."""

    def __init__(self, q_ids, v_ids, v_owner, vectors, terms, owner, weight, avgdl, k1, b):
        self.q_ids, self.v_ids, self.v_owner, self.vectors = q_ids, v_ids, v_owner, vectors
        order = np.argsort(terms, kind="stable")
        self.terms, starts = np.unique(np.array(terms, object)[order], return_index=True) if len(terms) else (np.array([], object), np.array([], np.int64))
        self.starts = np.append(starts, len(terms)).astype(np.int64)
        self.owner, self.weight = np.asarray(owner, np.int64)[order], np.asarray(weight, np.float64)[order]
        self.avgdl, self.k1, self.b = avgdl, k1, b

    def distances(self, embeddings: np.ndarray) -> np.ndarray:
        """(variants, passages), exact differences in slices."""
        d = np.empty((len(self.vectors), len(embeddings)))
        step = max(1, CELLS // max(1, embeddings.size))
        for lo in range(0, len(d), step):
            diff = self.vectors[lo : lo + step, None, :] - embeddings[None, :, :]
            d[lo : lo + step] = np.einsum("qvd,qvd->qv", diff, diff)
        return np.round(d, DIGITS)

    def scores(self, rows: pa.RecordBatch) -> np.ndarray:
        """(questions, passages): BM25 of the postings of these passages, added up here:
        all terms of a passage are in its row."""
        n = rows.num_rows
        lists = rows.column("terms")
        if not len(self.terms) or not n:
            return np.zeros((len(self.q_ids), n))
        counts = pc.list_value_length(lists).to_numpy()
        at = pc.index_in(lists.flatten(), pa.array(self.terms, pa.string()))
        known = at.is_valid().to_numpy(zero_copy_only=False)
        term = at.drop_null().to_numpy().astype(np.int64)
        passage = np.repeat(np.arange(n), counts)[known]
        tf = rows.column("tfs").flatten().to_numpy()[known].astype(np.float64)
        dl = rows.column("dl").to_numpy().astype(np.float64)[passage]
        part = tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * dl / self.avgdl))
        many = self.starts[term + 1] - self.starts[term]  # the questions that have the term
        slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[term], many)
        cell = self.owner[slot] * n + np.repeat(passage, many)
        return np.round(np.bincount(cell, self.weight[slot] * np.repeat(part, many), len(self.q_ids) * n).reshape(-1, n), DIGITS)


def _pass_of(shared, k: int, m: int):
    def run(batches):
        block: _Block = shared.value
        near, lex = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)], [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        width = max(1, CELLS // max(1, len(block.q_ids), len(block.v_ids)))
        for batch in batches:
            for lo in range(0, batch.num_rows, width):
                rows = batch.slice(lo, width)
                places = rows.column("chunk_pos").to_numpy()
                scores = block.scores(rows)
                if m:
                    row, place, value = _least(-scores, places, m, scores > 0)
                    lex = _merged([lex[0], lex[1], lex[2]], [row, place, value], m)
                if k:
                    d = block.distances(np.stack(rows.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64))
                    row, place, value = _least(d, places, k)
                    column = np.searchsorted(places, place) if (np.diff(places) > 0).all() else np.array([{p: i for i, p in enumerate(places.tolist())}[p] for p in place.tolist()], np.int64)
                    near = _merged(near, [row, place, value, scores[block.v_owner[row], column]], k)
        yield pa.RecordBatch.from_arrays([pa.array(block.v_ids[near[0]]), pa.array(near[1]), pa.array(near[2]), pa.array(near[3])], ["id", "chunk_pos", "dist", "bm25"])
        yield pa.RecordBatch.from_arrays([pa.array(block.q_ids[lex[0]]), pa.array(lex[1]), pa.nulls(len(lex[1]), pa.float64()), pa.array(-lex[2])], ["id", "chunk_pos", "dist", "bm25"])

    return run


def _merged(held: list, more: list, k: int) -> list:
    """Two lists (row, place, value, ...), the k least values of each row."""
    both = [np.concatenate(x) for x in zip(held, more)]
    order = np.lexsort((both[1], both[2], both[0]))
    both = [x[order] for x in both]
    fit = np.arange(len(order)) - np.searchsorted(both[0], both[0]) < k
    return [x[fit] for x in both]


def one_pass(questions: DataFrame, rows: DataFrame, terms: DataFrame, stats: DataFrame, k: int = 0, m: int = 0, variants: DataFrame | None = None, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical search in one pass over forward rows.

    ``questions`` is (q_id, question); ``variants`` (q_id, v_id, embedding) if there is a
    dense side. Returns (v_id, chunk_pos, dist, bm25), the k nearest passages of each variant
    with their lexical score, and (q_id, chunk_pos, bm25), the m best positive scores.

    Questions come to the driver in blocks of at most ``QUERY_BLOCK``; a task holds one block
    and streams the passages past it. A passage's terms are all in its row, so scores are
    added up where it lies, and what a task sends on is k or m rows a question.
    """
    spark = files.bounded(rows).sparkSession
    q = questions.select(F.col("q_id").cast("bigint").alias("q_id"), "question")
    weights = question_terms(q).join(terms.select("term", "idf"), "term").groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))
    held = q.select("q_id").distinct().join(weights, "q_id", "left")
    if variants is not None:
        held = held.join(variants.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("v_id", "embedding"))).alias("variants")), "q_id", "left")
    avgdl = float(stats.first()["avgdl"])
    schema, found, block = "id bigint, chunk_pos bigint, dist double, bm25 double", None, []

    def searched(block: list) -> DataFrame:
        owner = [i for i, r in enumerate(block) for _ in r["terms"] or []]
        pairs = [t for r in block for t in r["terms"] or []]
        every = [(i, v) for i, r in enumerate(block) for v in (r["variants"] or [] if variants is not None else [])]
        made = _Block(
            np.array([r["q_id"] for r in block], np.int64), np.array([v["v_id"] for _, v in every], np.int64), np.array([i for i, _ in every], np.int64),
            np.array([v["embedding"] for _, v in every], np.float64), [t["term"] for t in pairs], owner, [t["idf"] for t in pairs], avgdl, k1, b,
        )
        return rows.mapInArrow(_pass_of(spark.sparkContext.broadcast(made), k if every else 0, m), schema)

    for r in held.orderBy("q_id").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part, block = searched(block), []
            found = part if found is None else found.unionByName(part)
    if block:
        part = searched(block)
        found = part if found is None else found.unionByName(part)
    found = files.kept(found, "found") if found is not None else spark.createDataFrame([], schema)
    near = ranked(found.where("dist is not null"), ["id"], [F.col("dist"), F.col("chunk_pos")], k).drop("rank").withColumnRenamed("id", "v_id")
    best = ranked(found.where("dist is null"), ["id"], [F.desc("bm25"), F.col("chunk_pos")], m).drop("rank", "dist").withColumnRenamed("id", "q_id")
    return near, best


def lexical_search(questions: DataFrame, rows: DataFrame, terms: DataFrame, stats: DataFrame, m: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(q_id, chunk_pos, bm25, rank): :func:`lexical_topk` by :func:`one_pass`."""
    return lexical_topk(questions, one_pass(questions, rows, terms, stats, m=m, k1=k1, b=b)[1], rows, m)


# --- fusion -------------------------------------------------------------------------


def minmax(value: str, by: list[str], reverse: bool = False) -> Column:
    """A value scaled to 0..1 in its group; a group without spread is 1 everywhere."""
    w = Window.partitionBy(*by)
    lo, hi, x = F.min(value).over(w), F.max(value).over(w), F.col(value)
    return F.when(hi - lo < 1e-12, F.lit(1.0)).otherwise(((hi - x) if reverse else (x - lo)) / (hi - lo))


def fuse(pool: DataFrame, conf: Config = Config()) -> DataFrame:
    """Adds semantic_score, lexical_score and score to a pool (q_id, chunk_pos, dist,
    bm25, hint_score). Scaling is within the pool of a question."""
    out = pool.withColumn("semantic_score", minmax("dist", ["q_id"], True)).withColumn("lexical_score", minmax("bm25", ["q_id"]))
    total = conf.weight_semantic * F.col("semantic_score") + conf.weight_lexical * F.col("lexical_score") + conf.weight_hint * F.col("hint_score")
    return out.withColumn("score", F.round(total, DIGITS))


def keep_first_text(rows: DataFrame, key: str = "norm") -> DataFrame:
    """One row per question and normalised text, the best; empty texts go."""
    first = ranked(rows.where(F.col(key) != ""), ["q_id", key], [F.desc("score"), F.col("chunk_pos")], 1, "pl_first")
    return first.drop("pl_first")


def retrieve(questions: DataFrame, index: dict[str, DataFrame], embedder: Embedder, final_k: int | None = None, conf: Config = Config()) -> DataFrame:
    """Hybrid retrieval of (q_id, question): q_id, rank, chunk_pos, score,
    semantic_score, lexical_score, hint_score, text and the columns of the chunks.

    The pool of a question is the union of its nearest passages over all variants and
    its lexical top; each member has its true BM25 score, and the distance 2 where no
    variant found it.
    """
    final_k = final_k or conf.final_k
    q = questions.select(F.col("q_id").cast("bigint").alias("q_id"), (F.col("question") if conf.strict_compat else text.nfc("question")).alias("question"))
    variants = q.select("q_id", F.posexplode(text.expanded_queries("question")).alias("variant", "text"))
    spread = variants.withColumn("v_id", F.col("q_id") * 4 + F.col("variant"))
    q_vectors = embedded(spread.select("v_id", "text"), embedder, query=True).select(F.col("v_id").alias("q_id"), "embedding")
    m = max(40, 5 * final_k)
    owned = q_vectors.select(F.floor(F.col("q_id") / 4).cast("bigint").alias("q_id"), F.col("q_id").alias("v_id"), "embedding")
    near, lexical = one_pass(q, index["forward"], index["terms"], index["stats"], conf.semantic_k, m, owned, conf.bm25_k1, conf.bm25_b)
    top = lexical_topk(q, lexical, index["forward"], m)
    dense = near.select(F.floor(F.col("v_id") / 4).cast("bigint").alias("q_id"), "chunk_pos", "dist", "bm25")
    pool = dense.unionByName(top.select("q_id", "chunk_pos", F.lit(None).cast("double").alias("dist"), "bm25")).groupBy("q_id", "chunk_pos").agg(F.min("dist").alias("dist"), F.max("bm25").alias("bm25"))
    pool = pool.withColumn("dist", F.coalesce("dist", F.lit(conf.missing_distance)))
    pool = files.kept(pool.join(q.select("q_id", text.question_type("question").alias("kind")), "q_id"), "pool")
    full = pool.join(_marked(index["chunks"], pool), "chunk_pos").withColumn("hint_score", _hint_of(F.col("kind")))
    best = ranked(keep_first_text(fuse(full.drop("hints"), conf)), ["q_id"], [F.desc("score"), F.col("chunk_pos")], final_k)
    if final_k > conf.semantic_k:
        best = _filled_up(best, final_k, q_vectors, q, index)
    best = best.select("q_id", F.col("rank").cast("bigint").alias("rank"), "chunk_pos", "score", "semantic_score", "lexical_score", "hint_score")
    return best.join(index["chunks"], "chunk_pos").select(*best.columns, *[c for c in index["chunks"].columns if c != "chunk_pos"])


def _marked(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chunk_pos, norm, hints) of the passages that ``pairs`` has: a digest of the
    normalised text (empty if that is) and the hint score for each type of question. What
    depends on the text is worked out once a passage, so that no text moves with the pairs."""
    met = chunks.join(pairs.select("chunk_pos").distinct(), "chunk_pos", "left_semi").select("chunk_pos", text.normalize_text("text").alias("body"))
    return met.select("chunk_pos", F.when(F.col("body") == "", "").otherwise(F.sha2("body", 256)).alias("norm"), text.hint_scores("body").alias("hints"))


def _hint_of(kind: Column) -> Column:
    return F.coalesce(F.col("hints")[kind], F.col("hints")[lang.DEFAULT_TYPE])


def _filled_up(best: DataFrame, near_k: int, q_vectors: DataFrame, questions: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Questions short of results take their next nearest passages, scored by
    distance alone: max(0, 0.4 - d / 10)."""
    kinds = questions.select("q_id", text.question_type("question").alias("kind"))
    near = dense_topk(q_vectors, index["vectors"], near_k).withColumn("variant", F.col("q_id") % 4).withColumn("q_id", F.floor(F.col("q_id") / 4).cast("bigint"))
    near = files.kept(near, "near")
    more = near.join(_marked(index["chunks"], near), "chunk_pos").join(kinds, "q_id").where("norm <> ''")
    more = more.join(best.select("q_id", "norm"), ["q_id", "norm"], "left_anti")
    more = ranked(more.withColumnRenamed("rank", "near_rank"), ["q_id", "norm"], [F.col("variant"), F.col("near_rank")], 1, "pl_first").drop("pl_first")
    value = F.greatest(F.lit(0.0), 0.40 - F.col("dist") / 10.0)
    more = more.withColumn("score", value).withColumn("semantic_score", value).withColumn("lexical_score", F.lit(0.0)).withColumn("hint_score", _hint_of(F.col("kind"))).withColumn("bm25", F.lit(0.0)).drop("hints")
    both = best.withColumn("later", F.lit(0)).withColumn("variant", F.lit(0)).withColumn("near_rank", F.col("rank").cast("bigint")).unionByName(more.withColumn("later", F.lit(1)).withColumn("rank", F.lit(0)), allowMissingColumns=True)
    return ranked(both.drop("rank"), ["q_id"], [F.col("later"), F.col("variant"), F.col("near_rank")], near_k).drop("later", "variant", "near_rank")
