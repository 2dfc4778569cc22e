"""Exact nearest neighbours of many queries, by cells around pivots.

Vectors belong to the cell of their nearest pivot. For each cell the number of its vectors
and their least and greatest distance from the pivot are known. A query looks into its own
cell first; its k-th distance there, or what the cells' sizes promise, is a bound. By the
triangle inequality and by the plane between two pivots a cell has a least distance from the
query; only cells that begin within the bound are searched after that. Nothing is lost: the
result is that of comparing all pairs.

Both sides are tables. Queries meet vectors by a cogroup on (cell, part, share): a cell
of many vectors is cut into parts and one of many queries into shares, so a common vector or
a favourite cell is no task of its own. Where vectors lie so evenly that most cells are
within the bound, all queries meet all vectors on a grid of pieces instead: that is quadratic,
but a piece is bounded and pairs are screened by a product of matrices. What the driver sees
are the pivots, and one row of numbers a cell, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files

DIGITS = 9
PIVOTS = 64
#: Vectors of a part, and queries of a share.
PART = 1 << 16
#: Queries and vectors whose distances are held at once while they are screened.
TILE = (256, 4096)
#: Numbers that a worker holds at once while it compares.
CELLS = 1 << 20
#: Where cells leave a query this share of all vectors, they are not worth a row a cell.
CROWDED = 0.25
#: Rounding of distances must not hide a neighbour at the bound.
SLACK = 1e-6


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) squared distances as exact differences, in slices."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELLS // max(1, b.size))
    for lo in range(0, len(a), step):
        diff = a[lo : lo + step, None, :] - b[None, :, :]
        out[lo : lo + step] = np.einsum("qvd,qvd->qv", diff, diff)
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


class Nearest:
    """The k nearest of the vectors that were added, for each of some queries: distances rounded,
    ties by place.

    A product of matrices in single precision tells which vectors may be within a query's
    bound, its error added to the bound; only those are compared exactly. The bound is given, and
    tightens to the k-th distance found so far."""

    def __init__(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.squares = np.einsum("qd,qd->q", queries, queries)
        self.bound = np.full(len(queries), np.inf) if bound is None else np.array(bound, np.float64)
        self.held = {}  # of a tile of queries: (row, place, distance)

    def add(self, vectors: np.ndarray, places: np.ndarray) -> None:
        if not len(vectors) or not len(self.queries):
            return
        squares = np.einsum("vd,vd->v", vectors, vectors)
        most = max(squares.max(), self.squares.max())
        kind = np.float32 if most < 1e30 else np.float64 if most < 1e300 else None  # None: too great, or no number
        if kind is not None:
            right = np.concatenate([vectors, squares[:, None]], 1).astype(kind).T
            error = 2 * (vectors.shape[1] + 8) * (np.finfo(kind).eps / 2) * (self.squares + 2 * squares.max()) + 1e-8
            reach = 4 * (self.squares + squares.max()) + 1  # no vector is further away
        for lo in range(0, len(self.queries), TILE[0]):
            q = self.queries[lo : lo + TILE[0]]
            rows = slice(lo, lo + len(q))
            if kind is not None:
                left = np.concatenate([-2 * q, np.ones((len(q), 1))], 1).astype(kind)
            waiting, n = [], 0
            for at in range(0, len(vectors), TILE[1]):
                if kind is None:
                    near, limit = squared(q, vectors[at : at + TILE[1]]), self.bound[rows] + 1e-8
                else:
                    near = left @ right[:, at : at + TILE[1]]
                    limit = np.minimum(self.bound[rows], reach[rows]) - self.squares[rows] + error[rows]
                    free = np.nonzero(np.isinf(self.bound[rows]))[0]
                    if len(free) and near.shape[1] > self.k:
                        limit[free] = np.minimum(limit[free], np.partition(near[free], self.k - 1, 1)[:, self.k - 1] + 2 * error[rows][free])
                row, col = np.nonzero(near <= limit.astype(near.dtype)[:, None])
                if len(row):
                    waiting.append((row, places[at + col], self._exactly(q, vectors, row, at + col)))
                    n += len(row)
                if waiting and (n >= self.k * len(q) or at + TILE[1] >= len(vectors)):
                    self._merge(lo, len(q), waiting)
                    waiting, n = [], 0

    def _exactly(self, q: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        step = max(1, CELLS // (8 * max(1, q.shape[1])))
        for lo in range(0, len(row), step):
            diff = q[row[lo : lo + step]] - vectors[col[lo : lo + step]]
            out[lo : lo + step] = np.einsum("pd,pd->p", diff, diff)
        return np.round(out, DIGITS)

    def _merge(self, lo: int, n: int, more: list) -> None:
        row, place, dist = (np.concatenate(x) for x in zip(*([self.held[lo]] if lo in self.held else []), *more))
        fit = dist <= self.bound[lo + row]
        row, place, dist = row[fit], place[fit], dist[fit]
        order = np.lexsort((place, dist, row))
        row, place, dist = row[order], place[order], dist[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.bound[lo + row[last]] = dist[last]
        fit = rank < self.k
        self.held[lo] = row[fit], place[fit], dist[fit]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, place, distance), sorted."""
        parts = [(lo + row, place, dist) for lo, (row, place, dist) in sorted(self.held.items())]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


@dataclass
class Partition:
    """Pivots, and of each cell its vectors, least and greatest distance from the pivot."""

    pivots: np.ndarray
    count: np.ndarray
    least: np.ndarray
    greatest: np.ndarray

    def bounds(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell, least distance to each cell, distance within which k vectors are sure)."""
        d = np.sqrt(squared(queries, self.pivots))
        own = d.argmin(1)
        reach = np.where(self.count > 0, d + self.greatest, np.inf)
        order = reach.argsort(1)
        enough = np.cumsum(self.count[order], 1) >= k
        at = np.where(enough.any(1), enough.argmax(1), 0)
        row = np.arange(len(queries))
        sure = np.where(enough.any(1), reach[row, order[row, at]], np.inf)
        apart = np.sqrt(squared(self.pivots, self.pivots))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - d[row, own][:, None] ** 2) / (2 * apart[own])
        begins = np.maximum.reduce([d - self.greatest, self.least - d, np.where(np.isfinite(plane), plane, 0.0), np.zeros_like(d)])
        return own, np.where(self.count > 0, begins, np.inf), sure


def _mapped(rows: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return files.bounded(rows).mapInArrow(run, schema)


def cells_of(vectors: DataFrame, pivots: int = PIVOTS, pos: str = "chunk_pos") -> tuple[Partition, DataFrame]:
    """The partition of a table of vectors, and (cell, part, chunk_pos, embedding), written.
    Pivots are the vectors of least hash, a bounded sample; any choice gives right results."""
    v = vectors.select(F.col(pos).cast("bigint").alias("chunk_pos"), F.col("embedding").cast("array<double>").alias("embedding"))
    chosen = [r["embedding"] for r in v.orderBy(F.xxhash64("chunk_pos"), "chunk_pos").limit(pivots).select("embedding").collect()]
    centres = np.unique(np.array(chosen, np.float64), axis=0) if chosen else np.empty((0, 0))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = squared(matrix(batch.column(1)), centres)
        own = d.argmin(1)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.sqrt(d[np.arange(len(own)), own])), *batch.columns], ["cell", "gap", "chunk_pos", "embedding"])

    placed = files.kept(_mapped(v, "cell int, gap double, chunk_pos bigint, embedding array<double>", place), "cells")
    n = len(centres)
    known = Partition(centres, np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("greatest")).collect():
        known.count[r["cell"]], known.least[r["cell"]], known.greatest[r["cell"]] = r["n"], r["least"], r["greatest"]
    return known, placed.select("cell", "chunk_pos", "embedding")


def _searched(routed: DataFrame, cells: DataFrame, counts: dict[int, int], k: int) -> DataFrame:
    """(q_id, chunk_pos, dist): up to k vectors of each routed cell's parts within the bound.
    ``routed`` is (cell, q_id, embedding, bound); ``counts`` the vectors of each cell."""
    asked = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}
    pieces = lambda of: {c: -(-n // PART) for c, n in of.items() if n}
    parts, shares = pieces(counts), pieces(asked)

    def number(of: dict[int, int]):
        many = {c: n for c, n in of.items() if n > 1}
        return F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("cell")], F.lit(1)) if many else F.lit(1)

    wanted = cells.where(F.col("cell").isin(list(asked))) if asked else cells.limit(0)
    return _met(routed, wanted, number(shares), number(parts), k)


def _met(queries: DataFrame, vectors: DataFrame, shares: Column, parts: Column, k: int, tasks: int | None = None) -> DataFrame:
    """(q_id, chunk_pos, dist): queries (cell, q_id, embedding, bound) against the vectors
    (cell, chunk_pos, embedding) of their cell, each cut into pieces of which all pairs meet;
    of a pair of pieces up to k vectors a query within the bound."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.withColumn("share", F.pmod(F.xxhash64("q_id"), shares).cast("int")).withColumn("part", spread(parts))
    right = vectors.withColumn("part", F.pmod(F.xxhash64("chunk_pos"), parts).cast("int")).withColumn("share", spread(shares))

    def compare(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, places, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if queries.num_rows and vectors.num_rows:
            best = Nearest(matrix(queries.column("embedding")), k, queries.column("bound").to_numpy())
            best.add(matrix(vectors.column("embedding")), vectors.column("chunk_pos").to_numpy())
            row, places, dist = best.found()
            ids = queries.column("q_id").to_numpy()[row]
        return pa.table({"q_id": pa.array(ids, pa.int64()), "chunk_pos": pa.array(places, pa.int64()), "dist": pa.array(dist, pa.float64())})

    keys = ("cell", "part", "share")
    if tasks:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "q_id bigint, chunk_pos bigint, dist double")


def _grid(queries: DataFrame, cells: DataFrame, n: int, k: int) -> DataFrame:
    """The same of all vectors, where cells leave out too little: both tables are cut into pieces
    without regard to cells, at most PART rows each, and more where that gives the cores work."""
    asked = queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    piece = max(1, min(PART, int((asked * n / (4 * cores)) ** 0.5)))
    shares, parts = -(-asked // piece), -(-n // piece)
    whole = F.lit(0).alias("cell")
    return _met(queries.select(whole, "q_id", "embedding", "bound"), cells.select(whole, "chunk_pos", "embedding"), F.lit(shares), F.lit(parts), k, 2 * shares * parts)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy("dist", "chunk_pos")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def knn_by_cells(queries: DataFrame, vectors: DataFrame, k: int, pivots: int = PIVOTS, pos: str = "chunk_pos") -> tuple[DataFrame, DataFrame]:
    """(q_id, chunk_pos, dist, rank), the k nearest vectors of each query by squared
    distance, ties by position; and (q_id, pairs), how many vectors it was compared with.
    ``queries`` is (q_id, embedding), one row an id."""
    known, cells = cells_of(vectors, pivots, pos)
    spark = vectors.sparkSession
    if not len(known.pivots):
        return spark.createDataFrame([], "q_id bigint, chunk_pos bigint, dist double, rank bigint"), queries.select(F.col("q_id").cast("bigint").alias("q_id"), F.lit(0).cast("bigint").alias("pairs"))
    shared, counts = spark.sparkContext.broadcast(known), dict(enumerate(known.count.tolist()))
    q = queries.select(F.col("q_id").cast("bigint").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, _, sure = shared.value.bounds(matrix(batch.column(1)), k)
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns, pa.array(sure**2 + SLACK)], ["cell", "q_id", "embedding", "bound"])

    first = files.kept(_mapped(q, "cell int, q_id bigint, embedding array<double>, bound double", home), "queries")
    near = files.kept(_best(_searched(first, cells, counts, k), k), "near")
    reached = near.where(F.col("rank") == k).select("q_id", (F.col("dist") + SLACK).alias("within"))
    bound = first.join(reached, "q_id", "left").select("q_id", "embedding", F.least("bound", F.coalesce("within", "bound")).alias("bound"))

    def reached_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own, begins, _ = shared.value.bounds(matrix(batch.column(1)), k)
        open_ = begins <= np.sqrt(batch.column(2).to_numpy())[:, None] + SLACK
        open_[np.arange(len(own)), own] = False
        return np.nonzero(open_ & np.isfinite(begins))

    def meets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([float(shared.value.count[reached_cells(batch)[1]].sum())]), pa.array([batch.num_rows], pa.int64())], ["pairs", "n"])

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, cell = reached_cells(batch)
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(c.take(pa.array(row)) for c in batch.columns)], ["cell", "q_id", "embedding", "bound"])

    bound = files.kept(bound, "bounds")
    n, met = int(known.count.sum()), _mapped(bound, "pairs double, n bigint", meets).agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
    if met["n"] and met["pairs"] > CROWDED * met["n"] * n:
        best = _best(_grid(bound, cells, n, k), k)
        return best.select("q_id", "chunk_pos", "dist", "rank"), first.select("q_id", F.lit(n).cast("bigint").alias("pairs"))
    second = files.kept(_mapped(bound, "cell int, q_id bigint, embedding array<double>, bound double", route), "routed")
    best = _best(near.drop("rank").unionByName(_searched(second, cells, counts, k)), k)
    sizes = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    pairs = first.select("q_id", "cell").unionByName(second.select("q_id", "cell")).groupBy("q_id").agg(F.sum(sizes[F.col("cell")]).cast("bigint").alias("pairs"))
    return best.select("q_id", "chunk_pos", "dist", "rank"), pairs
