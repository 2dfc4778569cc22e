"""Filter interaction audit: what every filter removes at every place of every order.

Each document is reduced to a mask of the filters it fails, and the masks are counted
into cells: at most ``2**filters`` numbers a part, whatever the input. All orders of the
filters are then visited by single swaps of neighbours. A swap changes nothing before it
and nothing after it, so only the two steps that change places are read anew from the
cells. A filter's Shapley total grows along the walk: whenever its step changes, what it
removed until then is added once for every order that it held.

Defined cases: a null text is empty; a null part is the empty string; a document without
an id is identical to no smaller id, lends its id to nobody and has no label; repeated rows
count each, and rows that share an id and a text do not fail ``E`` by each other; of several
labels of one id any that says 1 counts; an empty table gives no rows; columns besides
doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: More filters than these have too many orders to list.
MOST_FILTERS = 8
#: Parts whose orders one task holds at once.
PARTS_AT_ONCE = 64

SPACES = " \t\n\x0b\x0c\r"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


# --- the walk -----------------------------------------------------------------------


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places i such that swapping i and i + 1, one after the other, visits every order of
    n things once. The largest thing sweeps from end to end; between two sweeps the others
    make one swap of their own walk, which lies one place further while it stands left."""
    if n < 2:
        return
    inner = neighbour_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap + 1
        yield from range(n - 1)
        swap = next(inner, None)
        if swap is None:
            return
        yield swap


def walk_orders(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
    """All orders of n filters over ``cells`` (parts, 2**n masks, measures): the orders in
    the sequence of the walk, what each step removes (parts, orders, steps, measures), what
    is kept after it (parts, orders, steps) and the Shapley totals (parts, filters), both
    of the first measure."""
    parts, _, measures = cells.shape
    masks = np.arange(1 << n)
    seen: dict[tuple[int, int], np.ndarray] = {}

    def lost(before: int, f: int) -> np.ndarray:
        """What filter f removes after the filters of the set ``before``."""
        if (before, f) not in seen:
            seen[before, f] = cells[:, (masks & before == 0) & (masks >> f & 1 == 1)].sum(1)
        return seen[before, f]

    total = factorial(n)
    removed = np.zeros((parts, total, n, measures), np.int64)
    kept = np.zeros((parts, total, n), np.int64)
    shapley = np.zeros((parts, n), np.int64)
    order, orders = list(range(n)), []
    step_removed, step_kept = np.zeros((parts, n, measures), np.int64), np.zeros((parts, n), np.int64)
    before = 0
    left = cells[:, :, 0].sum(1)
    for i, f in enumerate(order):
        step_removed[:, i] = lost(before, f)
        left = left - step_removed[:, i, 0]
        step_kept[:, i] = left
        before |= 1 << f
    since = [0] * n  # the order from which on a filter's step is as it is

    def settle(f: int, place: int, now: int) -> None:
        shapley[:, f] += step_removed[:, place, 0] * (now - since[f])
        since[f] = now

    swaps = neighbour_swaps(n)
    for k in range(total):
        orders.append(tuple(order))
        removed[:, k], kept[:, k] = step_removed, step_kept
        i = next(swaps, None)
        if i is None:
            break
        settle(order[i], i, k + 1)
        settle(order[i + 1], i + 1, k + 1)
        before = sum(1 << f for f in order[:i])
        arrived = step_kept[:, i] + step_removed[:, i, 0]
        order[i], order[i + 1] = order[i + 1], order[i]
        step_removed[:, i] = lost(before, order[i])
        step_removed[:, i + 1] = lost(before | 1 << order[i], order[i + 1])
        step_kept[:, i] = arrived - step_removed[:, i, 0]
    for place, f in enumerate(order):
        settle(f, place, total)
    return orders, removed, kept, shapley


# --- over Spark ---------------------------------------------------------------------


def _audited(names: str, measures: Sequence[str]):
    n = len(names)

    def run(batches):
        for batch in batches:
            every, held = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                parts = every.slice(at, PARTS_AT_ONCE).to_pylist()
                cells = np.zeros((len(parts), 1 << n, len(measures)), np.int64)
                for p, found in enumerate(held.slice(at, PARTS_AT_ONCE).to_pylist()):
                    for cell in found:
                        cells[p, cell["mask"]] = [cell[m] for m in measures]
                orders, removed, kept, shapley = walk_orders(cells, n)
                masks = np.arange(1 << n)
                fails = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(1) for f in range(n)], 1)
                alone = np.stack([cells[:, 1 << f, 0] for f in range(n)], 1)
                who = np.array(orders)  # (orders, steps): the filter of each step
                shape = (len(parts), len(orders), n)
                spread = lambda x: np.ascontiguousarray(np.broadcast_to(x, shape)).ravel()
                columns = [
                    pa.array(np.repeat(np.array(parts, object), len(orders) * n), pa.string()),
                    pa.array(np.tile(np.repeat(np.array(["".join(names[f] for f in o) for o in orders], object), n), len(parts)), pa.string()),
                    pa.array(spread(np.arange(1, n + 1, dtype=np.int32))),
                    pa.array(kept.ravel()),
                    pa.array(removed[..., 0].ravel()),
                    pa.array((fails[:, who] - removed[..., 0]).ravel()),
                    pa.array(spread(alone[:, who])),
                    *(pa.array(removed[..., m].ravel()) for m in range(1, len(measures))),
                    pa.array(spread(shapley[:, who])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{m}_lost" for m in measures[1:]), "shapley"])

    return run


def interactions(cells: DataFrame, names: str, measures: Sequence[str] = ("n",)) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <measure>_lost for
    each measure but the first, shapley: every step of every order of the filters ``names``
    (one letter each, bit i of a mask is the i-th), for every part.

    ``cells`` has columns part, mask and the measures, the first of which counts documents;
    rows of one (part, mask) are added up. A part has at most ``2**filters`` cells, so what
    one task holds does not grow with the documents."""
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) != len(names):
        raise ValueError(f"one to {MOST_FILTERS} filters with different letters, not {names!r}")
    sums = [F.sum(m).cast("bigint").alias(m) for m in measures]
    summed = cells.groupBy("part", F.col("mask").cast("int").alias("mask")).agg(*sums)
    by_part = summed.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))
    longs = "".join(f", {m}_lost bigint" for m in measures[1:])
    schema = f"part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint{longs}, shapley bigint"
    return by_part.mapInArrow(_audited(names, measures), schema)


def mask_of(conditions: Sequence[Column]) -> Column:
    """Bit i is set where condition i holds; a condition that is null does not."""
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(conditions)]
    return sum(bits[1:], bits[0])


def text_conditions(text: Column) -> list[Column]:
    """Under 200 words; under half of the words distinct; over 2 % capitals; a symbol."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.split(trimmed, BETWEEN_WORDS)
    none = (trimmed == "").cast("int")  # splitting nothing gives one empty word
    n_words, n_distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return [n_words < 200, 100 * n_distinct.cast("bigint") < 50 * n_words.cast("bigint"), 100 * capitals > 2 * F.char_length(text).cast("bigint"), text.rlike(r"[#$%&*|]")]


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters by source: A to D as :func:`text_conditions`, E a text that
    some smaller doc_id has as well.

    The texts are read once, into a narrow table. A text's smallest id is an aggregate by
    digest; whether a row is that one is a join by id and digest, so a group of copies of any
    size is no hot key. Rows that repeat are one row with a count before every join, rows
    without an id meet no join at all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        mask_of(text_conditions(text)).alias("mask"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"),
    )
    narrow = written(narrow, "audit-masks")
    known = narrow.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    rows = known.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    copies = F.col("is_first").isNull().cast("int") * 16
    rows = rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + copies).alias("mask"), "n")
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    said = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(said("quality"), said("toxic"))
    marked = rows.join(marks, "doc_id", "left").select("part", "mask", "n", *[F.when(F.col(c), F.col("n")).otherwise(0).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    nameless = narrow.where("doc_id is null").select("part", "mask", F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))
    return interactions(marked.unionByName(nameless), "ABCDE", ("n", "good", "toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A document is removed where the first of the filters that it fails stands.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, CASE WHEN max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS good, CASE WHEN max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) = 1 THEN 1 ELSE 0 END AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x), regexp_matches(x, '[#$%&*|]'),
   coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY x), false)] AS fails FROM w LEFT JOIN m ON m.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || g.c || h.c || i.c AS o FROM l a, l b, l g, l h, l i WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
o AS (SELECT o, s AS step, o[s] AS letter FROM p, (SELECT unnest(range(1, 6)) AS s)),
x AS (SELECT part, o, n, good, toxic, fails, coalesce(list_min(list_transform(list_filter([1, 2, 3, 4, 5], lambda j: fails[j]), lambda j: strpos(o, chr(64 + j::INT)))), 6) AS out_at FROM c, p),
r AS (SELECT part, o.o AS filter_order, o.step, letter,
  sum(CASE WHEN out_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN out_at = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails[ascii(letter) - 64] AND out_at < step THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails[ascii(letter) - 64] AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN out_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN out_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM x JOIN o ON o.o = x.o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
