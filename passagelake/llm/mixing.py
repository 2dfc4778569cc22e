"""Mixing sources to target weights.

Every document gets a random key that is a hash of its id (so reruns agree). Keys
are uniform, so equal ranges of the key space are equal shares of the rows: the
leading digits of the key are the range partition, known without sampling, and a
source with a third of all rows is spread over all ranges. Token counts are summed
per (source, range); a running sum over that small table gives every range its
offset, and a running sum inside the range gives every document its place. The mix
takes whole epochs of a source plus the documents in front of the cut; the document
on the cut is taken in part, so each source meets its budget exactly (rounded down
to whole words).

Defined cases: null text has size 0; null source is a source of its own, sorted
last; equal ids share a key and are ordered by size; a null id gets the key of its text;
an empty table gives an empty result; a source of size 0 has target 0. Extra columns are
not read unless kept; kept ones never clash with helpers, and those with a result's
name are renamed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def random_key(doc_id: Column | str, seed: str = "mix") -> Column:
    """15 hex digits of an md5: the same in every engine and every run."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col.cast("string"), F.lit("")))), 1, 15)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """Water-filling over a table (source, source_size) of one row per source.

    Every source gets ``weight * level`` but at most ``max_epochs`` times its size;
    the level is the one at which all targets add up to ``share`` of all sizes.
    Sources reach their cap in the order of cap / weight, so the level follows from
    running sums over that order.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w.cast("bigint")).withColumn("cap", F.col("source_size") * int(max_epochs))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("w_all", F.sum("weight").over(everything))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
        # the level is right at the first source that it leaves below its cap
        .withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").isNull().alias("z"), "source", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


RESULT = ("doc_id", "size", "source_size", "target", "taken")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    rows_per_range: int = 2_000,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the columns in ``keep``, which pass
    through one shuffle with their row. A kept column that has the name of a result is
    called ``docs_<name>``."""
    key, band, upto, no_source, source = fresh(docs, "key", "band", "upto", "no_source", "source")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    helpers = [size.alias("size"), random_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))), seed).alias(key)]
    # the source without nulls: then one partitioning serves the sums and the join
    helpers += [F.col("source").isNull().alias(no_source), F.coalesce(F.col("source").cast("string"), F.lit("")).alias(source)]
    sized = written(docs.select("doc_id", *helpers), "mix-sizes")
    per_source = sized.groupBy(no_source, source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n = per_source.agg(F.sum("n")).first()[0] or 0
    digits = 1
    while 16**digits * rows_per_range < n and digits < 8:
        digits += 1
    named = {c: f"docs_{c}" if c in RESULT else c for c in keep}
    rows = docs.select("doc_id", *helpers, *[F.col(f"`{c}`").alias(f"{band}{i}") for i, c in enumerate(keep)]) if keep else sized
    names = F.when(F.col(no_source), F.lit(None)).otherwise(F.col(source))
    targets = source_targets(per_source.select(names.alias("source"), "source_size"), weights, share, max_epochs)
    targets = targets.select(F.col("source").isNull().alias(no_source), F.coalesce("source", F.lit("")).alias(source), "source_size", "target")
    sums = sized.groupBy(no_source, source, F.substring(key, 1, digits).alias(band)).agg(F.sum("size").alias("band_size"))
    ahead = Window.partitionBy(no_source, source).orderBy(band).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("band_size").over(ahead), F.lit(0))).drop("band_size").join(targets, [no_source, source])
    inside = Window.partitionBy(no_source, source, band).orderBy(key, "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn(band, F.substring(key, 1, digits)).withColumn(upto, F.sum("size").over(inside))
    placed = placed.join(offsets, [no_source, source, band])
    before = F.col("offset") + F.col(upto) - F.col("size")
    goal = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size")).cast("bigint")).otherwise(F.lit(0))
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"), *[F.col(f"{band}{i}").alias(named[c]) for i, c in enumerate(keep)])


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1]::BIGINT AS weight,
             (2 * source_size)::BIGINT AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER p, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER p, 0)::BIGINT AS w_before,
             (SELECT sum(source_size)::BIGINT * 1.5::DOUBLE FROM w) AS budget, (SELECT sum(weight)::BIGINT FROM w) AS w_all
      FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - cap_before::DOUBLE) / (w_all - w_before)::DOUBLE AS level FROM r),
f AS (SELECT level AS final FROM l WHERE level * weight < cap ORDER BY cap::DOUBLE / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN (SELECT final FROM f) IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, (SELECT final FROM f) * weight) END AS target FROM l),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d),
g AS (SELECT c.doc_id, c.size, c.ahead, t.source_size, t.target, floor(t.target)::BIGINT AS goal
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs FROM g)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - ahead)))::BIGINT AS taken
FROM e
"""
