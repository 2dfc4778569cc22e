"""Quality rules: counts of the text and bands of n-gram perplexity by language.

The model (:mod:`charlm`) is counted over all documents. A text's perplexity is that
of its words: bits of its characters divided by its words, and bits divided by its
characters; each language gets a lower and an upper band for both, set by the
quartiles of all its documents that pass the base rules. A mean over few words
scatters more, so a band widens as sqrt(1 + SHORT / words). A text outside of a band
is rejected. Words without any letter or digit do not count as words here.

Defined cases: null and empty texts have no words and fail the base rules; a null
language is a language of its own; languages with one document have a band of that
document's width plus the margin; repeated rows repeat; other columns, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm
from .common import bounded_batches, table, written

WINDOW = 5
SYMBOLS = frozenset("#*$%&|<>")
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Bands reach this many interquartile ranges beyond the quartiles, and MARGIN bits. Low
#: perplexity is often a stock passage in a short text, so that side is the wider.
REACH_LOW = 5.0
REACH_HIGH = 3.0
MARGIN = 0.05
SHORT = 100

_SPOKEN = re.compile(rb"[^\x20\x09-\x0D]*[0-9A-Za-z\x80-\xff][^\x20\x09-\x0D]*")


def repeated_words(words: list, k: int = WINDOW) -> int:
    """Words inside k-word windows that occur twice or more."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    names: dict = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) ** k < 2**62:
        key = np.zeros(n, np.int64)
        for i in range(k):
            key = key * len(names) + ids[i : i + n]
    else:  # pairs, then pairs of pairs: exact names at any vocabulary
        key = ids[:n]
        for i in range(1, k):
            _, key = np.unique(key * len(names) + ids[i : i + n], return_inverse=True)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[k : k + n] -= twice
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words
    with a letter or digit."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() cuts at the six ASCII white-space characters
    blank = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - blank, symbols, len(lines) - len(set(lines)), repeated_words(words), len(_SPOKEN.findall(data))


RULE_SCHEMA = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, word_bits double, char_bits double"


def _rule_batches(shared):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 6)
            read = [charlm.squeeze(t) for t in texts]
            bits = shared.value.text_bits(read)
            chars = np.array([len(t) for t in read])
            per_word, per_char = bits / np.maximum(1, counts[:, 5]), bits / np.maximum(1, chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[:, i]) for i in range(5)], pa.array(per_word), pa.array(per_char)], [x.split()[0] for x in RULE_SCHEMA.split(", ")])

    return run


def train(docs: DataFrame) -> charlm.NgramModel:
    return charlm.kneser_ney(written(charlm.count_ngrams(docs), "ngrams"))


def measured(docs: DataFrame) -> DataFrame:
    """The counts and bits of every row, as a written table."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_rule_batches(shared), RULE_SCHEMA), "rules")


def apply_rules(docs: DataFrame, reach_low: float = REACH_LOW, reach_high: float = REACH_HIGH) -> DataFrame:
    """doc_id, lang, the counts, base_failed, kept, and the bits with their bands."""
    found = measured(docs).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    quarts = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c in ("word_bits", "char_bits")]
    bands = found.where(~F.col("base_failed")).groupBy("lang").agg(*quarts)
    out = found.join(bands.select(F.col("lang").alias("of"), *[F.col(c).alias(f"{c}_quartiles") for c in ("word_bits", "char_bits")]), F.expr("lang <=> of"), "left").drop("of")
    inside = F.lit(True)
    for c in ("word_bits", "char_bits"):
        low, high = F.col(f"{c}_quartiles")[0], F.col(f"{c}_quartiles")[1]
        wide = (high - low) * F.sqrt(1 + F.lit(float(SHORT)) / F.greatest("n_words", F.lit(1)))
        out = out.withColumn(f"{c}_low", low - reach_low * wide - MARGIN).withColumn(f"{c}_high", high + reach_high * wide + MARGIN)
        inside = inside & F.coalesce(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_bits", "char_bits")
