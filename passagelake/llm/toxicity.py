"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A written token is taken as a noisy copy of a word: letters replaced by look-alike
digits and signs, letters repeated, letters spaced or dotted apart. Its possible
readings form a lattice; a Viterbi search over the lattice under a character model
of the whole corpus (:mod:`charlm`, lower case) finds the likeliest one, over all paths
and for tokens of any length, look-alikes alone included (but digits alone are a number). A plain
token has one reading, so it needs no search. A doubled letter is common in any
language: it becomes an arc only where its collapsed form is in the lexicon below.

The restored text is scored by a lexicon of words and word beginnings, learned from
a bounded sample of labelled rows: terms whose share of toxic rows is high with
statistical certainty, if need be only from two or three occurrences in a text on.
The score is the highest share among the terms of a text.

Defined cases: null and empty texts get the base rate; null labels are left out;
without any toxic label the lexicon is empty and every score the base rate; a null
doc_id counts as held out; repeated rows repeat; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import charlm
from .common import bounded_batches, table, written
from .quality import held_out, label_sample
from .simhash import shingle_hashes

MAX_ROWS = 20_000
THRESHOLD = 0.5
ORDER = 5
# Look-alikes.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
CLASSES = str.maketrans({"1": "i", "!": "i", "|": "i", "l": "i", "0": "o", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z", "€": "e"})
#: Bits of the channel.
COST_LEET, COST_COLLAPSE, COST_DOUBLE, COST_DROP, COST_JOIN = 1.5, 1.0, 3.0, 3.0, 0.5
TRAILING = ".,;:!?\"'()[]{}#*%&<>~^»«…"
_SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:[ .\-_*]{1,2}[\w@$!|+]){2,}[.,;:!?]?(?!\S)")
_LONG_RUN = re.compile(r"([^\W\d_])\1\1")
_TAIL_RUN = re.compile(r"([^\w\s])\1\1+$")
_LETTER = re.compile(r"[^\W\d_]|[@$!|+€]")
_DOUBLE = re.compile(r"(.)\1+")
#: Tokens a worker remembers before it starts anew.
REMEMBERED = 300_000


def lower_squeeze(text: str) -> str:
    return charlm.squeeze(text.lower())


class Decoder:
    """Viterbi decoding under a :class:`charlm.NgramModel` of order 5."""

    def __init__(self, model: charlm.NgramModel):
        self.model = model
        self.known: dict[tuple[int, int], float] = {}

    def _bits(self, context: int, symbol: int) -> float:
        got = self.known.get((context, symbol))
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[context, symbol] = -self.model.log2_prob(context << charlm.SYMBOL_BITS | symbol)
        return got

    def _read(self, context: int, text: str) -> tuple[float, int]:
        """(bits, next context) of a text after a context."""
        mask = (1 << charlm.SYMBOL_BITS * (self.model.order - 1)) - 1
        total = 0.0
        for ch in text:
            code = ord("0") if ch.isdigit() else ord(ch)
            for symbol in (code,) if code < charlm.DIRECT else charlm.symbols(np.array([code])).tolist():
                total += self._bits(context, symbol)
                context = (context << charlm.SYMBOL_BITS | symbol) & mask
        return total, context

    def best(self, lattice: list[list[tuple[str, float]]]) -> str:
        """The likeliest reading of a lattice of (written, bits) arcs, over all paths: each
        context keeps its cheapest path. Costs only grow, so a path dearer than the whole
        of the first arcs' path is dropped without loss."""
        lattice = [*lattice, [(" ", 0.0)]]
        most, context = 1e-6, ord(" ")
        for (text, bits), *_ in lattice:
            more, context = self._read(context, text)
            most += bits + more
        states: dict[int, tuple[float, tuple]] = {ord(" "): (0.0, ())}
        for arcs in lattice:
            after: dict[int, tuple[float, tuple]] = {}
            for context, (cost, path) in states.items():
                for text, bits in arcs:
                    more, at = self._read(context, text)
                    total = cost + bits + more
                    if total <= most and (at not in after or total < after[at][0]):
                        after[at] = (total, (path, text))
            states = after
        path, out = min(states.values(), key=lambda x: x[0])[1], []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out)).strip()


def lattice_of(unit: str, doubles: bool = False, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """The readings of a lower-case unit, one list of arcs per run of a character."""
    out = []
    for ch, run in groupby(unit):
        n = len(list(run))
        if ch in LEET:
            arcs = [(ch * n, 0.0)]
            for letter in LEET[ch]:
                arcs += [(letter, COST_LEET + (n > 1) * COST_COLLAPSE)] + ([(letter * 2, COST_LEET)] if n == 2 else [])
            if not ch.isdigit():
                arcs.append(("", COST_DROP))
        elif ch.isalpha():
            if n == 1:
                arcs = [(ch, 0.0)]
            elif n == 2:
                arcs = [(ch * 2, 0.0)] + ([(ch, COST_DOUBLE)] if doubles or spaced else [])
            else:
                arcs = [(ch, COST_COLLAPSE), (ch * 2, COST_COLLAPSE)]
        elif spaced:
            arcs = [("", COST_JOIN), (" ", 0.0)]
        elif ch == "*":
            arcs = [("", COST_DROP), *[(v, COST_LEET + 1) for v in "aeiou"], (ch * n, 0.0)]
        else:
            arcs = [(ch * n, 0.0), ("", COST_DROP)]
        out.append(arcs)
    return out


def trimmed(token: str) -> str:
    """A token without what may stand around a word."""
    return _TAIL_RUN.sub("", token.rstrip(TRAILING)).strip(TRAILING)


def suspicious(core: str) -> bool:
    """Whether a trimmed token has more than one reading (doubled letters apart). One
    without a letter needs a sign that looks like one: digits alone are a number."""
    if core.isalpha():
        return _LONG_RUN.search(core) is not None
    if not _LETTER.search(core):
        return False
    return any(c in LEET or c in ".-_*" for c in core) or _LONG_RUN.search(core) is not None


class Restorer:
    """Restores whole texts; remembers tokens."""

    def __init__(self, model: charlm.NgramModel):
        self.decoder = Decoder(model)
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            core = trimmed(token)
            got = token
            if core and suspicious(core):
                read = self.decoder.best(lattice_of(core))
                if read != core:
                    got = token.replace(core, read, 1)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = got
        return got

    def __call__(self, text: str) -> str:
        """The lower-case restored text; white space stays."""
        text = _SPACED.sub(lambda m: self.decoder.best(lattice_of(m[0].rstrip(TRAILING), spaced=True)), text.lower())
        tokens = set(text.split())
        if not _LONG_RUN.search(text):  # then words of letters alone have one reading
            tokens = [t for t in tokens if not t.isalpha() and not t.rstrip(TRAILING).isalpha()]
        changed = {t for t in tokens if self.token(t) != t}
        if changed:
            text = re.sub(r"\S+", lambda m: self.token(m[0]) if m[0] in changed else m[0], text)
        return text


PREFIXES = (3, 4, 5, 6)


def terms_of(core: str) -> list[str]:
    """A word and its beginnings (marked by ^)."""
    return [core, *["^" + core[:n] for n in PREFIXES if len(core) >= n]] if core else []


class Lexicon:
    """For each term its toxic share at one, two, and three or more occurrences (0
    where it says nothing), a base rate, and the collapsed forms that tell where
    doubled letters may be arcs."""

    def __init__(self, shares: dict[str, tuple[float, float, float]], base: float):
        self.shares, self.base = shares, base
        cores = {t.lstrip("^") for t in shares}
        #: How a token begins that has a term, plain or with its first letter doubled.
        self.heads = {c[:2] for c in cores} | {c[:1] * 2 for c in cores}
        self.folded = {self.fold(c) for c in cores}
        self.lengths = sorted({len(x) for x in self.folded})

    @staticmethod
    def fold(word: str) -> str:
        return _DOUBLE.sub(r"\1", word.translate(CLASSES))

    def may_hide(self, core: str) -> bool:
        folded = self.fold(core)
        return any(folded[:n] in self.folded for n in self.lengths)

    def hits(self, core: str) -> tuple[str, ...]:
        return tuple(t for t in terms_of(core) if t in self.shares)


class Scorer:
    def __init__(self, model: charlm.NgramModel, lexicon: Lexicon):
        self.restore, self.lexicon = Restorer(model), lexicon
        self.known: dict[str, tuple[str, ...]] = {}

    def hits(self, token: str) -> tuple[str, ...]:
        got = self.known.get(token)
        if got is None:
            core = trimmed(token)
            got = self.lexicon.hits(core)
            if not got and _DOUBLE.search(core) and self.lexicon.may_hide(core):
                got = self.lexicon.hits(self.restore.decoder.best(lattice_of(core, doubles=True)))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[token] = got
        return got

    def score(self, restored: str) -> float:
        found: Counter = Counter()
        heads = self.lexicon.heads
        for token, n in Counter([t for t in restored.split() if t[:2] in heads or not t[0].isalnum()]).items():
            for term in self.hits(token):
                found[term] += n
        return max([self.lexicon.base, *(self.lexicon.shares[t][min(n, LEVELS) - 1] for t, n in found.items())])


LEVELS = 3


def _term_batches(shared):
    def run(batches):
        restore = Restorer(shared.value)
        for batch in batches:
            terms, levels, labels = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: Counter = Counter()
                for token, n in Counter(restore(text or "").split()).items():
                    for term in terms_of(trimmed(token)):
                        found[term] += n
                terms += found
                levels += [min(n, LEVELS) for n in found.values()]
                labels += [label] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(levels, pa.int32()), pa.array(labels, pa.int32())], ["term", "level", "label"])

    return run


def _certain(p: int, m: int, base: float, certain: float, least_share: float) -> bool:
    """Whether p toxic of m rows lie above the base rate beyond doubt: likelihood
    ratio and the lower end of a confidence interval."""
    if p < 4 or p / m <= base:
        return False
    share, z = p / m, 1.64
    ratio = 2 * (p * np.log(share / base) + ((m - p) * np.log((1 - share) / (1 - base)) if m > p else 0))
    low = (share + z * z / (2 * m) - z * np.sqrt(share * (1 - share) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return bool(ratio >= certain and low >= least_share)


def term_shares(counts: list[tuple[int, int]], base: float, certain: float, least_share: float) -> tuple[float, ...] | None:
    """Shares by level of a term with (toxic, all) rows at each level: from the first
    level on at which it is certain with all higher levels together, while its own
    rows do not speak against it."""
    for level in range(LEVELS):
        p, m = (sum(x[i] for x in counts[level:]) for i in (0, 1))
        if not m or not _certain(p, m, base, certain, least_share):
            continue
        own_p, own_m = counts[level]
        if own_m >= 5 and own_p / own_m < least_share:
            continue
        prior = p / m
        return tuple(0.0 if i < level else min(0.999, (q + 3 * prior) / (n + 3.01)) for i, (q, n) in enumerate(counts))
    return None


def fit_lexicon(docs: DataFrame, labels: DataFrame, shared, max_rows: int = MAX_ROWS, certain: float = 30.0, least_share: float = 0.7) -> Lexicon:
    """Terms by :func:`term_shares`. ``certain`` is a chi-square of one degree, far
    beyond chance over a million terms. The number of terms is bounded by the sample:
    each needs several toxic rows."""
    sample = label_sample(labels, "toxic", max_rows)
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    joined = written(without_copies(joined.select("doc_id", "text", "label")), "toxic-sample")
    size = joined.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t")).first()
    n, t = int(size["n"] or 0), int(size["t"] or 0)
    if not t or t == n:
        return Lexicon({}, min((t + 1) / (n + 2), 0.4))
    found = joined.select("text", "label").repartition(F.xxhash64("text")).mapInArrow(_term_batches(shared), "term string, level int, label int")
    levels = [x for k in range(1, LEVELS + 1) for x in (F.sum(F.when(F.col("level") == k, F.col("label")).otherwise(0)).alias(f"p{k}"), F.count(F.when(F.col("level") == k, 1)).alias(f"m{k}"))]
    counts = found.groupBy("term").agg(*levels, F.sum("label").alias("p")).where("p >= 4 and (p >= 0.3 * (m1 + m2 + m3) or p2 + p3 >= 0.5 * (m2 + m3) and p2 + p3 >= 4)")
    shares, toxic = {}, {}
    for r in counts.orderBy(F.desc("p"), "term").collect():
        got = term_shares([(int(r[f"p{k}"]), int(r[f"m{k}"])) for k in range(1, LEVELS + 1)], t / n, certain, least_share)
        if got:
            shares[r["term"]], toxic[r["term"]] = got, int(r["p"])
    return Lexicon(most_specific(shares, toxic), min(t / n, 0.4) / 4)


def most_specific(shares: dict, toxic: dict[str, int]) -> dict:
    """Without the word beginnings that owe their toxic rows to one longer term."""
    longer: dict[str, int] = {}
    for term, p in toxic.items():
        core = term.lstrip("^")
        for k in range(min(PREFIXES), len(core)):
            longer[core[:k]] = max(longer.get(core[:k], 0), p)
    return {t: x for t, x in shares.items() if not t.startswith("^") or longer.get(t[1:], 0) < 0.9 * toxic[t]}


def _copy_keys(batches):
    """Two min-hashes of the 4-word shingles of each text."""
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            hashes = np.array(shingle_hashes((text or "").encode("utf-8", "surrogatepass")) or [0], np.uint64)
            keys.append((int(hashes.min() >> np.uint64(1)), int((hashes * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1))))
        k1, k2 = zip(*keys) if keys else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], [*batch.schema.names, "k1", "k2"])


def without_copies(rows: DataFrame) -> DataFrame:
    """One row (doc_id, text, label) for texts that share a min-hash: copies are no
    independent evidence."""
    rows = rows.mapInArrow(_copy_keys, "doc_id bigint, text string, label int, k1 bigint, k2 bigint")
    for key in ("k1", "k2"):
        rows = rows.groupBy(key).agg(F.min_by(F.struct("doc_id", "text", "label", "k1", "k2"), F.struct("doc_id", "text", "label")).alias("r")).select("r.*")
    return rows.select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """(model, lexicon), both broadcast: of the first only where its tables lie in the
    file that each executor has, the second is bounded by the sample."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = charlm.kneser_ney(written(charlm.count_ngrams(docs, lower_squeeze, ORDER), "toxic-ngrams"), ORDER)
    shared = spark.sparkContext.broadcast(model)
    return shared, spark.sparkContext.broadcast(fit_lexicon(docs, labels, shared, max_rows))


def _score_batches(model, lexicon, with_text: bool):
    def run(batches):
        scorer = Scorer(model.value, lexicon.value)
        for batch in batches:
            restored = [scorer.restore(t or "") for t in batch.column(1).to_pylist()]
            scores = pa.array([scorer.score(r) for r in restored], pa.float64())
            if with_text:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(restored, pa.string()), scores], ["doc_id", "restored", "score"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, with_text: bool = True, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, (restored,) score. ``restored`` is the lower-case deobfuscated text."""
    model, lexicon = train(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, restored string, score double" if with_text else "doc_id bigint, score double"
    return rows.mapInArrow(_score_batches(model, lexicon, with_text), schema)


def op3_toxicity_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
