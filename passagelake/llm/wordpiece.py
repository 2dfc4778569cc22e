"""Token counts by a linear longest-match automaton.

Greedy longest match over a vocabulary of byte strings, without building pieces: a
trie with failure links, and at each node the number of tokens that are popped when
its failure link is taken. Every input byte is read once; the number of link steps
is bounded by the number of bytes, so a word of n bytes costs O(n).

Words are runs of anything but ASCII white space; each is matched with one space in
front, the convention of byte-level vocabularies. Bytes that the vocabulary cannot
begin a piece with count as one token each (``unknown``).

Defined cases: null and empty texts have 0 words and 0 tokens; texts of any length
are read whole; rows repeat as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_buffers

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 400_000


def read_vocab(path: str = VOCAB) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """``step`` maps node * 256 + byte to a node; ``link`` is the failure link (-1:
    none), ``pops`` the tokens popped on taking it."""

    def __init__(self, vocab):
        self.step: dict[int, int] = {}
        ends = {0: False}
        parents: list[tuple[int, int]] = [(-1, -1)]
        for piece in vocab:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                to = self.step.get(key)
                if to is None:
                    to = self.step[key] = len(parents)
                    parents.append((at, byte))
                    ends[to] = False
                at = to
            if at:
                ends[at] = True
        self.pieces = {v for v, end in ends.items() if end}
        n = len(parents)
        depth = [0] * n
        for v in range(1, n):  # a parent is numbered before its children
            depth[v] = depth[parents[v][0]] + 1
        self.link, self.pops = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            up, byte = parents[v]
            if v in self.pieces:  # the whole node is a piece: pop it, start again
                self.link[v], self.pops[v] = 0, 1
                continue
            at, popped = self.link[up], self.pops[up]
            while at >= 0 and (at << 8 | byte) not in self.step:
                popped += self.pops[at]
                at = self.link[at]
            if at >= 0:
                self.link[v], self.pops[v] = self.step[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest match; an unmatched byte is one token."""
        step, link, pops = self.step, self.link, self.pops
        at = total = 0
        i, n, begun = 0, len(word), 0  # begun: where the unpopped text begins
        stuck = False
        while i < n and not stuck:
            byte = word[i]
            to = step.get(at << 8 | byte)
            while to is None:
                if link[at] < 0:
                    stuck = True
                    break
                total += pops[at]
                at = link[at]
                to = step.get(at << 8 | byte)
            if not stuck:
                at = to
                i += 1
        if not stuck:
            while at:
                if link[at] < 0:
                    stuck = True
                    break
                total += pops[at]
                at = link[at]
        return self._with_unknown(word) if stuck else total

    def _with_unknown(self, word: bytes) -> int:
        """Plain longest match, for words with bytes outside the vocabulary: the
        automaton gives no count when a piece cannot be completed."""
        total = i = 0
        while i < len(word):
            at, j, last = 0, i, -1
            while j < len(word) and (at := self.step.get(at << 8 | word[j], -1)) >= 0:
                j += 1
                if at in self.pieces:
                    last = j
            i = last if last > 0 else i + 1
            total += 1
        return total


def _count_batches(shared):
    def run(batches):
        automaton, known = shared.value, {}
        for batch in batches:
            raw, offs = text_buffers(batch.column(batch.schema.get_field_index("text")))
            data = raw.tobytes()
            words, tokens = [], []
            for i in range(len(offs) - 1):
                found = data[offs[i] : offs[i + 1]].split()
                total = 0
                for w in found:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(b" " + w)
                        if len(w) <= 64:
                            known[w] = n
                    total += n
                words.append(len(found))
                tokens.append(total)
                if len(known) > REMEMBERED:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocab_path: str = VOCAB) -> DataFrame:
    """doc_id, n_words, n_tokens. The automaton is broadcast; its size is bounded by
    the vocabulary file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton(read_vocab(vocab_path)))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_count_batches(shared), "doc_id bigint, n_words bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
