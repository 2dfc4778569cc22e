"""An index that grows against one that is built at once."""

import math
import random
from collections import Counter

import pytest

from passagelake.operators import delta, index, retrieve

WORDS = "ka lo mi su ter nal vi do pe ra".split()


def rows_of(docs, seed=1):
    rng = random.Random(seed)
    return [(d, d * 100 + i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 15)))) for d in docs for i in range(rng.randint(1, 3))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "document long, chunk_pos long, text string")


def state(ix):
    one = lambda x, *c: sorted(map(tuple, x.select(*c).collect()), key=str)
    n, avgdl = ix["stats"].first()
    terms = {r["term"]: (r["df"], round(r["idf"], 12)) for r in ix["terms"].collect()}
    return one(ix["chunks"], "chunk_pos", "text"), one(ix["forward"], "chunk_pos", "dl"), terms, (n, round(avgdl, 12))


def whole(spark, rows, e):
    """The same, counted in plain Python."""
    tokens = {p: index.plain_tokens(t) for _, p, t in rows}
    df = Counter(t for x in tokens.values() for t in set(x))
    n = len(rows)
    terms = {t: (c, round(math.log(1 + (n - c + 0.5) / (c + 0.5)), 12)) for t, c in df.items()}
    return sorted(((p, t) for _, p, t in rows), key=str), sorted(((p, len(x)) for p, x in tokens.items()), key=str), terms, (n, round(sum(map(len, tokens.values())) / n, 12))


def test_growing_equals_building(spark, tmp_path):
    e, path = index.HashingEmbedder(8), f"{tmp_path}/i"
    first, second, newer = rows_of(range(20)), rows_of(range(20, 26), 2), rows_of(range(3, 8), 3)
    delta.add(frame(spark, first), e, path)
    assert state(delta.load(spark, path, e)) == whole(spark, first, e)
    delta.add(frame(spark, second + newer), e, path)  # 3 to 7 are replaced
    live = [r for r in first if r[0] not in range(3, 8)] + second + newer
    assert state(delta.load(spark, path, e)) == whole(spark, live, e)
    delta.withdraw(frame(spark, [r for r in live if r[0] in (0, 5, 21)] + [(999, 1, "")]), e, path)
    live = [r for r in live if r[0] not in (0, 5, 21)]
    assert state(delta.load(spark, path, e)) == whole(spark, live, e)
    back = rows_of([5, 0], 9)
    delta.add(frame(spark, back), e, path)
    assert len(delta.segments(spark, path)[0]) == 4
    assert state(delta.load(spark, path, e)) == whole(spark, live + back, e)
    held = delta.load(spark, path, e)
    assert len(delta.compact(spark, path)) == 1
    for ix in (delta.load(spark, path, e), held):
        assert state(ix) == whole(spark, live + back, e)
    delta.withdraw(frame(spark, [(1, 0, "")]), e, path)
    assert state(delta.load(spark, path, e)) == whole(spark, [r for r in live + back if r[0] != 1], e)


def test_retrieval_over_segments(spark, tmp_path):
    e, path = index.HashingEmbedder(8), f"{tmp_path}/i"
    first, second = rows_of(range(15)), rows_of(range(10, 22), 4)
    delta.add(frame(spark, first), e, path)
    delta.add(frame(spark, second), e, path)
    live = [r for r in first if r[0] < 10] + second
    qs = spark.createDataFrame([(1, "ka lo"), (2, "pe")], "q_id long, question string")
    shown = lambda ix: sorted((r["q_id"], r["rank"], r["chunk_pos"], round(r["score"], 6)) for r in retrieve.retrieve(qs, ix, e, 5).collect())
    assert shown(delta.load(spark, path, e)) == shown(index.memory_index(frame(spark, live), e))


def test_what_fails_changes_nothing(spark, tmp_path):
    class Broken(index.HashingEmbedder):
        def embed_tokens(self, rows):
            raise RuntimeError("out of memory")

    e, path = index.HashingEmbedder(8), f"{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        delta.load(spark, path)
    rows = rows_of(range(5))
    delta.add(frame(spark, rows), e, path)
    with pytest.raises(Exception, match="out of memory"):
        delta.add(frame(spark, rows_of(range(3, 9), 2)), Broken(8), path)
    assert state(delta.load(spark, path, e)) == whole(spark, rows, e)
    with pytest.raises(ValueError):
        delta.add(frame(spark, rows), index.HashingEmbedder(16), path)
    with pytest.raises(ValueError):
        delta.load(spark, path, index.HashingEmbedder(16))


def test_nulls_and_nothing(spark, tmp_path):
    e, path = index.HashingEmbedder(8), f"{tmp_path}/i"
    rows = [(None, 1, "no document"), (2, 2, None), (3, 3, "ka")]
    delta.add(frame(spark, rows), e, path)
    delta.add(frame(spark, []), e, path)
    delta.withdraw(frame(spark, [(None, 0, ""), (3, 0, "")]), e, path)
    ix = delta.load(spark, path, e)
    assert sorted(r["chunk_pos"] for r in ix["chunks"].collect()) == [1, 2] and ix["stats"].first()["n"] == 2
    delta.withdraw(frame(spark, [(2, 0, "")]), e, path)
    assert sorted(r["term"] for r in delta.load(spark, path, e)["terms"].collect()) == ["document", "no"]
