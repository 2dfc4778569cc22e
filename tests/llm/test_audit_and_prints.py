"""Filter audits and document fingerprints against brute force."""

import hashlib
import os
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import filter_audit as fa
from passagelake.llm import prefix_prints as pp

DOCS = "doc_id long, text string, source string, n int, part string, mask string, digest string, is_first int"
LABELS = "doc_id long, quality int, toxic int, n int"


# --- audit --------------------------------------------------------------------------


@pytest.mark.parametrize("n", range(1, 7))
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in fa.neighbour_swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


@pytest.mark.parametrize("n", range(1, 6))
def test_walk_against_filtering_cell_by_cell(n):
    cells = np.random.default_rng(n).integers(0, 50, (3, 1 << n, 2))
    orders, removed, kept, shapley = fa.walk_orders(cells, n)
    total = np.zeros((3, n), np.int64)
    for k, order in enumerate(orders):
        alive = list(range(1 << n))
        for step, f in enumerate(order):
            out = [m for m in alive if m >> f & 1]
            alive = [m for m in alive if not m >> f & 1]
            assert (removed[:, k, step] == cells[:, out].sum(1)).all()
            assert (kept[:, k, step] == cells[:, alive, 0].sum(1)).all()
            total[:, f] += cells[:, out, 0].sum(1)
    assert (shapley == total).all()


def test_too_many_or_equal_filters(spark):
    cells = spark.createDataFrame([], "part string, mask int, n long")
    for names in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            fa.interactions(cells, names)


def brute_audit(docs, labels):
    """Apply the filters one after the other to lists of rows."""
    good = {d for d, q, *_ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, *_ in labels if t == 1 and d is not None}
    smallest = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))

    def fails(row, letter):
        doc_id, text = row[0], row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > smallest[text],
        }[letter]

    out, shapley = {}, {}
    for part in {r[2] or "" for r in docs}:
        rows = [r for r in docs if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            alive, gone = rows, []
            for step, letter in enumerate(order, 1):
                hit = [r for r in alive if fails(r, letter)]
                alive = [r for r in alive if not fails(r, letter)]
                alone = sum(fails(r, letter) and sum(fails(r, x) for x in "ABCDE") == 1 for r in rows)
                out[part, order, step] = [len(alive), len(hit), sum(fails(r, letter) for r in gone), alone, sum(r[0] in good for r in hit), sum(r[0] in toxic for r in hit)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(hit)
                gone = gone + hit
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_rows(seed=0):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "d#lta", "e", "Zeta", "漢字", "x&y"]
    texts = [None, "", " \t\n", "A", "a b\x0bc\x0cd\re", "no break"]
    texts += [" ".join(rnd.choice(words[: rnd.randint(1, 8)]) + rnd.choice(["", str(rnd.randint(0, 300))]) for _ in range(rnd.choice([3, 199, 200, 201, 400]))) for _ in range(20)]
    docs = [(rnd.choice([None, 5, *range(60)]), rnd.choice(texts), rnd.choice([None, "", "s1", "s2"])) for _ in range(120)]
    docs += [(7, "same row", "s1")] * 40  # repeated rows
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [None, None, 3, 3, *range(0, 80, 2)]]
    return docs, labels


def test_audit_against_brute_force(spark):
    docs, labels = audit_rows()
    got = fa.audit_documents(
        spark.createDataFrame([(*r, 1, "x", "y", "z", 0) for r in docs], DOCS),
        spark.createDataFrame([(*r, 9) for r in labels], LABELS),
    )
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert [tuple(r) for r in sorted(got.collect())] == brute_audit(docs, labels)


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert fa.audit_documents(spark.createDataFrame([], DOCS), none).count() == 0
    docs = [(1, "Ab " * 300, None)]
    got = fa.audit_documents(spark.createDataFrame([(*r, 1, "x", "y", "z", 0) for r in docs], DOCS), none)
    assert [tuple(r) for r in sorted(got.collect())] == brute_audit(docs, [])


def test_audit_against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs, labels = audit_rows(3)
    docs_df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("documents", docs_df), ("labels", labels_df)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = fa.op11_filter_audit(spark, str(tmp_path))
    want = con.execute(fa.OP11_SQL)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_one_part_with_most_rows(spark):
    """Cells of a part are counted before they meet: one row a mask reaches its task."""
    cells = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("part"), (F.col("id") % 8).cast("int").alias("mask"), F.lit(1).cast("long").alias("n"))
    got = fa.interactions(cells, "xyz")
    assert got.count() == 51 * 6 * 3
    first = got.where("part = 'hot' and filter_order = 'xyz' and step = 3").first()
    hot = [i % 8 for i in range(200_000) if i % 3]
    assert first["kept"] == hot.count(0) and first["removed"] == hot.count(4) and first["unique_fails"] == hot.count(4)


# --- fingerprints -------------------------------------------------------------------


def text_of(rnd, n, alphabet="abé漢😀 \n"):
    return "".join(rnd.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 2, 31, 64, 1000, 70_000])
def test_arrays_of_spliced_texts(n):
    rnd = random.Random(n)
    a, b = text_of(rnd, n), text_of(rnd, n // 3 + 2)
    x, y = pp.PrefixHashes.of(a), pp.PrefixHashes.of(b)
    for keep, take in ((n - n // 2, min(n // 2, len(b))), (0, len(b)), (n, 0)):
        made, want = x.spliced(keep, y, take), pp.PrefixHashes.of(a[:keep] + b[:take])
        assert made.fingerprint == want.fingerprint
        assert all((p == q).all() for p, q in zip(made.sums, want.sums))


def test_prefix_values_by_their_definition():
    x = pp.PrefixHashes.of("漢a😀")
    for base, prime, sums in zip(pp.BASES, pp.PRIMES, x.sums):
        assert sums.tolist() == [sum((ord(c) + 1) * base**k for k, c in enumerate("漢a😀"[:i])) % prime for i in range(4)]
    assert x.wide == sum((ord(c) + 1) * pp.WIDE_BASE**k for k, c in enumerate("漢a😀")) % 2**64


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_and_extensions():
    rnd = random.Random(2)
    a = text_of(rnd, 600, "ab")
    b = text_of(rnd, 100, "ab") + a[50:450] + text_of(rnd, 60, "ab")
    x, y = pp.PrefixHashes.of(a), pp.PrefixHashes.of(b)
    pairs = [(rnd.randrange(601), rnd.randrange(561)) for _ in range(200)] + [(50, 100), (450, 500), (0, 0), (600, 560)]
    for i, j in pairs:
        right, left = common(a[i:], b[j:]), common(a[:i][::-1], b[:j][::-1])
        assert x.extension(i, y, j) == right and x.extension(i, y, j, back=True) == left
        for length in (0, 1, 3, right, right + 1):
            if i + length <= len(a) and j + length <= len(b):
                assert x.same_span(i, y, j, length) == (a[i : i + length] == b[j : j + length])
    i, j = np.array(pairs).T
    assert x.extensions(i, y, j).tolist() == [common(a[p:], b[q:]) for p, q in pairs]
    assert x.extensions(i, y, j, back=True).tolist() == [common(a[:p][::-1], b[:q][::-1]) for p, q in pairs]


def test_a_false_equality_is_found(monkeypatch):
    """If hashes say that different spans are equal, the characters decide."""
    x, y = pp.PrefixHashes.of("abcdefgh"), pp.PrefixHashes.of("abcxefgh")
    monkeypatch.setattr(pp.PrefixHashes, "same_span", lambda *_: True)
    assert x.extension(0, y, 0) == 3 and x.extension(8, y, 8, back=True) == 4


def brute_anchors(text):
    base, prime = pp.BASES[0], pp.PRIMES[0]
    value = [sum((ord(c) + 1) * pow(base, k, prime) for k, c in enumerate(text[i : i + pp.WINDOW])) % prime for i in range(len(text) - pp.WINDOW + 1)]
    runs = [range(i, i + pp.SPAN) for i in range(len(value) - pp.SPAN + 1)] or ([range(len(value))] if value else [])
    return sorted({min((value[k], k) for k in run)[1] for run in runs})


def brute_likeness(a, b):
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    prefix = common(a, b)
    suffix = min(common(a[::-1], b[::-1]), min(n, m) - prefix)
    in_a, in_b = set(range(prefix)) | set(range(n - suffix, n)), set(range(prefix)) | set(range(m - suffix, m))
    w = pp.WINDOW
    mine = [i for i in brute_anchors(a) if prefix <= i <= n - suffix - w]
    theirs = [j for j in brute_anchors(b) if prefix <= j <= m - suffix - w]
    pairs = [(i, next((j for j in theirs if b[j : j + w] == a[i : i + w]), None)) for i in mine]
    pairs += [(next((i for i in mine if a[i : i + w] == b[j : j + w]), None), j) for j in theirs]
    for i, j in pairs:
        if i is not None and j is not None:
            right, left = common(a[i:], b[j:]), common(a[:i][::-1], b[:j][::-1])
            in_a |= set(range(i - left, i + right))
            in_b |= set(range(j - left, j + right))
    return (len(in_a) + len(in_b)) / (n + m)


def likeness_cases():
    rnd = random.Random(5)
    a = text_of(rnd, 700)
    yield from (("", ""), ("", a), (a, a), (a, a[:300]), (a, a[200:]), (a, a[::-1]), ("a" * 500, "a" * 400), ("ab" * 200, "ba" * 230))
    yield a, a[:100] + "X" + a[100:500] + "YY" + a[510:]  # edits
    yield a, a[400:] + a[:400]  # parts exchanged
    yield a, text_of(rnd, 90) + a[300:370] + text_of(rnd, 90)  # one span in the midst
    yield (a[:80] + "#") * 4, "!" + a[:80] + text_of(rnd, 80)  # a part repeated


@pytest.mark.parametrize("case", range(12))
def test_likeness_against_brute_force(case):
    a, b = list(likeness_cases())[case]
    x, y = pp.PrefixHashes.of(a), pp.PrefixHashes.of(b)
    got = pp.likeness(x, y)
    assert got == brute_likeness(a, b) == pp.likeness(y, x)
    assert pp.likeness(x, pp.PrefixHashes.of(a)) == 1.0


def test_every_long_common_span_is_found_whole():
    rnd = random.Random(8)
    for _ in range(20):
        span = text_of(rnd, pp.WINDOW + pp.SPAN - 1)
        a, b = text_of(rnd, 200) + "<" + span + ">" + text_of(rnd, 100), text_of(rnd, 300) + "[" + span + "]" + text_of(rnd, 200)
        assert pp.likeness(pp.PrefixHashes.of(a), pp.PrefixHashes.of(b)) >= 2 * len(span) / (len(a) + len(b))


def brute_prints(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest())
    rows = sorted(rows, key=key)
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints = [pp.PrefixHashes.of(x).fingerprint for x in (text, edited)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, brute_likeness(text, edited), brute_likeness(text, after)))
    return sorted(out, key=str)


def print_rows():
    rnd = random.Random(11)
    base = text_of(rnd, 400)
    rows = [(i, rnd.choice([text_of(rnd, rnd.randint(0, 300)), base, base[:150] + "!" + base[150:], None, "", "x"])) for i in rnd.sample(range(1000), 60)]
    return rows + [(None, "no id"), (None, None), (5000, "same"), (5000, "same"), (5000, "other"), (-3, base)]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_prints_against_brute_force(spark, partitions):
    rows = print_rows()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, part int, kind string, fingerprint string")
        got = pp.edited_prints(df)
        assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        assert sorted(map(tuple, got.collect()), key=str) == brute_prints(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_prints_of_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert pp.edited_prints(frame([])).count() == 0
    for rows in ([(3, "only row")], [(None, None)], [(1, "a" * 9), (2, "b" * 4)]):
        assert sorted(map(tuple, pp.edited_prints(frame(rows)).collect()), key=str) == brute_prints(rows)


def test_equal_texts_and_one_very_long(spark):
    rnd = random.Random(4)
    line = text_of(rnd, 5000)
    rows = [(1, line * 300), (2, line * 300), (3, "short"), (4, "short")]
    got = {r["doc_id"]: r for r in pp.edited_prints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"] == got[4]["fingerprint"]
    assert got[2]["near_next"] == got[4]["near_next"] == 1.0 and got[3]["near_next"] < 0.1
    plain = {r["doc_id"]: r["fingerprint"] for r in pp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_prints_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = pp.op12_prefix_prints(spark, "/root/testdata/sf0.001")
    shown = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in got.collect())
    rows.sort(reverse=True)
    want = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest(), pp.PrefixHashes.of(text).fingerprint))
    assert shown == sorted(want)
