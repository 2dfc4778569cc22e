"""Quality trees, perplexity rules and toxicity."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from passagelake.llm import charlm, perplexity, quality, toxicity

WORDS = "the of and river stone light under winter garden people walking slowly into morning house along water bright window quiet".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def noise(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["&&&", "###", "$$$"]) for _ in range(n))


# --- trees --------------------------------------------------------------------------


def test_flat_trees_equal_a_walk_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    trees = quality.train_trees(x, y, n_trees=12, depth=3)

    def by_hand(row):
        total = trees.base
        for at in trees.roots.tolist():
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert np.allclose(trees.margin(x), [by_hand(r) for r in x])
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_training_is_deterministic_and_bears_no_rows_or_one_class():
    x = np.random.default_rng(1).normal(size=(50, len(quality.FEATURES)))
    y = np.r_[np.zeros(25), np.ones(25)]
    assert np.array_equal(quality.train_trees(x, y, 5).score(x), quality.train_trees(x, y, 5).score(x))
    empty = quality.train_trees(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert empty.score(x).tolist() == [0.5] * 50
    assert (quality.train_trees(x, np.ones(50), 3).score(x) > 0.9).all()


@pytest.mark.parametrize("text", [b"", b" \n\t", b"a", "é".encode(), b"x" * 300_000, b"a a a a\n" * 50])
def test_statistics_of_odd_texts(text):
    row = quality.document_statistics(text)
    assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def _documents(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 60) if i % 4 else noise(rng, 60)) for i in range(240)]
    rows += [(None, prose(rng, 30)), (900, None), (901, ""), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", i) for i, t in rows], "doc_id long, text string, lang string, source string, quality_score long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_classify_separates_held_out_documents(spark):
    docs, labels = _documents(spark)
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "source", "quality_score", "quality_keep"]
    rows = got.collect()
    assert len(rows) == docs.count()
    known = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 240]
    assert all(r["quality_keep"] == (r["doc_id"] % 4 > 0) for r in known)
    assert all(0 <= r["quality_score"] <= 1 for r in rows)


def test_classify_without_labels_or_rows(spark):
    docs, labels = _documents(spark)
    assert {r["quality_score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# --- perplexity ---------------------------------------------------------------------


def brute_repeated(words, k=5):
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + k))
    return len(covered)


@pytest.mark.parametrize("seed", range(30))
def test_repeated_words_against_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice("abc" if seed % 2 else "abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(0, 60))]
    assert perplexity.repeated_words(words) == brute_repeated(words)


def test_repeated_words_with_a_large_vocabulary():
    words = [str(i) for i in range(20_000)]
    assert perplexity.repeated_words(words + words[:7]) == 14


def test_base_counts():
    n, chars, symbols, dups, repeats, spoken = perplexity.base_counts("a b#\x0bé x\n\na b#\x0bé x\n \n| |")
    assert (n, chars, symbols, dups) == (8, 14, 4, 1)
    assert spoken == 6 and repeats == 0


def symbols_of(text):
    out = []
    for c in map(ord, text):
        out += [c] if c < charlm.DIRECT else [charlm.DIRECT + (c - charlm.DIRECT) // 4096, (c - charlm.DIRECT) % 4096]
    return out


def test_symbols_tell_all_characters_apart():
    points = np.array([0, 1, 97, charlm.DIRECT - 1, charlm.DIRECT, charlm.DIRECT + 1, 0x3042, 0x4E00, 0x4E01, 0xAC00, 0x1F600, 0x10FFFF], np.uint32)
    got = charlm.symbols(points).tolist()
    assert got == symbols_of("".join(map(chr, points))) and max(got) < charlm.SYMBOLS
    assert len({tuple(symbols_of(chr(c))) for c in range(0x110000)}) == 0x110000


def brute_kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney over plain dictionaries."""
    from collections import Counter, defaultdict

    counts = Counter()
    for t in texts:
        s = [0] * (order - 1) + symbols_of(t)
        for i in range(order - 1, len(s)):
            counts[tuple(s[i - order + 1 : i + 1])] += 1
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discounts = {}
    for k, table in tables.items():
        n = Counter(table.values())
        if not n[1] or not n[2]:
            discounts[k] = [0.5, 0.75, 0.9]
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.0]
        discounts[k] = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
    totals = {k: Counter() for k in tables}
    mass = {k: defaultdict(float) for k in tables}
    for k, table in tables.items():
        for g, c in table.items():
            totals[k][g[:-1]] += c
            mass[k][g[:-1]] += discounts[k][min(c, 3) - 1]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / charlm.SYMBOLS
        total = totals[k][g[:-1]]
        if not total:
            return low
        c = tables[k][g]
        return max(c - (discounts[k][min(c, 3) - 1] if c else 0), 0) / total + mass[k][g[:-1]] / total * low

    return p


def test_model_against_brute_force(spark):
    texts = ["abracadabra", "abra abra", "cabbage", "a", "", "bad cab", "日本語の日本", "本日は…ok", "한국 😀😀"]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    model = charlm.kneser_ney(charlm.count_ngrams(docs).cache())
    p = brute_kneser_ney(texts, charlm.ORDER)
    for t in ["abra", "cab", "xyz", "dab abra", "", "日本", "語本", "an 😀 한日"]:
        keys, _ = charlm.packed([t])
        got = model.log2_probs(keys)
        s = [0] * 4 + symbols_of(t)
        want = [np.log2(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))]
        assert np.allclose(got, want, atol=1e-5), t
        assert np.allclose(got, [model.log2_prob(k) for k in keys.tolist()], atol=1e-6), t
    assert np.allclose(model.text_bits(["abra", "", "cab"])[1], 0)


def test_model_takes_no_other_ngram_for_an_unseen_one(spark):
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzäöüß"
    texts = ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(20)]
    model = charlm.kneser_ney(charlm.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string")).cache())
    p = brute_kneser_ney(texts, charlm.ORDER)
    seen = np.unique(charlm.packed(texts)[0])
    asked = "".join(rng.choice(letters) for _ in range(400_000))
    keys = charlm.packed([asked])[0]
    slot = lambda k: k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)
    at = np.flatnonzero(np.isin(slot(keys), slot(seen)) & ~np.isin(keys, seen))
    at = at[at >= 4][:300]
    assert len(at) == 300
    ask = lambda k: [np.log2(p(tuple(ord(c) for c in k[i - 4 : i + 1]))) for i in at]
    assert np.allclose(model.log2_probs(keys[at]), ask(asked), atol=1e-4)
    # and of those that were counted each has its own probability
    s = "\0" * 4 + texts[0]
    assert np.allclose(model.log2_probs(charlm.packed(texts[:1])[0]), [np.log2(p(tuple(map(ord, s[i - 4 : i + 1])))) for i in range(4, len(s))], atol=1e-4)


def test_packed_keeps_texts_apart():
    keys, lengths = charlm.packed(["ab", "", "c"])
    assert lengths.tolist() == [2, 0, 1]
    assert keys.tolist() == [ord("a"), ord("a") << 12 | ord("b"), ord("c")]
    assert charlm.packed([])[0].tolist() == []


def test_blocks_hold_the_same_keys():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é日😀") for _ in range(n)) for n in (0, 5, 300, 3, 90, 0, 1)]
    want, lengths = charlm.packed(texts)
    for most in (1, 4, 50, 10_000):
        blocks = list(charlm.key_blocks(texts, most=most))
        assert np.concatenate([k for k, _ in blocks]).tolist() == want.tolist() or most < 300
        owners = np.concatenate([o for _, o in blocks])
        keys = np.concatenate([k for k, _ in blocks])
        order = np.argsort(owners, kind="stable")
        assert keys[order].tolist() == want.tolist() and np.bincount(owners, minlength=7).tolist() == lengths.tolist()


def test_base_columns_against_sql(spark):
    """The five base counts as SQL has them."""
    rng = random.Random(12)
    texts = [None, "", " \n ", "a", "a b c d e a b c d e"] + ["".join(rng.choice(["a", "b#", "\n", " ", "\t", "é|", "日", "\n\n", "x y z v w "]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    want = con.execute(r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(5) AS x(o) GROUP BY doc_id)
        SELECT len(w), length(array_to_string(w, '')), length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), coalesce(dup.n, 0), coalesce(c.n, 0)
        FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) ORDER BY doc_id""").fetchall()
    assert [perplexity.base_counts(t or "")[:5] for t in texts] == want


def test_rules_keep_prose_and_reject_noise(spark):
    docs, _ = _documents(spark)
    rows = {(r["doc_id"], r["kept"], r["base_failed"]) for r in perplexity.apply_rules(docs).collect()}
    kept = {i for i, k, _ in rows if k}
    prose_ids = {i for i in range(240) if i % 4}
    assert len(kept & prose_ids) > 0.95 * len(prose_ids)
    assert not kept & {i for i in range(240) if i % 4 == 0}
    assert (900, False, True) in rows and (901, False, True) in rows
    assert perplexity.apply_rules(docs.limit(0)).count() == 0


# --- toxicity -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = prose(rng, 50).split()
        if i % 5 == 0:
            words.insert(rng.randrange(50), rng.choice(["dimwit", "nitwit", "scoundrel"]))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model, lexicon = toxicity.train(docs, labels)
    return toxicity.Scorer(model.value, lexicon.value), docs, labels


@pytest.mark.parametrize(
    "written, restored",
    [
        ("d1mw1t", "dimwit"), ("D1MW1T!", "dimwit!"), ("dimmmmwit", "dimwit"), ("d i m w i t", "dimwit"), ("n.i.t.w.i.t", "nitwit"), ("sc0undr3l,", "scoundrel,"), ("$coundrel", "scoundrel"),
        ("walking slowly", "walking slowly"), ("room 101", "room 101"), ("", ""),
    ],
)
def test_restored_texts(scorer, written, restored):
    assert scorer[0].restore(written) == restored


def test_scores_of_restored_texts(scorer):
    s = scorer[0]
    for bad in ("you nitwit", "you n1tw1t", "a diimwit", "s c o u n d r e l"):
        assert s.score(s.restore(bad)) > 0.5, bad
    for good in ("walking slowly into the garden", "", "room 101", "a b c d e"):
        assert s.score(s.restore(good)) < 0.5, good


def test_viterbi_equals_all_paths(scorer):
    import itertools

    decoder = scorer[0].restore.decoder
    rng = random.Random(4)
    lattices = [toxicity.lattice_of(u) for u in ("d1m", "w1t", "n!tt", "s0", "$1|00", "9+6*5", "1|1|")] + [toxicity.lattice_of("n i t w", spaced=True)]
    lattices += [[[("".join(rng.choice("nitwd 0日") for _ in range(rng.randint(0, 2))), rng.choice([0.0, 0.5, 1.5])) for _ in range(rng.randint(1, 3))] for _ in range(7)] for _ in range(12)]
    for lattice in lattices:

        def cost(path):
            at, total = ord(" "), sum(b for _, b in path)
            for ch in "".join(t for t, _ in path) + " ":
                for symbol in symbols_of("0" if ch.isdigit() else ch):
                    total += decoder._bits(at, symbol)
                    at = (at << 12 | symbol) & ((1 << 48) - 1)
            return round(total, 6)

        paths = list(itertools.product(*lattice))
        least = min(map(cost, paths))
        assert decoder.best(lattice) in {"".join(t for t, _ in p).strip() for p in paths if cost(p) <= least + 1e-5}


def test_long_tokens_and_look_alikes_alone(scorer):
    """Tokens of any length are decoded, and those without any letter."""
    assert toxicity.suspicious("sh1t" * 11) and toxicity.suspicious("$0|") and not toxicity.suspicious("101")
    s = scorer[0]
    assert s.score(s.restore("n1tw1" + "t" * 80)) > 0.5
    assert s.score(s.restore("n1tw1t.n1tw1t.n1tw1t.n1tw1t.n1tw1t.n1tw1t.n1tw1t")) >= s.lexicon.base
    assert len(s.restore("a1b2" * 5000 + " end")) > 10_000


def test_scores_held_out_rows_and_odd_rows(spark, scorer):
    _, docs, labels = scorer
    more = docs.unionByName(spark.createDataFrame([(None, "nitwit"), (1000, None), (1001, ""), (1001, "")], "doc_id long, text string"))
    rows = toxicity.score_toxicity(more, labels).collect()
    assert len(rows) == 404
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400)
    assert right >= 396
    assert all(r["score"] < 0.5 for r in rows if r["doc_id"] in (1000, 1001))
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.4}
