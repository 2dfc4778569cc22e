"""HTML extraction, WARC, token counts, mixing, the pipeline."""

import base64
import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from passagelake.llm import html_extract, mixing, warc, wordpiece
from passagelake.llm.common import hub_join, open_folder, shared_dir

LONG = "The light of the river was on the stones and the people of the town walked by it in the morning. "


TEXT = (LONG * 2).strip()


# --- HTML ---------------------------------------------------------------------------


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (page("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title</h1><p>" + LONG * 3 + "<p>Sh.</article><footer>&copy; x</footer>"), "Title " + (LONG * 3).strip() + " Sh."),
        (page("<header>Site</header><div class='ad'>Buy</div><article><p>A&amp;B &lt;c&gt;<br>d\n\t e<b>f</b></p></article><aside>s</aside>"), "A&B <c> d ef"),
        (page("<article>one<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no</p> -->two</article>"), "onetwo"),
        (page("<article><p>Kept.</p><form>Mail <input> <button>Go</button></form><div class='comments'><p>" + LONG * 3 + "</p></div></article>"), "Kept."),
        (page("<article><p>Main " + LONG * 2 + "</p><article><p>A reply " + LONG + "</p></article></article>"), "Main " + (LONG * 2).strip()),
        (page("<main><p>In main.</p></main><p>out</p>"), "In main."),
        (page("<div id='cookie-notice'>We use cookies</div><p>" + LONG * 3 + "</p><p>short</p><ul><li><a href=a>link one</a></li><li><a href=b>link two</a></li></ul>"), (LONG * 3).strip() + " short"),
        (page("<article><p>" + LONG * 2 + "</p><p hidden>no</p><p style='display: none'>no</p></article>"), (LONG * 2).strip()),
        ("<p>unclosed <b>bold <p>next", "unclosed bold next"),
        # names inside other values, names with one furniture word, unquoted values
        ("<body class='single comments-open'><p>All of it.</p></body>", "All of it."),
        ("<article class='post comments-open'><p>All of it.</p></article>", "All of it."),
        ("<main id=menu><p>All of it.</p></main>", "All of it."),
        ('<p title="a hidden gem">Text</p>', "Text"),
        ("<section id='related-work'><p>Others</p></section><p class='search-results-intro'>Intro</p>", "Others Intro"),
        ("<article><p>One.</p></article><div class=ad-slot>no</div><article><p>Two is the larger.</p></article>", "One. Two is the larger."),
        ("<p title=it's>Yes</p>", "Yes"),
        ("<p title='a>b' data-x=\"</p>\">Yes</p>", "Yes"),
        ("<p>We sell<span class='ad'>Buy <span>now</span></span>things.</p>", "We sell things."),
        ("<article><p>Text.</p></article><article class=comment><p>Mine.</p></article><ol class='comment-list'><li>More</ol>", "Text."),
        ("<article><h2><a href=x>A linked heading</a></h2><ul><li><a href=y>a link</a></ul><p>Short.</p></article>", "A linked heading Short."),
        ("<div id=mainNav>no</div><div class='cookieBanner'>no</div><div class='has-sidebar'><p>Yes</p></div><div id='sidebar-2'>no</div>", "Yes"),
        ("<nav>never closed <main><p>Text</p></main>", "Text"),
        ("<article>AT&amp;T &ampx</article>", "AT&T &x"),
        ("<p>cut in a tag <b class='x", "cut in a tag"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        # a form around the page, furniture never closed, sections named after their topic
        (f"<form id='aspnetForm'><article><p>{TEXT}</p></article></form>", TEXT),
        (f"<form id=f1><div class=menu>Home</div><div><p>{TEXT}</p><p>Short one.</p></div></form>", TEXT + " Short one."),
        (f"<article><p>{TEXT}</p></article><form><p>{TEXT}</p></form>", TEXT),
        (f"<p>{TEXT}</p><form class=newsletter><p>{TEXT}</p></form>", TEXT),
        (f"<p>{TEXT}</p><form><p>Your name</p></form>", TEXT),
        (f"<nav><a href=x>Home</a><article><p>{TEXT}</p></article><footer>f</footer>", TEXT),
        (f"<nav><article><p>No {TEXT}</p></article></nav><p>{TEXT}</p>", TEXT),
        (f"<span class=ad>Buy<article><p>{TEXT}</p></article>", TEXT),
        (f"<ul class=comments><li><article><p>No {TEXT}</p></article></li></ul><div><p>{TEXT}</p></div>", TEXT),
        (f"<article><h1>H</h1><section class=login><p>{TEXT}</p></section><section class=related><a href=x>Other stories</a></section></article>", "H " + TEXT),
        (f"<article><p>{TEXT}</p><section class=notice-box><p>No {TEXT}</p></section></article>", TEXT),
        # the label of the one neighbour
        (f"<h1>Title</h1><p>{TEXT}</p><ul><li>First step.</li><li>Second</li></ul>", f"Title {TEXT} First step. Second"),
        (f"<p>{TEXT}</p><table><tr><td>Alpha</td><td>12</td></tr></table>", TEXT + " Alpha 12"),
        (f"<div>Home</div><p>{TEXT}</p><div>A short last line.</div><div>Imprint</div>", TEXT + " A short last line."),
        (f"<p>{TEXT}</p><div>© 2020 The Company of it</div>", TEXT),
        ("<div>Home</div><div>About</div><p>Hello there.</p>", "Hello there."),
    ],
)
def test_main_text(html, text):
    assert html_extract.extract_text(html) == text


def test_open_blocks_take_the_nearest_label():
    menu = "".join(f"<p><a href='{i}'>item number {i} of the menu</a></p>" for i in range(3))
    body = page(f"{menu}<p>near menu</p><p>x</p><p>y</p><p>near text</p><p>{LONG * 3}</p><p>last</p>")
    text = html_extract.extract_text(body)
    assert "near text" in text and text.endswith("last") and "near menu" not in text


WORDS = "river stone market letter window garden engine winter silver doctor yellow simple animal bridge summer corner".split()
STOPS = "the of and to in a is that for it was on are with as".split()
POLISH = "się nie jest że oraz przez został było ale dla tego który jako".split()


def sentences(rng, n, stops):
    return " ".join(rng.choice(stops if rng.random() < 0.45 and stops else WORDS) for _ in range(n)) + "."


def made_page(rng, stops):
    """(html, main text): no article, no main, furniture by class or by nothing but its
    links; short paragraphs and headings among the long ones."""
    links = lambda n: "".join(f"<li><a href='/{i}'>{sentences(rng, rng.randint(1, 4), [])}</a></li>" for i in range(n))
    blocks, truth = [], []
    for _ in range(rng.randint(3, 9)):
        tag = rng.choice(["p", "p", "p", "blockquote", "h2"])
        text = sentences(rng, rng.randint(3, 9) if tag == "h2" or rng.random() < 0.3 else rng.randint(30, 90), stops)
        blocks.append(f"<{tag}>{text}</{tag}>")
        truth.append(text)
        if rng.random() < 0.2:
            items = [sentences(rng, rng.randint(3, 12), stops) for _ in range(rng.randint(2, 5))]
            before, between, after = rng.choice([("<ul><li>", "</li><li>", "</li></ul>"), ("<table><tr><td>", "</td><td>", "</td></tr></table>"), ("<div>", "</div><div>", "</div>")])
            blocks.append(before + between.join(items) + after)
            truth += items
        if rng.random() < 0.15:
            blocks.append(f"<div class='{rng.choice(['ad', 'ad-slot', 'newsletter-signup', 'share-buttons'])}'>{sentences(rng, 12, stops)}</div>")
    menu = rng.choice([f"<div class='menu'><ul>{links(6)}</ul></div>", f"<ul>{links(6)}</ul>", f"<nav>{links(4)}</nav>"])
    tail = rng.choice([f"<div class='footer'>{sentences(rng, 20, stops)}</div>", f"<div>(c) {sentences(rng, 4, [])}</div>", f"<ul>{links(5)}</ul><div>{sentences(rng, 3, [])}</div>"])
    side = rng.choice(["", f"<div id='sidebar'><p>{sentences(rng, 40, stops)}</p></div>", f"<div><ul>{links(8)}</ul></div>"])
    body = menu + side + f"<div class='{rng.choice(['content', 'post-body', 'x1'])}'>" + "\n".join(blocks) + "</div>" + tail
    return page(f"<form id='aspnetForm'>{body}</form>" if rng.random() < 0.2 else body), " ".join(truth)


@pytest.mark.parametrize("stops", [STOPS, POLISH])
def test_pages_without_articles_by_densities(stops):
    """Word F1 against the known text, for a language with listed stop words and one
    without."""
    rng = random.Random(31)
    hit = got_words = true_words = 0
    for _ in range(300):
        html, truth = made_page(rng, stops)
        got = Counter(html_extract.extract_text(html).split())
        want = Counter(truth.split())
        hit, got_words, true_words = hit + (got & want).total(), got_words + got.total(), true_words + want.total()
    f1 = 2 * hit / (got_words + true_words)
    assert f1 >= 0.98


def test_a_very_long_page():
    text = " ".join(sentences(random.Random(k), 60, STOPS) for k in range(2000))
    assert html_extract.extract_text(f"<p class={'x' * 100_000}>{text}</p>" + "<div>" * 20_000) == text
    assert html_extract.extract_text("<" * 200_000 + "a='" * 50_000) is not None


def test_pages_table(spark):
    rows = [(1, "u", page("<article>é ü</article>")), (1, "u", page("<article>é ü</article>")), (None, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = sorted(map(tuple, html_extract.main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "é ü", 3)] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_extract.main_text(pages.limit(0)).count() == 0


# --- folders ------------------------------------------------------------------------


@pytest.mark.parametrize("scheme", ["s3", "s3a", "s3n"])
def test_names_of_object_stores(monkeypatch, scheme):
    class Named:
        class FileSystem:
            @staticmethod
            def from_uri(uri):
                return uri

    monkeypatch.setattr("passagelake.llm.common.fs", Named)
    assert open_folder(f"{scheme}://bucket/a/s3a") == "s3://bucket/a/s3a"


# --- WARC ---------------------------------------------------------------------------


def test_records_survive_any_chunking():
    records = [warc.make_record(i, f"http://a/{i}", b"x\r\n\r\ny" * i, "D" * 32, None if i % 3 else 7) for i in range(9)]
    stream = b"".join(records)
    for size in (1, 7, 64, 10_000):
        assert list(warc.read_records(stream[i : i + size] for i in range(0, len(stream), size))) == records
    with pytest.raises(ValueError):
        list(warc.read_records([stream[:-9]]))


@pytest.mark.parametrize("members", [1, 2, 5])
def test_inflate_reads_any_number_of_members(members):
    data = [random.Random(i).randbytes(5000) for i in range(members)]
    packed = b"".join(gzip.compress(d) for d in data)
    for size in (10, 1 << 20):
        assert b"".join(warc.inflate(io.BytesIO(packed), size)) == b"".join(data)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    rows = [(i, f"http://h/{i}\r\nX: 1", f"<p>é {i % 7}</p>" * 20) for i in range(60)] + [(70, None, None), (71, "u", ""), (None, "n", "<p>é 3</p>" * 20), (None, "n", "only"), (None, "n", "only"), (4, "r", "<p>é 4</p>" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as digest").repartition(3)
    base, target = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    manifest = warc.write_archives(pages, base)
    normal = warc.normalise_archives(manifest, base, target)
    got = warc.read_archives(normal, target).collect()
    lead = {}
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = min(lead.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = lead.get(h or "")
        revisit = to is not None and i != to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
    # whole files are one member, normalised ones one per record, at the indexed places
    for f in (tmp_path / "a").glob("part-*"):
        d = zlib.decompressobj(wbits=31)
        d.decompress(f.read_bytes())
        assert d.eof and not d.unused_data
    for r in got:
        data = (tmp_path / "b" / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    few = warc.with_revisits(pages, revisit_from=10_000).where("refers_to is not null").count()
    assert few == 0
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/c").count() == 0


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("words", [1, warc.WORDS])
def test_pages_without_copies_are_not_shuffled(spark, tmp_path, monkeypatch, words):
    monkeypatch.setattr(warc, "WORDS", words)
    texts = [random.Random(i).randbytes(2500).hex() for i in range(400)]
    texts += texts[:400:40] + texts[:3] + [None, "", None]
    rows = [(1000 - i, f"u{i}", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    pages, before = spark.read.parquet(f"{tmp_path}/pages"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        got = warc.with_revisits(pages).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = shuffled(spark) - before
    lead = {}
    for i, _, t in rows:
        lead[t or ""] = min(i, lead.get(t or "", i))
    assert {r["page_id"]: (r["url"], r["html"], r["refers_to"]) for r in got} == {i: (u, t or "", lead[t or ""] if lead[t or ""] != i else None) for i, u, t in rows}
    assert len(got) == len(rows)
    # of 400 texts of 5,000 characters twelve have copies; with one word most bits are set by chance
    assert words == 1 or sent < 400 * 1000


# --- token counts -------------------------------------------------------------------


def greedy(vocab, word):
    n = i = 0
    longest = max(map(len, vocab), default=1)
    while i < len(word):
        i = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in vocab), i + 1)
        n += 1
    return n


@pytest.mark.parametrize("seed", range(60))
def test_automaton_against_greedy(seed):
    rng = random.Random(seed)
    letters = b"abc" if seed % 2 else b"abcd"
    vocab = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
    if seed % 3 == 0:
        vocab |= {b"a", b"b", b"c"}
    automaton = wordpiece.Automaton(sorted(vocab))
    for _ in range(60):
        word = bytes(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert automaton.count(word) == greedy(vocab, word), (vocab, word)


def test_counts_of_a_table(spark, tmp_path):
    vocab = [b" ", b"a", b"b", b" ab", b"aba", "é".encode()]
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(v).decode()} {i}\n" for i, v in enumerate(vocab)))
    rows = [(1, "ab aba\tabé\x0bb"), (1, "ab aba\tabé\x0bb"), (2, None), (None, ""), (4, "zz " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_tokens")
    got = sorted(map(str, map(tuple, wordpiece.token_counts(docs, str(path)).collect())))
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(greedy(set(vocab), b" " + w) for w in words)))
    assert got == sorted(map(str, want))


def test_public_vocabulary():
    vocab = wordpiece.read_vocab()
    automaton, known = wordpiece.Automaton(vocab), set(vocab)
    for word in ("hello", "unbelievably", "éàü", "1234567890", "don't", "漢字", "x" * 500):
        assert automaton.count(b" " + word.encode()) == greedy(known, b" " + word.encode())


# --- mixing -------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    for _ in range(200):
        total = sum(w[s] for s in open_)
        if budget <= 1e-9 or not total:
            break
        for s in open_:
            target[s] += budget * w[s] / total
        budget = 0.0
        for s in list(open_):
            if target[s] > most * sizes[s]:
                budget += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "B", "é", None, "zz", "empty"][: 3 + 2 * seed]
    rows = [(i, rng.choice(names[:1] * 5 + names), "w " * rng.choice([0, 1, 3, 50])) for i in range(400)]
    rows += [(5000, "empty", None), (None, "a", "x y"), (7, "a", "dup dup"), (7, "a", "dup dup")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "9 as size", "'k' as key")
    got = mixing.mix_sources(docs, rows_per_range=20).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, target in want.items():
        assert (sizes[s], round(target, 6)) in by_target, s
    assert sum(sum(x) for x in by_target.values()) >= sum(int(x) for x in want.values()) - len(want)
    if len({(sizes[s], round(x, 6)) for s, x in want.items()}) == len(want):
        for s, target in want.items():
            assert sum(by_target[sizes[s], round(target, 6)]) == int(target + 1e-9)
    again = mixing.mix_sources(docs.repartition(7), rows_per_range=50).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, again)))


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(docs).count() == 0


# --- pipeline -----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    words = [f"{a}{b}{c}" for a in "b d f k l m".split() for b in "a e i o".split() for c in "n r s t".split()]

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" "] * 30 + ["  ", "\n", ". "]) for _ in range(n)).strip() + "."

    shared, item = prose(60), prose(40)
    rows = [(i, prose(rng.randint(40, 140)), "en", f"s{i % 3}") for i in range(90)]
    rows += [(100 + i, " ".join(w + "###" for w in prose(80).split()), "en", "s0") for i in range(40)]
    rows += [(200, rows[4][1], "en", "s1"), (201, rows[5][1].replace(" ", "  ", 1), "en", "s2")]
    rows += [(300, prose(50) + "\n" + shared, "en", "s0"), (301, prose(50) + "\n" + shared, "en", "s1")]
    rows += [(400, prose(30) + "\n" + item.upper() + " " + prose(5), "en", "s1"), (500, None, None, None), (501, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(char_length(text) as bigint) as n_chars", "1 as size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(90)] + [(100 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != names[-1]:
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    clean = set(range(90))
    assert not {i for i in kept[names[0]] if 100 <= i < 140} and clean | {200, 201, 300, 400} <= set(kept[names[0]])
    assert clean | {300, 301, 400} <= set(kept[names[1]]) and not {200, 201} & set(kept[names[1]])
    assert shared in kept[names[2]][300]["text"] and shared[:90] not in kept[names[2]][301]["text"]
    assert kept[names[2]][301]["n_chars"] == len(kept[names[2]][301]["text"])
    assert 400 not in kept[names[3]] and clean <= set(kept[names[3]])
    last = kept[names[4]]
    assert last and all(0 < r["taken"] <= 2 * r["size"] for r in last.values())
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(str, last))


CLASHING = "key range upto size target source_size taken pl_key pl_rank pl_bucket pl_score pl_keep bucket quality_score quality_keep own lead fp root many band".split()


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """Documents with columns of all helpers' names, repeated rows, null ids, nulls."""
    path = tmp_path_factory.mktemp("clashing")
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("the a river stone of walks under bright hills and towns with people in it".split()) for _ in range(n)) + "."
    rows = [(i, prose(60), "en", "s1") for i in range(12)]
    rows += [rows[0], rows[0], (None, prose(30), None, None), (None, None, None, None), (None, None, None, None), (7, prose(40), "en", "s2"), (30, "", "en", "s1"), (31, "word " * 30_000, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(char_length(text) as bigint) as n_chars", *[f"{k} as {c}" for k, c in enumerate(CLASHING)], "map('a', 1) as m", "array(named_struct('x', 1)) as nested")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no document has at all"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_other_columns_alone(spark, clashing, name):
    docs, path = clashing
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, path)
    rows = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    renamed = {c: f"docs_{c}" if last and c in mixing.RESULT else c for c in CLASHING}
    assert last or out.columns == docs.columns
    assert rows and all(r[renamed[c]] == k for r in rows for k, c in enumerate(CLASHING))
    assert all(r["m"] == {"a": 1} and r["nested"][0]["x"] == 1 for r in rows)
    ids = [r["doc_id"] for r in rows]
    if name == "simhash_near_dedup":
        # both texts of id 7 lead a group, repeated rows one row, one row without text
        assert ids.count(7) == 2 and ids.count(0) == 1 and sum(not r["text"] for r in rows) == 1
    elif last:
        assert ids.count(0) == 3 and all(r["taken"] <= 2 * r["size"] for r in rows)
    elif name in ("quality_classifier", "benchmark_decontamination"):
        assert len(rows) == docs.count()
    empty = stage(spark, docs.limit(0), path)
    assert empty.count() == 0 and empty.columns == out.columns


def test_hub_join(spark):
    """A key with most of the rows: the same rows as a plain join."""
    rows = spark.range(3000).selectExpr("if(id % 3 > 0, 0, id) as k", "id as x")
    lookup = rows.groupBy("k").count().selectExpr("k", "k * 2 as y", "count as many").where("k <> 9")
    got = hub_join(rows, lookup, "k", 3000)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(lookup.drop("many"), "k").collect()))


def test_shared_folder_only_on_local_masters(spark, monkeypatch):
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        shared_dir(Session)
