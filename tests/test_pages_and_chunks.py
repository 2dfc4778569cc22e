"""HTML, chunks, the wiki source, files."""

import datetime
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagelake.config import Config, from_environment
from passagelake.functions import chunk, html, lang
from passagelake.operators import index
from passagelake.sources import files, wiki

ROOT = '<div class="x mw-parser-output">{}</div><p>outside</p>'


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("plain", "plain"), ("<div>a<span>b</span></div>", "a\nb"), (ROOT.format("<p> A<br/>b </p><p></p><h2>C</h2>"), "A\nb\n\nC"),
        (ROOT.format("<table><tr><td><p>no</p></td></tr></table><p>yes<sup class='reference'>1</sup></p>"), "yes"),
        (ROOT.format("<ul><li>one <p>inner</p></li><li>two</li></ul>"), "one inner\n\ntwo"),
        (ROOT.format("<div id='toc'><p>no</p></div><ol class='references'><li>no</li></ol><ol><li>yes</li></ol>"), "yes"),
        (ROOT.format("<p>first <b>x<p>second &amp; third"), "first xsecond & thirdoutside"), (ROOT.format("<!-- <p>no</p> --><p>yes</p>"), "yes"),
    ],
)
def test_html_to_text(page, want):
    if "first" in (page or ""):
        assert html.html_to_text(page).startswith("first xsecond & third")
    else:
        assert html.html_to_text(page) == want


@given(st.text(alphabet="ab \n।?!é", max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_chunks_are_exact_and_fit(body, size, part):
    overlap = size * part // 5
    found = chunk.split_text(body, size, overlap)
    for start, piece in found:
        assert piece and piece == piece.strip() and len(piece) <= size
        assert body[start : start + len(piece)] == piece
    assert "".join("".join(p for _, p in found).split()) or not body.strip()
    if overlap == 0:
        assert "".join("".join(p.split()) for _, p in found) == "".join(body.split())


def test_chunk_cases():
    assert chunk.split_text(None, 10, 2) == [] and chunk.split_text(" \n ", 10, 2) == []
    assert chunk.split_text("short", 10, 2) == [(0, "short")]
    assert [p for _, p in chunk.split_text("abcdefghij" * 2, 8, 2)] == ["abcdefgh", "ghijabcd", "cdefghij"]
    assert [p for _, p in chunk.split_text("one। two। three।", 10, 0)] == ["one। two।", "three।"]
    assert [p for _, p in chunk.split_text("aa bb cc dd", 6, 3)] == ["aa bb", "bb cc", "cc dd"]
    with pytest.raises(ValueError):
        chunk.split_text("x", 5, 5)
    starts = chunk.searched_starts("ab ab ab", ["ab", "ab", "ab"], 0)
    assert starts == [0, 3, 6]


def chapters(spark):
    rng = random.Random(1)
    body = lambda n: "\n".join(" ".join(rng.choice("ka lo mi su".split()) for _ in range(9)) for _ in range(n))
    rows = [("B", "A", f"B/{c}", c, n, f"http://x/{c}", body(k)) for c, n, k in (("two", 2, 6), ("one", 1, 3), ("extra", None, 2), ("zero", 0, 1))]
    return spark.createDataFrame(rows, "book string, author string, title string, chapter string, chapter_no int, url string, text string")


def test_chunk_metadata_and_positions(spark):
    got = index.with_positions(index.split_chapters(chapters(spark), 80, 20)).orderBy("chunk_pos").collect()
    assert [r["chunk_pos"] for r in got] == list(range(1, len(got) + 1))
    assert list(dict.fromkeys(r["chapter"] for r in got)) == ["one", "two", "extra", "zero"]
    for r in got:
        assert 1 <= r["chunk_index"] <= r["chunks_in_chapter"]
        assert r["section"] == f"{r['chapter']} — {lang.LABEL_PART} {r['chunk_index']}/{r['chunks_in_chapter']}"
        assert r["chunk_id"] == f"ch{r['chapter_no'] or 0:02d}-{r['chunk_index']:03d}"


def test_files(spark, tmp_path):
    ch = chapters(spark)
    files.write_chapters(ch, f"{tmp_path}/ch")
    assert sorted(map(str, files.read_chapters(spark, f"{tmp_path}/ch").collect())) == sorted(map(str, ch.collect()))
    parts = index.split_chapters(ch, 80, 20)
    files.write_chunks(parts, f"{tmp_path}/parts")
    assert files.read_chunks(spark, f"{tmp_path}/parts").count() == parts.count()
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"id": 1, "question": "x", "answerable": True, "evidence_keywords": ["য়"]}, {"id": 2, "question": "y", "answerable": False}]), encoding="utf-8")
    rows = files.read_questions(spark, str(q)).orderBy("q_id").collect()
    assert rows[0]["evidence_keywords"] == ["য়"] and rows[1]["expected_source"] == []
    files.write_questions(files.read_questions(spark, str(q)), str(tmp_path / "q2.json"))
    assert [r["id"] for r in json.loads((tmp_path / "q2.json").read_text(encoding="utf-8"))] == [1, 2]
    at = datetime.datetime(2024, 1, 1)
    pages = spark.createDataFrame([("T", "t", "old", at), ("T", "t", "new", at.replace(day=2))], "title string, requested_title string, html string, fetched_at timestamp")
    files.append_pages(pages, f"{tmp_path}/pages")
    assert files.latest_pages(files.read_pages(spark, f"{tmp_path}/pages")).first()["html"] == "new"


# --- wiki ---------------------------------------------------------------------------


class Fake:
    """Answers in order; an exception is raised, a number is a status."""

    def __init__(self, *answers):
        self.answers, self.urls = list(answers), []

    def __call__(self, url, timeout):
        self.urls.append(url)
        a = self.answers.pop(0)
        if isinstance(a, BaseException):
            raise a
        if isinstance(a, tuple):
            return a
        return 200, {}, json.dumps(a).encode()


def client(*answers, **more):
    pauses, fake = [], Fake(*answers)
    c = wiki.WikiClient("http://api", transport=fake, sleep=pauses.append, clock=lambda: 0.0, seed=1, **more)
    return c, fake, pauses


def test_retries_and_pauses():
    c, fake, pauses = client(OSError("net"), (503, {"Retry-After": "7"}, b""), {"error": {"code": "maxlag"}}, {"ok": 1}, min_delay=2)
    assert c.get(action="x") == {"ok": 1} and len(fake.urls) == 4
    assert "maxlag=5" in fake.urls[0] and "formatversion=2" in fake.urls[0]
    waits = [p for p in pauses if p > 2.5]
    assert 5 <= waits[0] <= 6.5 and waits[1] == 8 and 20 <= waits[2] <= 21.5
    with pytest.raises(wiki.ApiError):
        client({"error": {"code": "nosuch"}})[0].get()
    with pytest.raises(wiki.ApiError):
        client((404, {}, b""))[0].get()
    with pytest.raises(wiki.ApiError):
        client(*[(500, {}, b"")] * 3, max_retries=3)[0].get()


def test_titles_over_pages():
    c, _, _ = client({"query": {"allpages": [{"title": "B/1"}]}, "continue": {"apcontinue": "x"}}, {"query": {"allpages": [{"title": "B/2"}]}})
    assert list(c.titles_with_prefix("B/")) == ["B/1", "B/2"]


def test_contents_and_extras(spark):
    page = '<a href="/a" title="B/one">1</a><a href="/b" title="B/two" class="x new">2</a><a title="B/three">3</a><a href="/c" title="C/x">4</a><a href="/a" title="B/one">5</a><a href="/d" title="B/আট_২">6</a>'
    toc = wiki.toc_titles(page, "B")
    assert toc == ["B/one", "B/আট ২"]
    pages = spark.createDataFrame([(page,)], "html string")
    assert sorted(r["title"] for r in wiki.page_titles(pages, "B/").collect()) == sorted(toc)
    found = spark.createDataFrame([(t,) for t in ("B/one", "B/10", "B/2", "B/none", "B/0")], "title string")
    first = spark.createDataFrame(list(enumerate(toc)), "pos long, title string")
    got = [r["title"] for r in wiki.with_extras(first, found).orderBy("src", "pos").collect()]
    assert got == [*toc, "B/2", "B/10", "B/0", "B/none"]
    have = spark.createDataFrame([("B/one",)], "requested_title string")
    assert sorted(r["title"] for r in wiki.missing_titles(found, have).collect()) == ["B/0", "B/10", "B/2", "B/none"]
    assert wiki.missing_titles(found, have, refresh=True).count() == 5


def test_chapters_of_pages(spark):
    body = ROOT.format("<p>Book</p><p>প্রথম পরিচ্ছেদ</p><p>" + "text " * 20 + "</p><p>12</p>")
    rows = [("Book/প্রথম পরিচ্ছেদ", body), ("Book/short", "<p>tiny</p>")]
    got = wiki.chapters_of(spark.createDataFrame(rows, "title string, html string"), "Book", "Author", "https://h").collect()
    assert len(got) == 1
    r = got[0]
    assert r["chapter_no"] == 1 and r["text"] == ("text " * 20).strip() and r["url"].startswith("https://h/wiki/Book/")


def test_data_source(spark, monkeypatch):
    reader = wiki._WikiReader({"api": "http://api", "titles": "a\n\nb", "min_delay": "0", "transport": "fake"})
    page = lambda t: {"parse": {"title": t.upper(), "text": f"<p>{t}</p>"}}
    monkeypatch.setitem(wiki._TRANSPORTS, "fake", Fake(page("a"), page("b")))
    monkeypatch.setattr(wiki.time, "sleep", lambda s: None)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[:3] for r in rows] == [("A", "a", "<p>a</p>"), ("B", "b", "<p>b</p>")]
    spark.dataSource.register(wiki.WikiPages)
    assert spark.read.format("wikipages").options(api="http://api", titles="").load().count() == 0


def test_config(monkeypatch):
    monkeypatch.setenv("CHUNK_SIZE", "  ")
    monkeypatch.setenv("TOP_K", "7")
    monkeypatch.setenv("STRICT_COMPAT", "true")
    c = from_environment()
    assert (c.chunk_size, c.top_k, c.strict_compat) == (800, 7, True) and Config().top_k == 5
