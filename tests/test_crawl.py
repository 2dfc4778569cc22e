"""A crawl that is cut off goes on: nothing is asked for twice."""

import fake_wiki
import pytest

from passagelake.config import Config
from passagelake.plans import build
from passagelake.sources import crawl, files, wiki

PAGES = {f"B/{i:02}": f"<p>page {i} {'text ' * 20}</p>" for i in range(10)} | {"C/1": "<p>other book</p>"}
FAKE = "fake_wiki:transport"


def conf(api):
    return Config(wiki_api=api, min_delay=0.01, max_retries=1)


def test_titles_go_on_with_the_token(spark, tmp_path):
    api = fake_wiki.set_up(tmp_path / "wiki", PAGES, per_list=3, dies_after=2)
    run = lambda: crawl.crawl_titles(spark, "B/", f"{tmp_path}/titles", f"{tmp_path}/checkpoint", conf(api), FAKE)
    with pytest.raises(Exception, match="no route"):
        run()
    assert fake_wiki.calls(tmp_path / "wiki") == ["list 0", "list 3"]
    (tmp_path / "wiki" / "alive").touch()
    for _ in range(2):  # the second run asks for nothing
        got = {r["title"]: r["position"] for r in run().collect()}
        assert got == {f"B/{i:02}": i for i in range(10)}
    assert fake_wiki.calls(tmp_path / "wiki") == ["list 0", "list 3", "list 6", "list 9"]


def test_titles_of_an_empty_list(spark, tmp_path):
    api = fake_wiki.set_up(tmp_path / "wiki", {}, per_list=3)
    assert crawl.crawl_titles(spark, "B/", f"{tmp_path}/titles", f"{tmp_path}/checkpoint", conf(api), FAKE).count() == 0


@pytest.mark.parametrize("lanes,per_task,dies_after", [(1, 1, 4), (1, 3, 5), (3, 2, 7), (2, 50, 6)])
def test_pages_are_fetched_once(spark, tmp_path, lanes, per_task, dies_after):
    folder, cache = tmp_path / "wiki", f"{tmp_path}/cache"
    api = fake_wiki.set_up(folder, PAGES, dies_after=dies_after)
    wanted = spark.createDataFrame([(t,) for t in PAGES for _ in range(2)], "title string")
    run = lambda: crawl.crawl_pages(spark, wanted, cache, conf(api), lanes, per_task, FAKE)
    with pytest.raises(wiki.NoAnswer, match="no route"):
        run()
    saved = files.read_pages(spark, cache).count() if files.exists(spark, cache) else 0
    assert saved == len(fake_wiki.calls(folder)) >= min(dies_after, len(PAGES)) - lanes  # all that came was kept
    (folder / "alive").touch()
    assert run().count() == 0 and run().count() == 0
    assert fake_wiki.calls(folder) == sorted(f"page {t}" for t in PAGES)
    got = {r["requested_title"]: r["html"] for r in files.read_pages(spark, cache).collect()}
    assert got == PAGES and files.read_pages(spark, cache).count() == len(PAGES)


def test_refused_pages_do_not_stop_the_others(spark, tmp_path):
    folder, cache = tmp_path / "wiki", f"{tmp_path}/cache"
    api = fake_wiki.set_up(folder, PAGES, refuses=["B/03"])
    wanted = spark.createDataFrame([(t,) for t in PAGES], "title string")
    refused = crawl.crawl_pages(spark, wanted, cache, conf(api), 2, 4, FAKE).collect()
    assert [r["requested_title"] for r in refused] == ["B/03"] and "missingtitle" in refused[0]["error"]
    assert files.read_pages(spark, cache).count() == len(PAGES) - 1
    # a refresh asks for all again; the cache keeps both, the last one counts
    crawl.crawl_pages(spark, wanted.where("title = 'B/01'"), cache, conf(api), transport=FAKE, refresh=True)
    assert files.read_pages(spark, cache).count() == len(PAGES) and files.latest_pages(files.read_pages(spark, cache)).count() == len(PAGES) - 1


def test_a_book(spark, tmp_path):
    """Contents page, list, pages, chapters; a second run only reads the contents page."""
    folder = tmp_path / "wiki"
    contents = '<a href="/a" title="B/03">x</a><a href="/b" title="B/01">y</a>'
    api = fake_wiki.set_up(folder, PAGES | {"B": contents})
    for _ in range(2):
        pages = build.fetch_book(spark, "B", f"{tmp_path}/cache", conf(api), transport=FAKE, lanes=2)
        assert [r["requested_title"] for r in pages.orderBy("src", "pos").collect()][:3] == ["B/03", "B/01", "B/02"]
        assert wiki.chapters_of(pages, "B", "", "https://h").count() == 10
    assert len([c for c in fake_wiki.calls(folder) if c.startswith("page B/")]) == 10
