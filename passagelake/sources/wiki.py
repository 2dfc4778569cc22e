"""Pages of a wiki through its API, as a Spark data source.

``spark.dataSource.register(WikiPages)``, then ``spark.read.format("wikipages")``
with options ``api``, ``titles`` (one per line) or ``prefix``. One partition, so that
one client keeps the pauses between requests.
"""

from __future__ import annotations

import datetime
import json
import random
import time
import unicodedata
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Config
from ..functions import html, text
from ..schema import RAW_PAGES
from . import files

RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_CODES = ("maxlag", "ratelimited")
TIMEOUT = 45.0
LONGEST_PAUSE = 90.0

#: (status, headers, body) of a GET request.
Transport = Callable[[str, float], tuple[int, dict, bytes]]


class ApiError(RuntimeError):
    """The API refused a request, or retries ran out."""


class NoAnswer(ApiError):
    """Retries ran out without an answer."""


def http_get(url: str, timeout: float) -> tuple[int, dict, bytes]:
    request = urllib.request.Request(url, headers={"User-Agent": "passagelake/0.1"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def pause_before_retry(attempt: int, retry_after: str | None, rng: random.Random) -> float:
    """Seconds to wait after a failed attempt (from 1): what the server says plus one,
    else doubling from 5, 90 at most, with some jitter."""
    if retry_after and retry_after.strip().isdigit():
        return int(retry_after) + 1.0
    return min(LONGEST_PAUSE, 5.0 * 2 ** (attempt - 1)) + rng.uniform(0, 1.5)


class WikiClient:
    """Paced and persistent JSON requests. Transport, clock, sleep and randomness can
    be replaced."""

    def __init__(self, api: str, min_delay: float = 2.0, max_retries: int = 6, transport: Transport = http_get, sleep=time.sleep, clock=time.monotonic, seed: int | None = None):
        self.api, self.min_delay, self.max_retries = api, min_delay, max_retries
        self.transport, self.sleep, self.clock, self.rng = transport, sleep, clock, random.Random(seed)
        self._last: float | None = None
        #: Waits for the moment of the next request, in place of the pause since the last.
        self.wait: Callable[[], None] | None = None

    def _pace(self) -> None:
        if self.wait is not None:
            self.wait()
            return
        if self._last is not None:
            wait = self.min_delay - (self.clock() - self._last)
            wait += self.rng.uniform(0, 0.5)
            if wait > 0:
                self.sleep(wait)
        self._last = self.clock()

    def get(self, **params) -> dict:
        """One answer. Network errors, RETRY_STATUS and RETRY_CODES are tried again;
        other errors of the API raise."""
        query = {"format": "json", "formatversion": "2", "maxlag": "5", **{k: str(v) for k, v in params.items()}}
        url = f"{self.api}?{urllib.parse.urlencode(query)}"
        trouble = ""
        for attempt in range(1, self.max_retries + 1):
            self._pace()
            after = None
            try:
                status, headers, body = self.transport(url, TIMEOUT)
            except (OSError, TimeoutError) as e:
                trouble = repr(e)
            else:
                after = {k.lower(): v for k, v in headers.items()}.get("retry-after")
                if status in RETRY_STATUS:
                    trouble = f"status {status}"
                elif status >= 400:
                    raise ApiError(f"status {status}")
                else:
                    data = json.loads(body)
                    error = data.get("error")
                    if not error:
                        return data
                    if error.get("code") not in RETRY_CODES:
                        raise ApiError(f"{error.get('code')}: {error.get('info', '')}")
                    trouble = error["code"]
            if attempt < self.max_retries:
                self.sleep(pause_before_retry(attempt, after, self.rng))
        raise NoAnswer(f"no answer after {self.max_retries} attempts: {trouble}")

    def titles_with_prefix(self, prefix: str) -> Iterator[str]:
        """All titles of the main namespace that begin with a prefix."""
        more: dict = {}
        while True:
            data = self.get(action="query", list="allpages", apprefix=prefix, apnamespace=0, aplimit="max", **more)
            yield from (p["title"] for p in data.get("query", {}).get("allpages", []))
            more = data.get("continue") or {}
            if not more:
                return

    def page(self, title: str) -> dict:
        """title, requested_title, html, fetched_at."""
        data = self.get(action="parse", page=title, prop="text", redirects=1)["parse"]
        return {"title": data["title"], "requested_title": title, "html": data["text"], "fetched_at": datetime.datetime.now().replace(microsecond=0)}


class _Whole(InputPartition):
    pass


class _WikiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Whole(0)]

    def read(self, partition):
        o = self.options
        client = WikiClient(o["api"], float(o.get("min_delay", 2.0)), int(o.get("max_retries", 6)), _TRANSPORTS.get(o.get("transport", "http"), http_get))
        if "prefix" in o:
            titles = list(client.titles_with_prefix(o["prefix"]))
        else:
            titles = [t for t in o.get("titles", "").split("\n") if t.strip()]
        for t in titles:
            p = client.page(t)
            yield (p["title"], p["requested_title"], p["html"], p["fetched_at"])


#: Transports by name: an option can only carry a name.
_TRANSPORTS: dict[str, Transport] = {"http": http_get}


class WikiPages(DataSource):
    @classmethod
    def name(cls):
        return "wikipages"

    def schema(self):
        return RAW_PAGES

    def reader(self, schema):
        return _WikiReader(dict(self.options))


# --- discovery ----------------------------------------------------------------------


def toc_titles(main_page_html: str, book: str) -> list[str]:
    """Titles that a book's main page links to: no dead links, below the book, first
    seen first."""
    prefix = unicodedata.normalize("NFC", book) + "/"
    titles = [unicodedata.normalize("NFC", t.replace("_", " ")).strip() for _, _, t, classes in html.links(main_page_html) if "new" not in classes]
    return list(dict.fromkeys(t for t in titles if t.startswith(prefix)))


def page_titles(pages: DataFrame, book_prefix: str, column: str = "html") -> DataFrame:
    """(page position, title): the same for a table of pages, distinct, in order."""
    each = pages.select(F.explode(html.page_links(column)).alias("a")).select("a.*").where(~F.array_contains("classes", "new"))
    named = each.select("pos", text.normalize_title("title").alias("title")).where(F.startswith("title", F.lit(book_prefix)))
    return named.groupBy("title").agg(F.min("pos").alias("pos")).select("pos", "title")


def with_extras(toc: DataFrame, found: DataFrame) -> DataFrame:
    """(pos, title): the table of contents, then titles that it lacks, by chapter
    number (unnumbered and zero last) and title."""
    number = F.coalesce(F.nullif(text.chapter_number(text.chapter_name("title")), F.lit(0)), F.lit(1_000_000))
    extra = found.select("title").distinct().join(toc.select("title"), "title", "left_anti")
    extra = extra.select(F.lit(1).alias("src"), F.struct(number.cast("bigint").alias("n"), F.col("title").alias("t")).alias("pos"), "title")
    first = toc.select(F.lit(0).alias("src"), F.struct(F.col("pos").cast("bigint").alias("n"), F.lit("").alias("t")).alias("pos"), "title")
    return first.unionByName(extra)


def missing_titles(wanted: DataFrame, raw_pages: DataFrame | None, refresh: bool = False) -> DataFrame:
    """The titles still to be fetched: keyed by :func:`functions.text.title_key`."""
    keyed = wanted.select("title").withColumn("key", text.title_key("title"))
    if refresh or raw_pages is None:
        return keyed.select("title")
    have = raw_pages.select(text.title_key("requested_title").alias("key"))
    return keyed.join(have, "key", "left_anti").select("title")


def read_titles(spark: SparkSession, titles: list[str], conf: Config) -> DataFrame:
    """Pages by title over the API."""
    spark.dataSource.register(WikiPages)
    options = {"api": conf.wiki_api, "titles": "\n".join(titles), "min_delay": str(conf.min_delay), "max_retries": str(conf.max_retries)}
    return spark.read.format("wikipages").options(**options).load()


def chapters_of(raw_pages: DataFrame, book: str, author: str, host: str, least: int = 30) -> DataFrame:
    """Chapters from fetched pages: readable text, cleaned of the title, author and
    chapter name; those under ``least`` characters are dropped."""
    named = files.bounded(raw_pages).select("title", text.chapter_name("title").alias("chapter"), html.html_text("html").alias("text"))
    drops = F.array(F.lit(book), F.lit(author), F.col("chapter"), F.col("title"))
    marks = F.array(F.lit(book), F.lit(author), F.col("chapter"))
    done = text.cleaned(named, "text", drops, marks).where(F.char_length("text") >= least)
    done = done.withColumn("pl_name", text.nfc("chapter")).withColumn("chapter_no", text.chapter_number("pl_name"))
    return done.select(F.lit(book).alias("book"), F.lit(author).alias("author"), "title", "chapter", "chapter_no", text.page_url(host, "title").alias("url"), "text")
