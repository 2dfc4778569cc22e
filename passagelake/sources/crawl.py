"""A crawl that can stop anywhere and go on from there.

Titles come from a stream: each micro-batch is one request for a page of the wiki's list, the
offset is the token that asks for the next page, and Spark's checkpoint keeps it. A crawl of
titles that died goes on with the token it had; one that ended asks for nothing again.

Pages are fetched in rounds. A round takes titles that the cache lacks, ``per_task`` a lane,
and what it got is appended before the next round begins. A request that fails is a value in
its round: the pages that came are kept first, then the crawl raises. After a request without
an answer a lane asks for nothing more, so a wiki that is down is left alone. Lanes share the
pause between requests by phase (:class:`passagelake.operators.responses.Pace`).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..config import Config
from ..functions import text
from ..operators.responses import Pace
from ..schema import RAW_PAGES
from . import files, wiki

TITLES = "title string, position bigint"


def transport_of(name: str) -> wiki.Transport:
    """A transport by its registered name, or by ``module:function`` for other processes."""
    if ":" in name:
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)
    return wiki._TRANSPORTS[name]


def client_of(options: dict, pause: float | None = None) -> wiki.WikiClient:
    return wiki.WikiClient(options["api"], float(options.get("min_delay", 2.0)) if pause is None else pause, int(options.get("max_retries", 6)), transport_of(options.get("transport", "http")))


# --- titles -------------------------------------------------------------------------


class _TitleReader(SimpleDataSourceStreamReader):
    """Offset: the parameters that ask for the next page of the list, how many titles came
    before it, and whether the list has ended."""

    def __init__(self, options: dict):
        self.options, self.client = options, client_of(options)

    def initialOffset(self) -> dict:
        return {"more": "{}", "titles": 0, "ended": False}

    def _page(self, start: dict) -> tuple[list[str], dict]:
        data = self.client.get(action="query", list="allpages", apprefix=self.options["prefix"], apnamespace=0, aplimit="max", **json.loads(start["more"]))
        titles = [p["title"] for p in data.get("query", {}).get("allpages", [])]
        more = data.get("continue") or {}
        return titles, {"more": json.dumps(more, sort_keys=True), "titles": start["titles"] + len(titles), "ended": not more}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["ended"]:
            return iter([]), start
        titles, end = self._page(start)
        return iter([(t, start["titles"] + i) for i, t in enumerate(titles)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is run again asks again for its pages of the list."""
        while start["titles"] < end["titles"] and not start["ended"]:
            rows, start = self.read(start)
            yield from rows


class WikiTitles(DataSource):
    """Titles with a prefix, as a stream (title, position in the list)."""

    @classmethod
    def name(cls):
        return "wikititles"

    def schema(self):
        return TITLES

    def simpleStreamReader(self, schema):
        return _TitleReader(dict(self.options))


def crawl_titles(spark: SparkSession, prefix: str, path: str, checkpoint: str, conf: Config, transport: str = "http") -> DataFrame:
    """All titles with a prefix, appended to ``path`` a list page at a time. Goes on where a
    crawl with the same checkpoint ended; returns (title, position)."""
    spark.dataSource.register(WikiTitles)
    options = {"api": conf.wiki_api, "prefix": prefix, "min_delay": str(conf.min_delay), "max_retries": str(conf.max_retries), "transport": transport}
    found = spark.readStream.format("wikititles").options(**options).load()
    stream = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return titles(spark, path)


def titles(spark: SparkSession, path: str) -> DataFrame:
    """The titles that crawls have written, normalised, each at its first position."""
    rows = spark.read.schema(TITLES).parquet(path)
    return rows.groupBy(text.normalize_title("title").alias("title")).agg(F.min("position").alias("position"))


# --- pages --------------------------------------------------------------------------


def fetched(names: list[str], client: wiki.WikiClient) -> Iterator[tuple]:
    """(title, requested_title, html, fetched_at, error, tried) of each title in turn. A
    title that the wiki refuses is an error of its own; after a request without an answer the
    rest is not tried."""
    down = False
    for name in names:
        if down:
            yield None, name, None, None, None, False
            continue
        try:
            p = client.page(name)
            yield p["title"], name, p["html"], p["fetched_at"], None, True
        except wiki.NoAnswer as e:
            down = True
            yield None, name, None, None, f"no answer: {e}", True
        except wiki.ApiError as e:
            yield None, name, None, None, f"refused: {e}", True


def crawl_pages(spark: SparkSession, wanted: DataFrame, cache: str, conf: Config, lanes: int = 1, per_task: int = 10, transport: str = "http", refresh: bool = False) -> DataFrame:
    """Fetches the titles of ``wanted`` that ``cache`` lacks and appends them to it; with
    ``refresh`` all. Returns (requested_title, error) of the titles that the wiki refused;
    raises :class:`wiki.NoAnswer` if it stopped answering, after keeping what came."""
    have = files.read_pages(spark, cache) if files.exists(spark, cache) else None
    todo = files.kept(wiki.missing_titles(wanted.select("title").distinct(), have, refresh), "titles")
    rounds = -(-todo.count() // (lanes * per_task))
    options = {"api": conf.wiki_api, "max_retries": str(conf.max_retries), "transport": transport}
    pace = Pace(conf.min_delay, lanes)
    pace = Pace(conf.min_delay, lanes, pace.now())

    def fetch(batches):
        # one client a task: it holds the lane's place in the common rhythm
        client = client_of(options, pause=0.0)
        if pace.delay:
            slots = pace.slots(TaskContext.get().partitionId() % lanes)
            client.wait = lambda: next(slots)
        names = [t for pdf in batches for t in pdf["title"]]
        if names:
            yield pd.DataFrame(list(fetched(names, client)), columns=["title", "requested_title", "html", "fetched_at", "error", "tried"]).astype({"title": object, "html": object, "error": object, "fetched_at": "datetime64[us]"})

    refused = []
    for i in range(rounds):
        part = todo.where(F.pmod(F.xxhash64("title"), F.lit(rounds)) == i).repartition(lanes)
        came = files.kept(part.mapInPandas(fetch, f"{RAW_PAGES}, error string, tried boolean"), "fetched")
        files.append_pages(came.where("html is not null").drop("error", "tried"), cache)
        refused.append(came.where("error like 'refused%'").select("requested_title", "error"))
        lost = came.where("error like 'no answer%'").select("error").first()
        if lost is not None:
            raise wiki.NoAnswer(lost["error"])
    out = spark.createDataFrame([], "requested_title string, error string")
    for part in refused:
        out = out.unionByName(part)
    return out
