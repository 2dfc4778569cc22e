"""From a wiki to an index: discover, fetch, extract, clean, chunk, embed."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, from_environment
from ..operators import index
from ..sources import crawl, files, wiki


def fetch_book(spark: SparkSession, book: str, cache: str, conf: Config, main_page_html: str | None = None, refresh: bool = False, lanes: int = 1, transport: str = "http") -> DataFrame:
    """The pages of a book: titles of its contents page and of its prefix, fetched where the
    cache lacks them. A run that was cut off goes on with what it had."""
    main = main_page_html if main_page_html is not None else crawl.client_of({"api": conf.wiki_api, "min_delay": conf.min_delay, "max_retries": conf.max_retries, "transport": transport}).page(book)["html"]
    toc = spark.createDataFrame(list(enumerate(wiki.toc_titles(main, book))), "pos long, title string")  # the links of one page
    listed = files.scratch(spark, "titles") if refresh else f"{cache}-titles"
    found = crawl.crawl_titles(spark, f"{book}/", f"{listed}/list", f"{listed}/checkpoint", conf, transport)
    ordered = files.kept(wiki.with_extras(toc, found.select("title")), "ordered")
    crawl.crawl_pages(spark, ordered.select("title"), cache, conf, lanes, transport=transport, refresh=refresh)
    pages = files.latest_pages(files.read_pages(spark, cache))
    return pages.join(ordered.select(F.col("title").alias("requested_title"), "src", "pos"), "requested_title")


def build(spark: SparkSession, chapters: DataFrame, path: str, conf: Config, book: str = "") -> None:
    """Chunks, embeds and stores chapters."""
    chunks = index.with_positions(index.split_chapters(files.bounded(chapters), conf.chunk_size, conf.chunk_overlap))
    names = [r["chapter"] for r in chapters.select("chapter", "chapter_no").orderBy(F.coalesce("chapter_no", F.lit(1_000_000)), "chapter").collect()]
    info = {"book": book, "chunk_size": conf.chunk_size, "chunk_overlap": conf.chunk_overlap, "num_chapters": len(names), "chapters": names}
    index.build_index(chunks, index.make_embedder(conf), path, info)


def chapter_totals(chapters: DataFrame) -> DataFrame:
    """One row (chapters, characters)."""
    return chapters.agg(F.count(F.lit(1)).alias("chapters"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("characters"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """One row (chunks, mean, max) of lengths in characters."""
    n = F.char_length("text")
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean"), F.max(n).cast("bigint").alias("max"))


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--book", required=True)
    p.add_argument("--author", default="")
    p.add_argument("--data", default="data")
    p.add_argument("--index", default="index")
    p.add_argument("--skip-crawl", action="store_true", help="use the chapters that are there")
    p.add_argument("--refresh", action="store_true", help="fetch pages again")
    p.add_argument("--lanes", type=int, default=1, help="tasks that share the pause between requests")
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--chunk-overlap", type=int)
    a = p.parse_args(args)
    conf = from_environment()
    over = {k: v for k, v in (("chunk_size", a.chunk_size), ("chunk_overlap", a.chunk_overlap)) if v is not None}
    conf = Config(**{**conf.__dict__, **over})
    spark = SparkSession.builder.getOrCreate()
    if not a.skip_crawl:
        pages = fetch_book(spark, a.book, f"{a.data}/pages", conf, refresh=a.refresh, lanes=a.lanes)
        files.write_chapters(wiki.chapters_of(pages, a.book, a.author, conf.wiki_host), f"{a.data}/chapters")
    chapters = files.read_chapters(spark, f"{a.data}/chapters")
    build(spark, chapters, a.index, conf, a.book)


if __name__ == "__main__":
    main()
