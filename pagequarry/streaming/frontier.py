"""The crawl: fetch, scrape and follow until no URL is left."""

from __future__ import annotations

import inspect
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.config import FAIL, CrawlerConfig, merged, validate_seed
from pagequarry.operators.durable import checkpointed, shared_dir
from pagequarry.operators.scrape import TAGGED, Scraper, accept_udf, scrape
from pagequarry.sources.robots import Robot, parse_robots, with_allowed
from pagequarry.sources.sitemap import expand_sitemaps

Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class CrawlResult:
    tagged: DataFrame  # what the scraper sent, see operators.scrape
    errors: DataFrame  # (url, stage, error)
    visited: DataFrame  # (url, round)


def _as_pages(got: DataFrame) -> DataFrame:
    return got.where("error IS NULL").select(F.lit("URL").alias("kind"), F.col("url").alias("location"), F.col("body").alias("html"))


def follow(
    seeds: DataFrame, fetch: Fetch, scraper: Scraper, config: CrawlerConfig = CrawlerConfig(), robot: Robot | None = None, dedup: bool = False, max_rounds: int | None = None, rules: DataFrame | None = None
) -> CrawlResult:
    """Rounds of fetching and scraping; URLs that pages send are the next round's, repetitions included unless
    ``dedup``, which leaves out what was visited.  Without it a cycle never ends, so set ``max_rounds``.
    ``rules`` (see sources.robots) drops URLs that they don't allow."""
    if not dedup and max_rounds is None:
        raise ValueError("without dedup a limit of rounds is needed")
    spark = seeds.sparkSession
    out, errors, visited, k = [], [], [], 0
    frontier = seeds.select("url")
    while max_rounds is None or k < max_rounds:
        if dedup:
            frontier = frontier.distinct()
            if visited:
                frontier = frontier.join(reduce(DataFrame.union, visited).select("url"), "url", "left_anti")
        if rules is not None:
            frontier = with_allowed(frontier, rules).where("allowed").drop("allowed")
        frontier = checkpointed(frontier)
        if frontier.isEmpty():
            break
        visited.append(frontier.select("url", F.lit(k).alias("round")))
        got = checkpointed(fetch(frontier).select("url", "body", "error"))
        lost = got.where("error IS NOT NULL").select("url", F.lit("download").alias("stage"), "error")
        if config.on_dl_error == FAIL and (first := lost.first()):
            raise RuntimeError(f"{first['url']}: {first['error']}")
        sent = checkpointed(scrape(_as_pages(got), scraper, config.on_scrap_error, robot))
        out.append(sent)
        errors += [lost, sent.where("kind = 'error'").select(F.col("location").alias("url"), F.lit("scrap").alias("stage"), "error")]
        frontier = sent.where("kind = 'url'").select("url")
        k += 1
    empty = lambda s: spark.createDataFrame([], s)
    return CrawlResult(reduce(DataFrame.union, out, empty(TAGGED)), reduce(DataFrame.union, errors, empty("url string, stage string, error string")), reduce(DataFrame.union, visited, empty("url string, round int")))


def crawl(spark: SparkSession, scraper: Scraper, fetch: Fetch, config: CrawlerConfig | None = None, dedup: bool = True, max_rounds: int | None = None, strict_seed: bool = True) -> CrawlResult:
    """From the scraper's seed to the end of its frontier, then its finalizer, which also runs where the crawl
    fails or is interrupted.  A ``fetch`` of two arguments gets the throttle as its second: the configured one,
    else the delay that the robots file asks for, else the default."""
    try:
        return _crawl(spark, scraper, fetch, config, dedup, max_rounds, strict_seed)
    finally:
        scraper.finalizer()


def _crawl(spark: SparkSession, scraper: Scraper, get: Callable, config: CrawlerConfig | None, dedup: bool, max_rounds: int | None, strict_seed: bool) -> CrawlResult:
    config = config or merged(scraper.config)
    kind, urls = validate_seed(scraper.seed_pages, scraper.seed_sitemaps, scraper.seed_robots, config)
    seeds = spark.createDataFrame([(u,) for u in urls], "url string")
    robot = None
    limited = len(inspect.signature(get).parameters) > 1
    fetch = (lambda u: get(u, config.effective_throttle(robot.delay if robot else None))) if limited else get
    source = config.robot or (urls[0] if kind == "robots" else None)
    if source:
        got = fetch(spark.createDataFrame([(source,)], "url string")).first()
        if got is None or got["error"]:
            raise RuntimeError(f"{source}: {got['error'] if got else 'nothing'}")
        robot = parse_robots(got["body"], config.user_agent)
    early = None
    if kind != "pages":
        accept = accept_udf(scraper, robot)
        if kind == "robots":
            seeds = spark.createDataFrame([(u,) for u in robot.sitemaps], "url string").where(accept(F.col("url"), F.lit("INDEX")))
        found, early = expand_sitemaps(seeds, fetch, accept, config.on_dl_error, config.on_xml_error, strict_seed)
        seeds = found.select("url")
    result = follow(seeds, fetch, scraper, config, robot, dedup, max_rounds)
    if early is not None:
        result.errors = early.union(result.errors)
    return result


def stream_crawl(spark: SparkSession, inbox: str, out: str, fetch: Fetch, scraper: Scraper, config: CrawlerConfig = CrawlerConfig(), files_per_trigger: int = 1000) -> None:
    """The frontier as a stream: ``inbox`` is a folder of JSON lines (url); each micro-batch leaves out what was
    visited, fetches, scrapes, writes to ``out`` and puts the URLs found back into the inbox.  Returns when a
    run over all available files adds none.  A batch that is replayed after a failure overwrites its own
    output, so results are exactly once."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    added = [True]

    def step(batch: DataFrame, epoch: int) -> None:
        urls = batch.select("url").where("url IS NOT NULL").distinct()
        seen = spark.read.schema("url string, epoch long").parquet(f"{base}/visited") if epoch or _exists(spark, f"{base}/visited") else None
        if seen is not None:
            urls = urls.join(seen.where(F.col("epoch") < epoch).select("url"), "url", "left_anti")
        urls = checkpointed(urls)
        urls.write.mode("overwrite").parquet(f"{base}/visited/epoch={epoch}")
        sent = checkpointed(scrape(_as_pages(fetch(urls).select("url", "body", "error")), scraper, config.on_scrap_error))
        sent.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        found = sent.where("kind = 'url'").select("url").distinct().join(urls, "url", "left_anti")
        if not found.isEmpty():
            added[0] = True
            found.coalesce(1).write.mode("append").json(inbox)

    while added[0]:
        added[0] = False
        stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", files_per_trigger).json(inbox)
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
