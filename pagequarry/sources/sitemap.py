"""XML sitemaps: parsing, and expansion of indexes level by level."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.config import FAIL, SKIP
from pagequarry.operators.durable import checkpointed

NS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
INDEX, URL_SET = "INDEX", "URL_SET"
Fetch = Callable[[DataFrame], DataFrame]  # (url) -> (url, body, error)


def parse_sitemap(xml: str) -> tuple[str, list[str]]:
    """Kind and locations, untrimmed, in order; ValueError if it is no sitemap."""
    try:
        root = ET.fromstring(xml.encode() if xml.lstrip().startswith("<?xml") else xml)
    except ET.ParseError as e:
        raise ValueError(f"malformed XML: {e}") from e
    kind = {"sitemapindex": INDEX, "urlset": URL_SET}.get(root.tag.rpartition("}")[2])
    if kind is None:
        raise ValueError(f"{root.tag} is not a sitemap's root")
    return kind, ["".join(e.itertext()) for e in root.iter(NS + "loc")]


def sitemap_entries(pages: DataFrame, on_error: str = SKIP) -> DataFrame:
    """(url, kind, pos, loc, error) of pages (url, body): a row for each entry from 1, or one with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, body in zip(batch["url"], batch["body"]):
                try:
                    kind, locs = parse_sitemap(body or "")
                    rows += [(url, kind, i, x, None) for i, x in enumerate(locs, 1)]
                except ValueError as e:
                    if on_error == FAIL:
                        raise
                    rows.append((url, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=["url", "kind", "pos", "loc", "error"])
            out["pos"] = out["pos"].astype("Int32")
            yield out

    return pages.select("url", "body").mapInPandas(run, "url string, kind string, pos int, loc string, error string")


def expand_sitemaps(
    seeds: DataFrame, fetch: Fetch, accept: Callable[[Column, Column], Column] | None = None, on_dl_error: str = SKIP, on_xml_error: str = SKIP, strict_seed: bool = True
) -> tuple[DataFrame, DataFrame]:
    """((url, sitemap, depth) for the frontier, (url, stage, error)).  Entries that ``accept(url, kind)`` takes
    are followed (index) or emitted (urlset), repetitions included; a sitemap is fetched once however often it
    is listed, so cycles end.  A seed that fails raises under ``strict_seed``."""
    level, seen, out, errors = seeds.select("url"), None, [], []
    for depth in count():
        level = checkpointed(level.distinct() if seen is None else level.distinct().join(seen, "url", "left_anti"))
        if level.isEmpty():
            break
        seen = level if seen is None else checkpointed(seen.union(level))
        got = checkpointed(fetch(level).select("url", "body", "error"))
        lost = got.where("error IS NOT NULL").select("url", F.lit("download").alias("stage"), "error")
        entries = checkpointed(sitemap_entries(got.where("error IS NULL"), on_xml_error))
        bad = entries.where("error IS NOT NULL").select("url", F.lit("xml").alias("stage"), "error")
        if (strict_seed and depth == 0 or on_dl_error == FAIL) and (first := lost.first()):
            raise RuntimeError(f"{first['url']}: {first['error']}")
        if strict_seed and depth == 0 and (first := bad.first()):
            raise RuntimeError(f"{first['url']}: {first['error']}")
        errors += [lost, bad]
        taken = entries.where("error IS NULL")
        if accept is not None:
            taken = taken.where(F.coalesce(accept(F.col("loc"), F.col("kind")), F.lit(False)))
        out.append(taken.where(F.col("kind") == URL_SET).select(F.col("loc").alias("url"), F.col("url").alias("sitemap"), F.lit(depth).alias("depth")))
        level = taken.where(F.col("kind") == INDEX).select(F.col("loc").alias("url"))
    spark = seeds.sparkSession
    empty = lambda s: spark.createDataFrame([], s)
    return reduce(DataFrame.union, out, empty("url string, sitemap string, depth int")), reduce(DataFrame.union, errors, empty("url string, stage string, error string"))
