"""Per-page functions over tables of pages.

A ``Scraper`` gets each page's document and a context; what it sends becomes rows of one tagged table, from
which records, URLs and errors are taken.  Records sent before an error are kept."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.config import FAIL, SKIP
from pagequarry.html import Document, parse_document
from pagequarry.sources.robots import Robot

log = logging.getLogger("pagequarry")
TAGGED = "kind string, location_kind string, location string, seq int, fields array<string>, url string, error string, worker string"


@dataclass
class Context:
    """Of one page.  ``location`` is (kind, value), kind URL or PATH."""

    location: tuple[str, str]
    worker_id: str = "main"
    robot: Robot | None = None
    can_send_urls: bool = True
    sent: list[tuple] = field(default_factory=list)

    def send_record(self, record: list) -> None:
        self.sent.append(("record", [None if f is None else f if isinstance(f, str) else str(f) for f in record], None))

    def send_url(self, url: str) -> None:
        if self.can_send_urls:
            self.sent.append(("url", None, url))
        else:
            log.warning("URLs can't be followed in this mode: %s", url)


class Scraper(ABC):
    """Made once, pickled to the workers."""

    seed_pages: list[str] = []
    seed_sitemaps: list[str] = []
    seed_robots: str | None = None
    config: dict = {}
    csv: dict = {}

    def setup(self) -> None:
        """Called once in each task."""

    def accept(self, url: str, kind: str, robot: Robot | None) -> bool:
        """Whether a sitemap's entry is followed; an error counts as no."""
        return True

    @abstractmethod
    def scrap(self, page: Document, ctx: Context) -> None: ...

    def finalizer(self) -> None:
        """Called on the driver at the end."""


def scrape(pages: DataFrame, scraper: Scraper, on_error: str = SKIP, robot: Robot | None = None, follow: bool = True) -> DataFrame:
    """The tagged table of pages (kind, location, html); other columns are ignored.  A null page is empty."""
    strict = on_error == FAIL

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        worker = str(task.partitionId()) if task else "main"
        scraper.setup()
        for batch in batches:
            rows = []
            for kind, location, html in zip(batch["kind"], batch["location"], batch["html"]):
                ctx = Context((kind, location), worker, robot, follow)
                error = None
                try:
                    scraper.scrap(parse_document(html), ctx)
                except Exception as e:
                    if strict:
                        raise
                    error = f"{type(e).__name__}: {e}"
                    log.error("%s: %s", location, error)
                rows += [(k, kind, location, i, f, u, None, worker) for i, (k, f, u) in enumerate(ctx.sent)]
                if error:
                    rows.append(("error", kind, location, len(ctx.sent), None, None, error, worker))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAGGED.split(", ")])

    return pages.select("kind", "location", F.col("html").cast("string")).mapInPandas(run, TAGGED)


def records(tagged: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(location, seq, fields), or one STRING column for each name (missing fields null)."""
    r = tagged.where("kind = 'record'")
    if names is None:
        return r.select("location", "seq", "fields")
    return r.select(*[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


def urls(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'url'").select("location", "seq", "url")


def errors(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'error'").select("location", "error")


def accept_udf(scraper: Scraper, robot: Robot | None = None):
    """``scraper.accept`` as a function of (url, kind) columns; errors count as no."""

    def one(url, kind) -> bool:
        try:
            return bool(scraper.accept(url, kind, robot))
        except Exception as e:
            log.error("accept(%s): %s", url, e)
            return False

    @F.pandas_udf("boolean")
    def accepted(url: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([one(u, k) for u, k in zip(url, kind)], dtype=bool)

    return accepted
