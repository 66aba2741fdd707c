"""Downloads inside tasks.  A fetcher is a function url -> (status, content type, body); the status is reported,
never judged."""

from __future__ import annotations

import gzip
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.config import FAIL, CrawlerConfig, Throttle

Fetcher = Callable[[str], tuple[int, str | None, bytes]]
STARTS = 50  # downloads a second that one task may start
THREADS = 32
FETCHED = "url string, status int, body string, error string"


def http_get(user_agent: str = "pagequarry-bot", timeout: float = 60) -> Fetcher:
    import urllib.error
    import urllib.request
    import zlib

    def get(url: str) -> tuple[int, str | None, bytes]:
        request = urllib.request.Request(url, headers={"User-Agent": user_agent, "Accept-Encoding": "gzip, deflate"})
        try:
            answer = urllib.request.urlopen(request, timeout=timeout)
        except urllib.error.HTTPError as e:
            answer = e
        body, coding = answer.read(), answer.headers.get("Content-Encoding", "")
        if coding == "gzip":
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
        return answer.status, answer.headers.get("Content-Type"), body

    return get


def decoded(content_type: str | None, body: bytes) -> str:
    """Text of a body: a gzip file is unpacked; the charset of the content type counts, else UTF-8."""
    if content_type in ("application/x-gzip", "application/gzip"):
        return gzip.decompress(body).decode("utf-8")
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.I)
    try:
        return body.decode(m.group(1) if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def fetch(urls: DataFrame, get: Fetcher, config: CrawlerConfig = CrawlerConfig(), throttle: Throttle | None = None) -> DataFrame:
    """(url, status, body, error) of each row of ``urls``, repetitions included.  The throttle holds for all
    tasks together: concurrent downloads and rates are shared among them, and a task waits before each start,
    also the first, while earlier downloads go on."""
    limit = throttle or config.effective_throttle()
    slim = urls.select("url")
    if limit.kind == "Concurrent":
        parts = max(1, min(config.num_workers, int(limit.value)))
        slim, threads, pause = slim.repartition(parts), max(1, int(limit.value) // parts), 0.0
    else:
        rate = 1 / limit.value if limit.kind == "Delay" else limit.value
        parts = max(1, min(config.num_workers, int(rate / STARTS)))
        slim, threads, pause = slim.repartition(parts), THREADS, parts / rate
    strict = config.on_dl_error == FAIL

    def one(url: str) -> tuple:
        try:
            status, kind, body = get(url)
            return url, status, decoded(kind, body), None
        except Exception as e:
            if strict:
                raise
            return url, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                if pause:
                    started = []
                    for url in batch["url"]:
                        time.sleep(pause)
                        started.append(pool.submit(one, url))
                    rows = [x.result() for x in started]
                else:
                    rows = list(pool.map(one, batch["url"]))
                out = pd.DataFrame(rows, columns=["url", "status", "body", "error"])
                out["status"] = out["status"].astype("Int32")
                yield out

    return slim.mapInPandas(run, FETCHED)


def fetch_from_table(urls: DataFrame, bodies: DataFrame) -> DataFrame:
    """The same from a table (url, body): what is not there is an error."""
    b = bodies.select(F.col("url").alias("_u"), "body").dropDuplicates(["_u"])
    met = urls.select("url").join(b, F.col("url") == F.col("_u"), "left")
    return met.select("url", F.when(F.col("_u").isNotNull(), 200).alias("status"), "body", F.when(F.col("_u").isNull(), "not found").alias("error"))
