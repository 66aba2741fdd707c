"""robots.txt: groups, longest match with ``*`` and ``$``, delays and sitemaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Robot:
    delay: float | None
    sitemaps: tuple[str, ...]
    rules: tuple[tuple[bool, str], ...]  # allowed?, pattern

    def allowed(self, url: str) -> bool:
        """The longest matching pattern decides, an allowing one on ties; no match: allowed."""
        parts = urlsplit(url)
        path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        best = max(((len(p), ok) for ok, p in self.rules if p and re.match(pattern_regex(p), path)), default=(0, True))
        return best[1] or path == "/robots.txt"


def pattern_regex(pattern: str) -> str:
    end = pattern.endswith("$")
    return "^" + ".*".join(re.escape(x) for x in (pattern[:-1] if end else pattern).split("*")) + ("$" if end else "")


def parse_robots(text: str, user_agent: str = "pagequarry-bot") -> Robot:
    """The groups of the longest agent name that begins the user agent's, else those of ``*``."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    sitemaps, fresh = [], False
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps.append(line.partition(":")[2].strip())
        elif key == "user-agent":
            if not fresh:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            fresh = True
        elif groups:
            fresh = False
            if key in ("allow", "disallow"):
                groups[-1][1].append((key == "allow", value))
            elif key == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                groups[-1][2].append(float(value))
    own = user_agent.split("/")[0].lower()
    names = {a for agents, _, _ in groups for a in agents if a != "*" and a and own.startswith(a)}
    name = max(names, key=len) if names else "*"
    mine = [g for g in groups if name in g[0]]
    delays = [d for g in mine for d in g[2]]
    return Robot(delays[0] if delays else None, tuple(sitemaps), tuple(r for g in mine for r in g[1]))


def rules_table(spark, robots: dict[str, Robot]) -> DataFrame:
    """(host, allow, pattern, regex, len), one row a rule."""
    rows = [(h, ok, p, pattern_regex(p), len(p)) for h, r in robots.items() for ok, p in r.rules if p]
    return spark.createDataFrame(rows, "host string, allow boolean, pattern string, regex string, len int")


def with_allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``allowed``.  Rules are gathered by host and joined by it; the verdict is an expression over
    the host's rules, so no row is multiplied."""
    u = F.col(f"`{url_col}`")
    lists = rules.groupBy("host").agg(F.collect_list(F.struct("len", "allow", "regex")).alias("_rules")).withColumnRenamed("host", "_host")
    path = F.coalesce(F.nullif(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(u, F.lit("QUERY"))
    whole = F.concat(path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    met = urls.join(lists, F.lower(F.try_parse_url(u, F.lit("HOST"))) == F.col("_host"), "left").withColumn("_path", whole)
    best = F.array_max(F.filter("_rules", lambda r: F.rlike(F.col("_path"), r["regex"])))
    return met.withColumn("allowed", F.coalesce(best["allow"], F.lit(True)) | (F.col("_path") == "/robots.txt")).drop("_host", "_rules", "_path")
