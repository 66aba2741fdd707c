"""URL filters: all glob rules are run at once by one bit-parallel automaton.

Each rule is a string of literal characters, ``?`` (any one character) and ``*`` (any run, also
across ``/``), matched against the whole canonical URL.  A rule of m characters takes m + 1
neighbouring bits of a multiword state; one step of the automaton for a character c is
``((D << 1) & mask[c]) | (D & loop)``, for all rules together, and a batch of URLs is stepped
together, longest first.  The cost is (longest URL) x (words of state) vector operations a batch;
the rules travel in the closure, so nothing is shuffled or broadcast.

Canonical form (JVM expressions): blanks around it and the fragment go; scheme and host become
lower case; a default port, tracking parameters and empty query parts go.  What has no ``://`` is
only trimmed, cut at ``#`` and lower-cased.

Defined results: a null URL has a null canonical form, no matched rules and is kept; an empty URL is
matched like any other string; repeated rows are each decided; no rules match nothing.  Other
columns of the input are ignored, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACKING = r"([?&])(?:utm_[a-z]+|gclid|fbclid|ref|sessionid)=[^&]*"


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), "#[\\s\\S]*$", "")
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([\s\S]*)$"
    scheme = F.lower(F.regexp_extract(bare, whole, 1))
    host = F.lower(F.regexp_extract(bare, whole, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(F.regexp_extract(bare, whole, 3), TRACKING, "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), r"\?&+", "?"), "[?&]+$", "")
    rest = F.when(rest == "", "/").otherwise(rest)
    return F.when(F.contains(bare, F.lit("://")) & (scheme != ""), F.concat(scheme, F.lit("://"), host, rest)).otherwise(F.lower(bare))


class GlobAutomaton:
    """Multiword Shift-And masks of a list of globs."""

    def __init__(self, globs: list[str]):
        self.globs = list(globs)
        cells: list[list[tuple[str | None, bool]]] = []  # per rule: the start cell, then one for each character
        for g in self.globs:
            own: list[tuple[str | None, bool]] = [("", False)]
            for c in g:
                if c == "*":
                    own[-1] = (own[-1][0], True)
                else:
                    own.append((None if c == "?" else c, False))
            cells.append(own)
        n = sum(map(len, cells))
        self.words = max(1, -(-n // 64))
        self.alphabet = np.array(sorted({ord(c) for own in cells for c, _ in own if c}), dtype=np.uint32)
        self.mask = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)  # the last row: every other character
        self.loop = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept: list[tuple[int, int]] = []
        rank = {int(c): i for i, c in enumerate(self.alphabet)}
        bit = 0
        for own in cells:
            for k, (c, loops) in enumerate(own):
                w, b = divmod(bit, 64)
                one = np.uint64(1 << b)
                if k == 0:
                    self.start[w] |= one
                elif c is None:
                    self.mask[:, w] |= one
                else:
                    self.mask[rank[ord(c)], w] |= one
                if loops:
                    self.loop[w] |= one
                bit += 1
            self.accept.append(divmod(bit - 1, 64))

    def match(self, texts: list[str]) -> np.ndarray:
        """A boolean matrix (texts, rules)."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        if not texts or not self.globs:
            return out
        lens = np.array([len(t) for t in texts])
        order = np.argsort(-lens, kind="stable")
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.alphabet, flat)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == flat[known]
        codes = np.where(known, at, len(self.alphabet))
        first = (np.cumsum(lens) - lens)[order]
        ends = lens[order]
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        active = len(texts)
        for t in range(int(ends[0]) + 1):
            while active and ends[active - 1] <= t:
                active -= 1
            if not active:
                break
            d = state[:active]
            shifted = d << np.uint64(1)
            if self.words > 1:
                shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (shifted & self.mask[codes[first[:active] + t]]) | (d & self.loop)
        for r, (w, b) in enumerate(self.accept):
            out[order, r] = (state[:, w] >> np.uint64(b)) & np.uint64(1)
        return out


def filter_urls(df: DataFrame, id_col: str, url_col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(id, url, canonical, rules, blocked): the names of the matching rules in rule order.  ``rules``
    has (name, glob) pairs; a name that begins with ``allow`` overrides the blocks."""
    names = [n for n, _ in rules]
    allow = np.array([n.startswith("allow") for n in names], bool)
    automaton = GlobAutomaton([g for _, g in rules])

    @F.pandas_udf("struct<rules: array<string>, blocked: boolean>")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            null = urls.isna().to_numpy()
            hit = automaton.match([u if isinstance(u, str) else "" for u in urls])
            hit[null] = False
            blocked = hit[:, ~allow].any(axis=1) & ~hit[:, allow].any(axis=1)
            yield pd.DataFrame({"rules": [[names[j] for j in np.flatnonzero(h)] for h in hit], "blocked": blocked})

    slim = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), canonical_url(F.col(url_col)).alias("canonical"))
    return slim.withColumn("d", decide("canonical")).select("id", "url", "canonical", "d.rules", "d.blocked")


RULES = [
    ("block_blog_host", "*://blog.*"),
    ("block_mobile_host", "*://m.*"),
    ("block_feed", "*/feed*"),
    ("block_paging", "*?page=*"),
    ("block_login", "*/login*"),
    ("block_calendar", "*/calendar/????-??-??*"),
    ("block_print", "*[print]*"),
    ("block_short_number", "*/?"),
    ("block_two_digits_html", "*/??.html"),
    ("block_archive", "*.zip"),
    ("block_image", "*.jp?g"),
    ("block_cgi", "*/cgi-bin/*.cgi*"),
    ("block_plain_http_es", "http://*/es/*"),
    ("block_tag_page", "*/tag/*/page/*"),
    ("block_ends_99", "*99"),
    ("block_slash_end", "*://*/*/*/"),
    ("allow_www_en", "*://www.*/en/*"),
    ("allow_robots", "*/robots.txt"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = filter_urls(pages, "page_id", "url", RULES).withColumnRenamed("id", "page_id")
    return out.withColumn("rules", F.array_join("rules", ","))


def _sql() -> str:
    like = lambda g: "'" + g.replace("'", "''").replace("[", "[[]") + "'"
    hits = ", ".join(f"CASE WHEN canonical GLOB {like(g)} THEN '{n}' END" for n, g in RULES)
    return f"""
WITH b AS (SELECT page_id, url, regexp_replace(trim(url), '#[\\s\\S]*$', '') AS bare FROM pages),
p AS (SELECT *, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([\\s\\S]*)$', 1)) AS scheme,
        lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([\\s\\S]*)$', 2)) AS host,
        regexp_replace(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([\\s\\S]*)$', 3), '{TRACKING}', '\\1', 'g') AS rest FROM b),
q AS (SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS h,
        regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+$', '') AS r FROM p),
c AS (SELECT page_id, url, CASE WHEN contains(bare, '://') AND scheme <> '' THEN scheme || '://' || h || CASE WHEN r = '' THEN '/' ELSE r END
        ELSE lower(bare) END AS canonical FROM q),
m AS (SELECT page_id, url, canonical, list_filter([{hits}], lambda x: x IS NOT NULL) AS hit FROM c)
SELECT page_id, url, canonical, array_to_string(hit, ',') AS rules,
       len(list_filter(hit, lambda x: x LIKE 'block%')) > 0 AND len(list_filter(hit, lambda x: x LIKE 'allow%')) = 0 AS blocked FROM m
"""


SQL = _sql()
