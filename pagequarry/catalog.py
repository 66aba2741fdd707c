"""Queries over the driver's tables, with the SQL that each of them equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import functions as fn
from pagequarry.config import CsvConfig
from pagequarry.html import Document
from pagequarry.css import select, select_first
from pagequarry.operators import csv_sink
from pagequarry.operators.durable import stored
from pagequarry.operators.extract import Spec, explode_nodes, extract, page_facts, select_elements
from pagequarry.operators.scrape import Context, Scraper, errors, records, scrape, urls
from pagequarry.plans.select import axis, inner_text, select_nodes
from pagequarry.sources.fetch import fetch_from_table
from pagequarry.sources.robots import parse_robots, rules_table, with_allowed
from pagequarry.sources.sitemap import expand_sitemaps
from pagequarry.streaming.frontier import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(*(columns or ("page_id", "url", "html")))


def _plain(x: str) -> str:
    """SQL for the text of HTML without tags: the references that occur in the pages."""
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def _inside(tag: str) -> str:
    return f"regexp_extract(html, '<{tag}[^>]*>([\\s\\S]*?)</{tag.split()[0]}>', 1)"


def _count(what: str) -> str:
    return f"CAST((length(html) - length(replace(html, '{what}', ''))) / {len(what)} AS INTEGER)"


_NAV = f"regexp_extract_all({_inside('nav')}, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)"
_NAV_TEXT = _NAV[:-2] + "2)"
_LINKS = f"""WITH n AS (SELECT page_id, {_NAV} AS hrefs, {_NAV_TEXT} AS texts FROM pages),
l AS (SELECT page_id, unnest(hrefs) AS href, unnest(texts) AS text, unnest(range(1, len(hrefs) + 1)) AS pos, len(hrefs) AS n FROM n)
"""


@_query(f"""SELECT page_id, url, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {_plain(_inside('title'))} AS title, {_plain(_inside('h1'))} AS h1,
len({_NAV}) AS n_links, {_count('<p>')} AS n_paragraphs FROM pages""")
def page_overview(spark, sf_dir):
    specs = {"title": Spec("title"), "h1": Spec("article > h1"), "n_links": Spec("nav ul li a[href]", "count"), "n_paragraphs": Spec("p", "count")}
    page = extract(_pages(spark, sf_dir), specs, keep=["page_id", "url", "html"])
    return page.withColumn("lang", F.regexp_extract("html", '<html lang="([^"]*)"', 1)).drop("html")


@_query(_LINKS + "SELECT page_id, CAST(pos AS INTEGER) AS pos, href, text FROM l")
def nav_links(spark, sf_dir):
    return select_elements(_pages(spark, sf_dir), "nav ul li a", keep=["page_id"]).select("page_id", "pos", F.try_element_at("attrs", F.lit("href")).alias("href"), F.col("inner_text").alias("text"))


@_query(_LINKS + "SELECT page_id, min_by(text, pos) AS first, max_by(text, pos) AS last, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (pos % 2 = 1), '') AS odd, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (n - pos + 1 = 2), '') AS second_last, coalesce(string_agg(text, '|' ORDER BY pos) FILTER (pos > 1), '') AS later FROM l GROUP BY page_id")
def nth_links(spark, sf_dir):
    many = lambda s: Spec(s, "text", True)
    got = extract(_pages(spark, sf_dir), {"first": Spec("nav li:first-child > a"), "last": Spec("nav li:last-of-type a"), "odd": many("nav li:nth-child(2n+1) a"), "second_last": many("nav li:nth-last-child(2) a"), "later": many("nav li ~ li > a")}, keep=["page_id"])
    return got.select("page_id", "first", "last", *[F.array_join(c, "|").alias(c) for c in ("odd", "second_last", "later")])


@_query(_LINKS + """SELECT page_id, CAST(count(*) FILTER (href LIKE '/t%') AS INTEGER) AS starts, CAST(count(*) FILTER (href LIKE '%n') AS INTEGER) AS ends, CAST(count(*) FILTER (href LIKE '%er%') AS INTEGER) AS has,
CAST(count(*) FILTER (href LIKE '%ER%') AS INTEGER) AS has_upper, CAST(count(*) FILTER (lower(href) LIKE '%er%') AS INTEGER) AS has_folded, CAST(count(*) FILTER (href <> '/the') AS INTEGER) AS others FROM l GROUP BY page_id""")
def attribute_tests(spark, sf_dir):
    own = {"starts": "a[href^='/t']", "ends": 'a[href$="n"]', "has": "a[href*=er]", "has_upper": "a[href*=ER]", "has_folded": "a[href*=ER i]", "others": "a:not([href='/the'])"}
    return extract(_pages(spark, sf_dir), {k: Spec("nav " + s, "count") for k, s in own.items()}, keep=["page_id"])


@_query(f"""SELECT page_id, {_plain(f"regexp_replace({_inside('footer')}, '<[^>]*>', '', 'g')")} AS footer, {_plain(_inside('div class="ad"').replace('</div class="ad">', '</div>'))} AS ad,
{_plain(f"regexp_replace({_inside('article')}, '<[^>]*>', '', 'g')")} AS article FROM pages""")
def texts(spark, sf_dir):
    return extract(_pages(spark, sf_dir), {"footer": "footer", "ad": "div.ad", "article": "body > article"}, keep=["page_id"])


@_query(f"SELECT page_id, {_count('<p>')} AS p, {_count('<br>')} AS br, {_count('<li>')} AS li, {_inside('nav')} AS nav, 'ad' AS ad_classes FROM pages")
def counts_and_html(spark, sf_dir):
    return extract(_pages(spark, sf_dir), {"p": Spec("p", "count"), "br": Spec("br", "count"), "li": Spec("li", "count"), "nav": Spec("nav", "inner_html"), "ad_classes": Spec(".ad", "classes")}, keep=["page_id"])


@_query()
def unclosed_bold(spark, sf_dir):
    """Formatting elements that are never closed are opened again in each block: no regular expression can."""
    return extract(_pages(spark, sf_dir), {"b": Spec("b", "count"), "p_b": Spec("p > b", "count"), "footer_b": Spec("footer > b", "count"), "nested": Spec("b b b b", "count"), "footer": Spec("footer", "html")}, keep=["page_id"])


@_query()
def parse_facts(spark, sf_dir):
    return page_facts(_pages(spark, sf_dir), keep=["page_id"])


@_query(f"""SELECT page_id, CAST(1 AS BIGINT) AS comments, CAST(1 AS BIGINT) AS doctypes, CAST({_count('<li>')} AS BIGINT) AS items, regexp_extract(html, '<!--([\\s\\S]*?)-->', 1) AS comment FROM pages""")
def node_kinds(spark, sf_dir):
    n = explode_nodes(_pages(spark, sf_dir))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return n.groupBy("page_id").agg(count(F.col("kind") == "comment").alias("comments"), count(F.col("kind") == "doctype").alias("doctypes"), count(F.col("name") == "li").alias("items"), F.max(F.when(F.col("kind") == "comment", F.col("text"))).alias("comment"))


@_query(_LINKS + "SELECT page_id, href FROM l")
def node_plan_links(spark, sf_dir):
    """The selector as joins over the node table."""
    got = select_nodes(stored(explode_nodes(_pages(spark, sf_dir))), "nav > ul > li a[href]")
    return got.select("page_id", F.try_element_at("attrs", F.lit("href")).alias("href"))


@_query(_LINKS + "SELECT page_id, text FROM l WHERE pos > 1 AND pos < n")
def node_plan_siblings(spark, sf_dir):
    n = stored(explode_nodes(_pages(spark, sf_dir)))
    got = inner_text(n, select_nodes(n, "nav li + li:not(:last-child) > a"))
    return got.select("page_id", F.col("inner_text").alias("text"))


@_query(_LINKS + "SELECT page_id, CAST(pos AS INTEGER) AS place, text FROM l")
def node_axes(spark, sf_dir):
    n = stored(explode_nodes(_pages(spark, sf_dir)))
    kids = axis(n, "children", of=n.where("name = 'ul'")).select("page_id", F.col("other_id").alias("node_id"), "place")
    texts_ = inner_text(n, n.where("name = 'li'"))
    return kids.join(texts_, ["page_id", "node_id"]).select("page_id", "place", F.col("inner_text").alias("text"))


@_query(_LINKS + "SELECT page_id, 1 AS scope, CAST(pos AS INTEGER) AS pos, text FROM l")
def scoped_select(spark, sf_dir):
    return select_elements(_pages(spark, sf_dir), ":scope > li a", keep=["page_id"], within="nav ul").select("page_id", "scope", "pos", F.col("inner_text").alias("text"))


@_query("SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages WHERE contains(url, '/en/') AND NOT contains(url, '?')")
def accepted_urls(spark, sf_dir):
    p = _pages(spark, sf_dir, "page_id", "url")
    return p.where(F.contains("url", F.lit("/en/")) & ~F.contains("url", F.lit("?"))).withColumn("host", F.try_parse_url("url", F.lit("HOST")))


_ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/*.html$\nDisallow: /*?\nAllow: /fr\nCrawl-delay: 2\n"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1)"


@_query(f"""SELECT page_id, url, CASE WHEN regexp_matches(p, '^/en/.*\\.html$') THEN true WHEN regexp_matches(p, '^/en/') THEN false WHEN starts_with(p, '/fr') THEN true WHEN contains(p, '?') THEN false ELSE true END AS allowed
FROM (SELECT page_id, url, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS p FROM pages)""")
def robots_verdicts(spark, sf_dir):
    p = _pages(spark, sf_dir, "page_id", "url").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    hosts = p.select("host").distinct()
    one = rules_table(spark, {"": parse_robots(_ROBOTS)}).drop("host")  # one file for all hosts of the table
    return with_allowed(p.drop("host"), hosts.crossJoin(one))


@_query("SELECT url, 'urls:' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS sitemap FROM pages WHERE contains(url, '/de/')")
def sitemap_urls(spark, sf_dir):
    """An index of one sitemap a host, built from the table, then expanded."""
    p = _pages(spark, sf_dir, "url").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    xml = lambda root, item, loc: F.concat(F.lit(f'<{root} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(F.concat(F.lit(f"<{item}><loc>"), loc, F.lit(f"</loc></{item}>"))), ""), F.lit(f"</{root}>"))
    sets = p.groupBy("host").agg(xml("urlset", "url", F.replace("url", F.lit("&"), F.lit("&amp;"))).alias("body")).select(F.concat(F.lit("urls:"), "host").alias("url"), "body")
    index = sets.agg(xml("sitemapindex", "sitemap", F.col("url")).alias("body")).select(F.lit("index").alias("url"), "body")
    bodies = index.union(sets)
    found, _ = expand_sitemaps(spark.createDataFrame([("index",)], "url string"), lambda u: fetch_from_table(u, bodies), lambda url, kind: (kind == "INDEX") | F.contains(url, F.lit("/de/")))
    return found.select("url", "sitemap")


class _Links(Scraper):
    def scrap(self, page: Document, ctx: Context) -> None:
        for a in select(page.root, "a[href]"):
            ctx.send_url(a.attr("href"))


@_query("""WITH RECURSIVE f(id, round) AS (SELECT CAST(min(page_id) AS BIGINT), 0 FROM pages UNION ALL
SELECT n.id, f.round + 1 FROM f, (SELECT unnest([1, 2, 3]) AS k) u, LATERAL (SELECT f.id * 3 + u.k AS id) n WHERE n.id IN (SELECT page_id FROM pages))
SELECT 'page:' || id AS url, CAST(min(round) AS INTEGER) AS round FROM f GROUP BY id""")
def crawl_rounds(spark, sf_dir):
    """A crawl over a table of bodies: each page links to three others and back; the rounds in which pages that
    exist are met."""
    i = F.col("page_id")
    p = _pages(spark, sf_dir, "page_id")
    links = F.array_join(F.transform(F.array(*[i * 3 + k for k in (1, 2, 3)], F.floor((i - 1) / 3).cast("long")), lambda x: F.concat(F.lit('<a href="page:'), x.cast("string"), F.lit('">x</a>'))), "")
    bodies = p.select(F.concat(F.lit("page:"), i.cast("string")).alias("url"), links.alias("body"))
    seeds = p.agg(F.concat(F.lit("page:"), F.min("page_id").cast("string")).alias("url"))
    got = follow(seeds, lambda u: fetch_from_table(u, bodies), _Links(), dedup=True)
    return got.visited.join(bodies, "url", "left_semi")


@_query(_LINKS + "SELECT page_id, string_agg(text || '=' || href, ';' ORDER BY text) AS pairs FROM (SELECT page_id, text, max_by(href, pos) AS href FROM l GROUP BY page_id, text) GROUP BY page_id")
def label_pairs(spark, sf_dir):
    got = extract(_pages(spark, sf_dir), {"labels": Spec("nav a", "text", True), "values": Spec("nav a", "attr:href", True)}, keep=["page_id"])
    entries = F.array_sort(F.map_entries(fn.label_map(F.col("labels"), F.col("values"))))
    return got.select("page_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("pairs")).where("pairs <> ''")


@_query("SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS long, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(o_orderdate AS DATE) AS day FROM orders")
def dates(spark, sf_dir):
    long = fn.format_date(F.col("o_orderdate"), "%B %d, %Y")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", long.alias("long")).withColumn("day", fn.parse_date(F.col("long"), "%B %d, %Y"))
    return o.select("o_orderkey", "long", fn.format_date(F.col("day"), "%Y-%m-%d").alias("iso"), "day")


_FIELD = "CASE WHEN contains({0}, ',') OR contains({0}, '\"') OR contains({0}, chr(10)) OR contains({0}, chr(13)) THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@_query(f"SELECT doc_id, {_FIELD.format('text')} || ',' || {_FIELD.format('source')} AS line FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents)")
def csv_lines(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return d.select("doc_id", csv_sink.csv_line(F.array("text", "source")).alias("line"))


@_query(_LINKS + "SELECT page_id, CAST(max(n) AS INTEGER) AS width FROM l GROUP BY page_id HAVING max(n) <> 5")
def csv_rejects(spark, sf_dir):
    r = extract(_pages(spark, sf_dir), {"fields": Spec("nav a", "text", True)}, keep=["page_id"])
    return csv_sink.split_by_width(r, CsvConfig(width=5))[1].select("page_id", F.size("fields").alias("width")).where("width > 0")


@_query("SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS number, regexp_matches(url, 'page=[0-9]+') AS paged, 'URL' AS kind, coalesce(nullif(regexp_extract(url, 'utm_source=([a-z]+)', 1), ''), 'N/A') AS campaign FROM pages")
def script_strings(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir, "page_id", "url").select("page_id", fn.match(u, "/%l%l/(%d+)").alias("number"), fn.find(u, "page=%d+").alias("paged"), F.lit("URL").alias("kind"), F.coalesce(fn.match(u, "utm_source=(%l+)"), F.lit("N/A")).alias("campaign"))


class Titles(Scraper):
    """A record and links for each page; pages with many links fail after their first record."""

    def scrap(self, page: Document, ctx: Context) -> None:
        title = select_first(page.root, "title")
        ctx.send_record([title.inner_text, len(list(select(page.root, "nav a")))])
        for i, a in enumerate(select(page.root, "nav a"), 1):
            if i > 5:
                raise ValueError("too many links")
            ctx.send_url(a.attr("href"))


def _scraped(spark, sf_dir):
    return scrape(_pages(spark, sf_dir).select(F.lit("URL").alias("kind"), F.col("url").alias("location"), "html"), Titles())


@_query(f"SELECT url AS location, {_plain(_inside('title'))} AS title, CAST(len({_NAV}) AS VARCHAR) AS links FROM pages")
def scraped_records(spark, sf_dir):
    r = records(_scraped(spark, sf_dir))
    return r.select("location", F.get("fields", F.lit(0)).alias("title"), F.get("fields", F.lit(1)).alias("links"))


@_query(_LINKS.replace("page_id", "url") + "SELECT url AS location, CAST(pos AS INTEGER) AS seq, href AS url FROM l WHERE pos <= 5")
def scraped_urls(spark, sf_dir):
    return urls(_scraped(spark, sf_dir))


@_query(_LINKS.replace("page_id", "url") + "SELECT url AS location, 'ValueError: too many links' AS error FROM l WHERE pos = 6")
def scraped_errors(spark, sf_dir):
    return errors(_scraped(spark, sf_dir))
