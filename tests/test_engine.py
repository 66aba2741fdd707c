import gzip
import os
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagequarry import functions as fn
from pagequarry.catalog import ORACLE_SQL, QUERIES, Titles
from pagequarry.cli import check, config_of, load_script, main, parser
from pagequarry.config import FAIL, CrawlerConfig, CsvConfig, Throttle, merged, validate_seed
from pagequarry.css import parse, select
from pagequarry.html import parse_document
from pagequarry.operators import csv_sink
from pagequarry.operators.durable import stored
from pagequarry.operators.extract import Spec, explode_nodes, extract, select_elements
from pagequarry.operators.scrape import Scraper, records, scrape
from pagequarry.plans.select import axis, select_nodes
from pagequarry.sources.fetch import fetch, fetch_from_table
from pagequarry.sources.files import read_pages
from pagequarry.sources.robots import parse_robots
from pagequarry.sources.sitemap import expand_sitemaps, parse_sitemap
from pagequarry.streaming.frontier import crawl, follow, stream_crawl


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, sf, same, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name])
    else:
        assert df.count() == 50


TAGS = st.sampled_from(["<div>", "</div>", "<p class=a>", "<b>", "</b>", "<i id=x>", "</i>", "<table>", "<td>", "</table>", "<template>", "</template>", "t", " ", "<li>", "<br>", "<!--c-->", "</p>", "<select>", "<option>", "<a>", "<svg>", "</svg>", "<h1>"])
STEPS = st.sampled_from(["div", "p", "*", ".a", "b:first-child", "b", "i:last-of-type", ":not(b)", "li:nth-child(2n)", "#x", ":empty", "td", "[class]", ":not(div p)", ":root", "a:only-child"])


def test_plans_equal_trees(spark):
    """The relational plan of a selector finds what the walk of the tree finds."""
    pages, selectors = [], set()

    @settings(max_examples=60, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.lists(TAGS, max_size=25), st.lists(STEPS, min_size=1, max_size=3), st.lists(st.sampled_from([" ", " > ", " + ", " ~ "]), min_size=2, max_size=2))
    def gather(tags, steps, how):
        pages.append("".join(tags))
        selectors.add("".join(x for pair in zip(steps, ["", *how]) for x in reversed(pair))[0:])

    gather()
    nodes = explode_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).cache()
    for s in sorted(selectors)[:14]:
        want = set()
        for i, h in enumerate(pages):
            doc = parse_document(h)
            at = {id(n): k for k, n in enumerate(doc.tree.descendants())}
            want |= {(i, at[id(n)]) for n in select(doc.root, s)}
        assert {(r.page_id, r.node_id) for r in select_nodes(nodes, s).select("page_id", "node_id").collect()} == want, s


def test_any_input_parses():
    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.lists(TAGS, max_size=40))
    def run(tags):
        for n in parse_document("".join(tags)).tree.descendants():
            assert all(c.parent is n for c in n.children)

    run()


def test_edges_of_extraction(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "<p>é</p>", None)], "page_id long, html string, p string")
    assert sorted(map(str, extract(df, {"a": "p"}, keep=["page_id"]).collect())) == sorted(["Row(page_id=1, a=None)", "Row(page_id=2, a=None)", "Row(page_id=2, a=None)", "Row(page_id=None, a='é')"])
    assert select_elements(df, "p").count() == 1 and extract(df.limit(0), {"a": Spec("p", "count")}).count() == 0
    got = select_elements(df, "p", fragment=True, keep=[]).first()
    assert (got.pos, got.html) == (1, "<p>é</p>")


def test_functions(spark):
    one = spark.createDataFrame([("March 8, 2005", " a\nb ", ["k", "l", "k", None], ["1", "2", "3", "4"], ["Ab"])], "d string, s string, k array<string>, v array<string>, c array<string>")
    r = one.select(
        fn.format_date(fn.parse_date(F.col("d"), "%B %d, %Y"), "%Y-%m-%d").alias("iso"), fn.parse_date(F.concat("d", F.lit("x")), "%B %d, %Y").alias("bad"), fn.strip(F.col("s")).alias("s"), fn.one_line(F.col("s")).alias("l"),
        fn.label_map(F.col("k"), F.col("v")).alias("m"), fn.has_class(F.col("c"), "aB").alias("h"), fn.match(F.col("d"), "(%a+) (%d-),").alias("g"), fn.match(F.col("d"), "(zz)").alias("no"), fn.find(F.col("d"), "20%d%d$").alias("f"),
    ).first()
    assert tuple(r) == ("2005-03-08", None, "a\nb", " a b ", {"k": "3", "l": "2"}, True, "March", None, True)
    assert fn.java_pattern("%d.%m.%y at", True) == "d.M.yy 'a''t'"


def test_csv(spark, tmp_path):
    rows = [(["a", 'q"x', "l\nm"],), (["a,b", "", " c "],), ([""],), (["x", None],), (["c\rd"],)]
    df = spark.createDataFrame(rows, "fields array<string>")
    lines = [r[0] for r in df.select(csv_sink.csv_line(F.col("fields"))).collect()]
    assert lines == ['a,"q""x","l\nm"', '"a,b",, c ', '""', "x,", '"c\rd"']
    assert [r[0] for r in df.select(csv_sink.csv_line(F.col("fields"), CsvConfig(delimiter=";", escape="\\"))).collect()][:2] == ['a;"q\\"x";"l\nm"', "a,b;; c "]
    out = str(tmp_path / "out")
    bad = csv_sink.write_csv(df.coalesce(1), out, config=CsvConfig(width=3, terminator="CRLF"))
    assert bad.count() == 3
    data = b"".join(open(os.path.join(out, f), "rb").read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert data == b'a,"q""x","l\nm"\r\n"a,b",, c \r\n'
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        csv_sink.write_csv(df, out)
    csv_sink.write_csv(df, out, "append")
    csv_sink.write_csv(df.limit(1), out, "truncate")
    assert spark.read.text(out, wholetext=True).count() >= 1


def test_config():
    assert merged({"userAgent": "a", "numWorkers": 3}, {"user_agent": "b", "robot": None}).user_agent == "b"
    assert merged({"throttle": {"PerSecond": 5}}).effective_throttle(2.0) == Throttle("PerSecond", 5)
    assert CrawlerConfig().effective_throttle(2.0) == Throttle("Delay", 2.0) and CrawlerConfig().effective_throttle() == Throttle("Concurrent", 100)
    for bad in (lambda: merged({"nope": 1}), lambda: Throttle("Delay", 0), lambda: validate_seed(), lambda: validate_seed(["a"], ["b"]), lambda: validate_seed(robots="r", config=CrawlerConfig(robot="x")), lambda: CsvConfig(delimiter="ab")):
        with pytest.raises(ValueError):
            bad()
    p = parser()
    args = check(p.parse_args(["crawl", "-s", "x", "--rps", "4", "--on-dl-error", FAIL]), p)
    c = config_of(args, Titles())
    assert (c.throttle, c.on_dl_error) == (Throttle("PerSecond", 4), FAIL)
    for argv in (["crawl", "-s", "x", "--rps", "4", "--delay", "1"], ["crawl", "-s", "x", "--append"], ["scrap", "-s", "x"], ["scrap", "-s", "x", "--url", "u", "--on-error", FAIL]):
        with pytest.raises(SystemExit):
            check(p.parse_args(argv), p)


def test_robots():
    r = parse_robots("User-agent: *\nDisallow: /a\nAllow: /a/b$\nCrawl-delay: 2\nSitemap: http://x/s.xml\nUser-agent: pagequarry-bot\nUser-agent: other\nDisallow: /z*q\nAllow: /zz", "pagequarry-bot")
    assert r.delay is None and r.sitemaps == ("http://x/s.xml",)
    assert [r.allowed("http://x" + u) for u in ("/a", "/zaq", "/zzq", "/z", "")] == [True, False, False, True, True]
    star = parse_robots("User-agent: *\nDisallow: /a\nAllow: /a\nDisallow:", "Nobody")
    assert star.allowed("http://x/a") and parse_robots("").allowed("http://x/")


NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_sitemaps(spark):
    assert parse_sitemap(f"<urlset {NS}><url><loc> a </loc></url></urlset>") == ("URL_SET", [" a "])
    assert parse_sitemap('<sm:urlset xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="i"><sm:url><sm:loc>a</sm:loc><i:loc>b</i:loc></sm:url></sm:urlset>')[1] == ["a"]
    bodies = spark.createDataFrame([
        ("i", f"<sitemapindex {NS}><sitemap><loc>i</loc></sitemap><sitemap><loc>u</loc></sitemap><sitemap><loc>bad</loc></sitemap><sitemap><loc>gone</loc></sitemap></sitemapindex>"),
        ("u", f"<urlset {NS}><url><loc>p1</loc></url><url><loc>p1</loc></url><url><loc>q</loc></url></urlset>"), ("bad", "<x"),
    ], "url string, body string")
    get = lambda u: fetch_from_table(u, bodies)
    found, errors = expand_sitemaps(spark.createDataFrame([("i",)], "url string"), get, lambda u, k: (k == "INDEX") | u.startswith("p"))
    assert [r.url for r in found.collect()] == ["p1", "p1"]
    assert sorted((r.url, r.stage) for r in errors.collect()) == [("bad", "xml"), ("gone", "download")]
    with pytest.raises(RuntimeError):
        expand_sitemaps(spark.createDataFrame([("bad",)], "url string"), get)


def _get(url):
    if url == "boom":
        raise OSError("no")
    return (404, "application/gzip", gzip.compress("é".encode())) if url == "gz" else (200, "text/html; charset=latin-1", "é".encode("latin-1"))


def test_fetch(spark):
    urls = spark.createDataFrame([("gz",), ("boom",), ("x",), ("x",)], "url string")
    got = sorted(map(tuple, fetch(urls, _get).collect()))
    assert got == [("boom", None, None, "OSError: no"), ("gz", 404, "é", None), ("x", 200, "é", None), ("x", 200, "é", None)]
    assert fetch(urls, _get, throttle=Throttle("PerSecond", 100)).count() == 4
    with pytest.raises(Exception, match="OSError"):
        fetch(urls, _get, CrawlerConfig(on_dl_error=FAIL)).collect()


class Walk(Scraper):
    seed_sitemaps = ["map"]

    def accept(self, url, kind, robot):
        if url == "err":
            raise ValueError
        return True

    def scrap(self, page, ctx):
        ctx.send_record([ctx.location[1], 1])
        for a in select(page.root, "a"):
            ctx.send_url(a.attr("href"))
        if list(select(page.root, "hr")):
            raise ValueError("hr")


BODIES = [("map", f"<urlset {NS}><url><loc>a</loc></url><url><loc>err</loc></url></urlset>"), ("a", "<a href=b></a><a href=b></a><a href=none></a>"), ("b", "<a href=a></a><hr>")]


def test_crawl(spark, tmp_path):
    bodies = spark.createDataFrame(BODIES, "url string, body string")
    got = crawl(spark, Walk(), lambda u: fetch_from_table(u, bodies))
    assert sorted(r.fields[0] for r in records(got.tagged).collect()) == ["a", "b"]
    assert sorted((r.url, r.stage) for r in got.errors.collect()) == [("b", "scrap"), ("none", "download")]
    with pytest.raises(ValueError):
        follow(bodies, lambda u: u, Walk())
    assert follow(spark.createDataFrame([("a",)], "url string"), lambda u: fetch_from_table(u, bodies), Walk(), max_rounds=3).visited.count() == 1 + 3 + 2
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "0.json").write_text('{"url": "a"}\n')
    stream_crawl(spark, str(inbox), out, lambda u: fetch_from_table(u, bodies), Walk())
    assert sorted(r.location for r in spark.read.parquet(out).where("kind = 'record'").collect()) == ["a", "b"]


SCRIPT = """
from pagequarry.operators.scrape import Scraper
from pagequarry.css import select_first

class Mine(Scraper):
    seed_pages = ["x"]
    def scrap(self, page, ctx):
        ctx.send_record([select_first(page.root, "p").inner_text])
"""


def test_files_and_cli(spark, tmp_path, capsys):
    (tmp_path / "1.html").write_text("<p>a,b")
    (tmp_path / "2.html").write_text("<i>no")
    (tmp_path / "3.html").write_bytes(b"\xff\xfe<p>")
    (tmp_path / "s.py").write_text(SCRIPT)
    pages = read_pages(spark, str(tmp_path / "*.html"), "SkipAndLog")
    assert sorted((r.html, r.error) for r in pages.collect() if r.html) == [("<i>no", None), ("<p>a,b", None)] and pages.where("error IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path / "3.html")).collect()
    assert main(["scrap", "-s", str(tmp_path / "s.py"), "--files", str(tmp_path / "[12].html"), "--on-error", "SkipAndLog", "-q"]) == 0
    assert capsys.readouterr().out == '"a,b"\n'
    assert load_script(str(tmp_path / "s.py")).seed_pages == ["x"] and main(["completion"]) == 0
    with pytest.raises(Exception, match="AttributeError"):
        scrape(pages.where("html LIKE '%no%'"), load_script(str(tmp_path / "s.py")), FAIL).collect()


def test_without_the_subpackage(sf):
    """The rest imports nothing of the training-data subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['pagequarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'page_overview' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_selector_strings():
    assert str(parse("a[b=c]>d")) == 'a[b="c"] > d'


def test_rate_is_global(spark):
    urls = spark.createDataFrame([(f"http://h{i % 3}/{i}",) for i in range(12)], "url string").repartition(4)

    def timed(url):
        return 200, "text/plain", str(time.time()).encode()

    for throttle, gap in ((Throttle("Delay", 0.1), 0.1), (Throttle("PerSecond", 20), 0.05)):
        starts = sorted(float(r.body) for r in fetch(urls, timed, CrawlerConfig(num_workers=4), throttle).collect())
        assert len(starts) == 12 and starts[-1] - starts[0] >= 11 * gap * 0.95


class Polite(Walk):
    seed_sitemaps, seed_robots = None, "http://s/robots.txt"
    ended = []

    def finalizer(self):
        Polite.ended.append(1)


def test_crawl_from_robots(spark):
    site = "http://s"
    loc = lambda *x: '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + "".join(f"<url><loc>{u}</loc></url>" for u in x) + "</urlset>"
    rows = [(f"{site}/robots.txt", f"User-agent: *\nCrawl-delay: 0.25\nSitemap: {site}/map.xml\n"), (f"{site}/map.xml", loc(f"{site}/1")), (f"{site}/1", "<p>one</p>")]
    bodies, asked = spark.createDataFrame(rows, "url string, body string"), []

    def get(urls, throttle):
        asked.append(throttle)
        return fetch_from_table(urls, bodies)

    got = crawl(spark, Polite(), get)
    assert [r.url for r in got.visited.collect()] == [f"{site}/1"] and len(Polite.ended) == 1
    assert asked[0] == Throttle() and set(asked[1:]) == {Throttle("Delay", 0.25)}
    with pytest.raises(RuntimeError):
        crawl(spark, Polite(), lambda u: fetch_from_table(u, bodies.limit(0)))
    assert len(Polite.ended) == 2


@pytest.mark.parametrize("name", ["node_axes", "node_plan_links", "node_plan_siblings"])
def test_node_table_is_made_once(spark, sf, name):
    """A node table that is joined with itself is read from files by each side; no side parses the pages."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation") > 1


@pytest.mark.parametrize("name", ["parent", "children", "ancestors", "descendants", "next_siblings", "prev_siblings", "first_child", "last_child"])
def test_axis_of_some_nodes(spark, name):
    pages = [(1, "<ul><li>a<li>b<ul><li>c</ul></ul>"), (2, "<p>x</p><ul></ul><ul>t<li><b>y</b></ul>"), (3, "<p>")]
    n = stored(explode_nodes(spark.createDataFrame(pages, "page_id long, html string")))
    uls = n.where("name = 'ul'")
    want = axis(n, name).join(uls, ["page_id", "node_id"], "left_semi")
    got = axis(n, name, of=uls)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
