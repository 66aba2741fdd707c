"""``python -m pagequarry.cli crawl|scrap|completion``; a script is a Python file with one Scraper class."""

from __future__ import annotations

import argparse
import importlib.util
import logging
import sys

from pagequarry.config import APPEND, CREATE, FAIL, SKIP, TRUNCATE, CsvConfig, Throttle, merged
from pagequarry.operators import csv_sink
from pagequarry.operators.durable import checkpointed
from pagequarry.operators.scrape import Scraper, errors, records, scrape
from pagequarry.sources.fetch import fetch, http_get
from pagequarry.sources.files import read_pages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagequarry")
    sub = p.add_subparsers(dest="command", required=True)
    crawl, scrap = sub.add_parser("crawl"), sub.add_parser("scrap")
    for s in (crawl, scrap):
        s.add_argument("-s", "--script", required=True)
        s.add_argument("-o", "--output-file")
        mode = s.add_mutually_exclusive_group()
        mode.add_argument("--append", action="store_true")
        mode.add_argument("--truncate", action="store_true")
        s.add_argument("-q", "--quiet", action="store_true")
        s.add_argument("--num-workers", type=int)
    crawl.add_argument("--user-agent")
    crawl.add_argument("--page-buffer", type=int)
    rate = crawl.add_mutually_exclusive_group()
    rate.add_argument("--conc-dl", type=int)
    rate.add_argument("--rps", type=int)
    rate.add_argument("--delay", type=float)
    for name in ("dl", "xml", "scrap"):
        crawl.add_argument(f"--on-{name}-error", choices=[FAIL, SKIP])
    crawl.add_argument("--robot")
    crawl.add_argument("--max-rounds", type=int)
    what = scrap.add_mutually_exclusive_group(required=True)
    what.add_argument("--url")
    what.add_argument("--files")
    scrap.add_argument("--on-error", choices=[FAIL, SKIP])
    sub.add_parser("completion")
    return p


def check(args: argparse.Namespace, p: argparse.ArgumentParser) -> argparse.Namespace:
    if args.command != "completion" and (args.append or args.truncate) and not args.output_file:
        p.error("--append and --truncate need --output-file")
    if args.command == "scrap" and args.url and (args.num_workers or args.on_error):
        p.error("--num-workers and --on-error don't go with --url")
    return args


def load_script(path: str) -> Scraper:
    spec = importlib.util.spec_from_file_location("scraper_script", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    try:
        import cloudpickle
    except ImportError:
        from pyspark import cloudpickle
    sys.modules["scraper_script"] = module
    cloudpickle.register_pickle_by_value(module)
    found = [x for x in vars(module).values() if isinstance(x, type) and issubclass(x, Scraper) and x is not Scraper]
    if len(found) != 1:
        raise ValueError(f"{path} must hold one Scraper class")
    return found[0]()


def config_of(args: argparse.Namespace, scraper: Scraper):
    given = {k: getattr(args, k) for k in ("user_agent", "page_buffer", "num_workers", "on_dl_error", "on_xml_error", "on_scrap_error", "robot")}
    for name, kind in (("conc_dl", "Concurrent"), ("rps", "PerSecond"), ("delay", "Delay")):
        if getattr(args, name) is not None:
            given["throttle"] = Throttle(kind, getattr(args, name))
    return merged(scraper.config, given)


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = check(p.parse_args(argv), p)
    if args.command == "completion":
        print("complete -W 'crawl scrap completion --script --output-file --append --truncate --quiet' pagequarry")
        return 0
    logging.basicConfig(level=logging.CRITICAL if args.quiet else logging.WARNING)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    scraper = load_script(args.script)
    csv, failed = CsvConfig(**scraper.csv), None
    if args.command == "crawl":
        from pagequarry.streaming.frontier import crawl

        config = config_of(args, scraper)
        result = crawl(spark, scraper, lambda urls, throttle: fetch(urls, http_get(config.user_agent), config, throttle), config, max_rounds=args.max_rounds)
        tagged, failed = result.tagged, result.errors.selectExpr("url AS location", "error")
    elif args.url:
        page = fetch(spark.createDataFrame([(args.url,)], "url string"), http_get(merged(scraper.config).user_agent), merged(scraper.config, {"on_dl_error": FAIL}))
        tagged = scrape(page.selectExpr("'URL' AS kind", "url AS location", "body AS html"), scraper, FAIL, follow=False)
    else:
        pages = read_pages(spark, args.files, args.on_error or FAIL)
        failed = pages.where("error IS NOT NULL").select("location", "error")
        good = pages.where("error IS NULL")
        good = good.repartition(args.num_workers) if args.num_workers else good
        tagged = checkpointed(scrape(good, scraper, args.on_error or FAIL, follow=False))
        failed = failed.union(errors(tagged).select("location", "error"))
    out = records(tagged)
    if args.output_file:
        csv_sink.write_csv(out, args.output_file, APPEND if args.append else TRUNCATE if args.truncate else CREATE, csv)
    else:
        csv_sink.print_csv(out, csv)
    for r in failed.toLocalIterator() if failed is not None and not args.quiet else ():
        logging.getLogger("pagequarry").warning("%s: %s", r["location"], r["error"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
