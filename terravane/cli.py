"""Commands: crawl, gate, prepare, gold, experiments, analyse, tables, price. ``python -m terravane.cli --help``."""

from __future__ import annotations

import argparse
import json
import logging
import subprocess
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from terravane.operators import gold
from terravane.plans import gate, pipeline, runner, tables
from terravane.sources import crawl, listings, wards
from terravane.sources.store import read_jsonl


def logger(step: str, level: int = logging.INFO) -> logging.Logger:
    """The step's logger, set up once a process."""
    own = logging.getLogger(step)
    if not own.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)-7s %(name)s | %(message)s", datefmt="%H:%M:%S"))
        own.addHandler(handler)
        own.setLevel(level)
    return own


def revision() -> str:
    """The short name of the commit that runs; ``unknown`` outside a repository."""
    try:
        found = subprocess.run(["git", "rev-parse", "--short", "HEAD"], cwd=Path(__file__).parent, capture_output=True, text=True, timeout=5)
        return found.stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terravane", description=__doc__)
    p.add_argument("--results", default="results", help="folder of results and reports")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("crawl")
    c.add_argument("kind", choices=["gateway", "pages"])
    c.add_argument("--url", required=True, help="of the gateway, or of the site without a path")
    c.add_argument("--areas", nargs="+", required=True, help="codes of areas, or paths of their lists")
    c.add_argument("--out", default="store")
    c.add_argument("--max-per-area", type=int, default=300)
    c.add_argument("--no-resume", action="store_true", help="don't stop at known records")
    c.add_argument("--dry-run", action="store_true", help="show the first records, store nothing")
    for name in ("gate", "prepare", "gold"):
        c = sub.add_parser(name)
        c.add_argument("--gateway", help="folder of gateway records, JSON lines")
        c.add_argument("--pages", help="folder of records of detail pages, JSON lines")
    sub.choices["prepare"].add_argument("--out", required=True)
    sub.choices["gold"].add_argument("--size", type=int, default=gold.SIZE)
    for name in ("experiments", "analyse", "price"):
        sub.add_parser(name).add_argument("--listings", required=True, help="prepared listings")
    e = sub.choices["experiments"]
    e.add_argument("--fast", action="store_true", help="few models")
    e.add_argument("--force", action="store_true", help="run what was run already")
    e.add_argument("--sample", type=int, default=None)
    e.add_argument("--search-iterations", type=int, default=runner.SEARCH)
    e.add_argument("--e1-max-rows", type=int, default=runner.E1_ROWS, help="0: all")
    e.add_argument("--only", nargs="*", choices=["e1", "e2", "e3", "ablation"], default=["e1", "e2", "ablation", "e3"])
    sub.choices["price"].add_argument("--values", required=True, help="a listing as JSON")
    sub.add_parser("tables")
    for c in sub.choices.values():
        c.add_argument("--sources", nargs="+", default=["gateway", "history"], help="names of sources; the first is the newest")
        c.add_argument("--cutoff", default="2025-06-30")
    return p


GATEWAY_SCHEMA = "list_id long, list_time long, subject string, body string, price double, price_string string, price_million_per_m2 double, size double, rooms int, floors int, toilets int, width double, house_type int, property_legal_document int, direction int, category_name string, street_name string, ward_name string, ward_name_v3 string, area_name string, latitude double, longitude double, _collected_at timestamp"
PAGES_SCHEMA = ", ".join(f"{c} string" for c in "listing_id title description price_vnd_ld price_text usable_area_text land_area_text area_text bedrooms_text floors_text bathrooms_text frontage_text legal_status direction property_type_ld address posted_at_text".split()) + ", latitude double, longitude double, _collected_at timestamp"


def _raw(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {k: read_jsonl(spark, path, schema) for k, path, schema in (("gateway", a.gateway, GATEWAY_SCHEMA), ("pages", a.pages, PAGES_SCHEMA)) if path}


def _crawl(spark: SparkSession, a: argparse.Namespace, manifest: pipeline.RunManifest, fetch: crawl.Fetch) -> str:
    """Crawl area by area; what was written by area, as JSON."""
    with crawl.PoliteSession(fetch) as session:
        if a.dry_run:
            if a.kind == "pages":
                return json.dumps([item for item, _ in crawl.page_items(session, a.url, a.areas[0], 6)], ensure_ascii=False)
            return json.dumps(crawl.dry_run(session, a.url, a.areas[0]), ensure_ascii=False)
        found = {}
        for area in a.areas:
            if a.kind == "pages":
                found[area] = crawl.crawl_pages(spark, session, a.url, area, a.out, a.max_per_area, a.sources[0])
            else:
                found[area] = crawl.crawl_gateway(spark, session, a.url, area, a.out, a.max_per_area, a.sources[0], not a.no_resume)
            for k, v in found[area].items():
                manifest.count(f"{area}__{k}", v)
        for k, v in session.stats.items():
            manifest.count(f"http_{k}", v)
    return json.dumps(found)


def run(spark: SparkSession, argv: Sequence[str] | None = None, fetch: crawl.Fetch = crawl.urllib_fetch) -> str:
    """Run a command; what it printed or wrote as a report. Crawls go through the transport ``fetch``."""
    a = parser().parse_args(argv)
    log, newest = logger(a.command), a.sources[0]
    with pipeline.RunManifest(spark, a.command, f"{a.results}/manifests", commit=revision(), **{k: v for k, v in vars(a).items() if k != "command"}) as manifest:
        if a.command == "crawl":
            return _crawl(spark, a, manifest, fetch)
        if a.command == "gate":
            raw = _raw(spark, a)
            return gate.run([(gate.gateway_view if k == "gateway" else gate.page_view)(d, k) for k, d in raw.items()])[1]
        if a.command == "prepare":
            raw = _raw(spark, a)
            mapping = wards.mapping(spark, raw["gateway"], f"{a.results}/wards")
            loaders = {"gateway": listings.from_gateway, "pages": listings.from_pages}
            ready, steps = pipeline.prepare(listings.unified([loaders[k](d, mapping, k) for k, d in raw.items()]))
            ready.write.mode("overwrite").parquet(a.out)
            manifest.count("rows", spark.read.parquet(a.out).count())
            return tables.render_funnel(pipeline.funnel_totals(steps, "source", list(raw)), list(raw))
        if a.command == "gold":
            rows = gold.judged(gold.build(_raw(spark, a)["gateway"], "list_id", size=a.size))
            return gold.report(gold.measure(rows), gold.error_breakdown(rows))
        if a.command == "tables":
            return "\n".join(tables.render_all(spark, a.results, a.sources, newest).values())
        specs = runner.default_specs(getattr(a, "fast", False))
        if a.command == "price":
            return json.dumps(runner.price_of(spark, json.loads(a.values), a.results, specs))
        frame = runner.load_frame(spark, a.listings, getattr(a, "sample", None))
        if a.command == "analyse":
            runner.analyse(spark, frame, specs, a.results, newest)
            return runner.export_champion(spark, frame, a.results, newest, specs)
        steps = {
            "e1": lambda: runner.run_e1(spark, frame, specs, a.results, {s: s for s in a.sources}, a.search_iterations, a.e1_max_rows or None, a.force),
            "e2": lambda: runner.run_e2(spark, frame, specs, a.results, a.sources[-1], newest, a.cutoff, a.search_iterations),
            "ablation": lambda: runner.run_ablation(spark, frame, a.results, newest, a.search_iterations, lambda t, f: runner.default_specs(a.fast, t, f)),
            "e3": lambda: runner.run_e3(spark, frame, specs, a.results, newest),
        }
        for name in steps:
            if name in a.only:
                log.info("%s", name)
                steps[name]()
        return "\n".join(tables.render_all(spark, a.results, a.sources, newest).values())


def main(argv: Sequence[str] | None = None) -> None:
    print(run(SparkSession.builder.appName("terravane").getOrCreate(), argv))


if __name__ == "__main__":
    main()
