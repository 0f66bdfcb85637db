"""Command line: python -m assetlens COMMAND. Usage errors exit with 2, others with 1.

Commands that ask someone else (place lookups, models) take the function that does as MODULE:FUNCTION.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from .api import VERSION, Archive, manifest
from .operators.place_run import load_results
from .paths import RuntimePaths, output_dir, reject_repository_path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="assetlens")
    p.add_argument("--db", default=RuntimePaths.default().archive)
    s = p.add_subparsers(dest="command", required=True)
    for name in ("version", "metadata", "init", "status"):
        s.add_parser(name)
    c = s.add_parser("crawl")
    c.add_argument("--library", required=True)
    c.add_argument("--provider", default="auto")
    c = s.add_parser("classify")
    c.add_argument("--limit", type=int, default=100)
    c.add_argument("--all", action="store_true")
    c = s.add_parser("search")
    c.add_argument("--query", default="")
    c.add_argument("--limit", type=int, default=20)
    c.add_argument("words", nargs="*")
    c = s.add_parser("timeline")
    c.add_argument("--from", dest="start", required=True)
    c.add_argument("--to", dest="end", required=True)
    c.add_argument("--include-unlocated", action="store_true")
    for name in ("open", "neighbors", "export"):
        c = s.add_parser(name)
        c.add_argument("--id", required=True)
        c.add_argument("--limit", type=int, default=20)
    c = s.add_parser("evidence")
    c.add_argument("--row-id", required=True)
    c = s.add_parser("place-context")
    c.add_argument("--input", required=True)
    c.add_argument("--radius", type=float, default=150.0)
    c.add_argument("--cache", default=RuntimePaths.default().place_cache)
    c.add_argument("--lookup", required=True)
    c = s.add_parser("place-card")
    c.add_argument("--input", required=True)
    c = s.add_parser("place-backfill")
    c.add_argument("--out", default=RuntimePaths.default().place_backfill)
    c.add_argument("--lookup", required=True)
    c = s.add_parser("eval-card")
    c.add_argument("--out", default="")
    c.add_argument("--models", default="")
    c.add_argument("--call")
    c.add_argument("--prompt")
    c.add_argument("--limit", type=int, default=15)
    c.add_argument("--concurrency", type=int, default=4)
    c.add_argument("--sample", default="latest")
    c.add_argument("--seed", type=int, default=1)
    return p


def function(name: str | None):
    """The function that MODULE:FUNCTION names."""
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name}: MODULE:FUNCTION is required")
    return getattr(importlib.import_module(module), attribute)


def eval_card(archive: Archive, a: argparse.Namespace) -> dict:
    out = output_dir(a.out, RuntimePaths.default().evaluations)
    reject_repository_path(out)
    template = None if a.prompt is None else archive.spark.read.text(a.prompt, wholetext=True).first()[0]
    models = [m.strip() for m in a.models.split(",") if m.strip()]
    return archive.eval_card(out, models, function(a.call), template=template, limit=a.limit, sample=a.sample, seed=a.seed, concurrency=a.concurrency)


def query_words(query: str, words: list[str]) -> str:
    return " ".join(w for w in [query, *words] if w)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    if a.command == "metadata":
        print(json.dumps(manifest()))
        return 0
    from pyspark.sql import SparkSession

    archive = Archive(SparkSession.builder.appName("assetlens").config("spark.sql.session.timeZone", "UTC").getOrCreate(), a.db)
    run = {
        "init": archive.init,
        "status": archive.status,
        "crawl": lambda: archive.crawl(a.library, a.provider).fields(),
        "classify": lambda: archive.classify(None if a.all else a.limit),
        "search": lambda: archive.search(query_words(a.query, a.words), a.limit),
        "timeline": lambda: archive.timeline(a.start, a.end, a.include_unlocated),
        "open": lambda: archive.open(a.id),
        "neighbors": lambda: archive.neighbors(a.id, a.limit),
        "export": lambda: archive.export_choice(a.id),
        "evidence": lambda: archive.evidence(a.row_id),
        "place-context": lambda: archive.place_context(archive.spark.read.text(a.input, wholetext=True), a.cache, function(a.lookup), a.radius),
        "place-card": lambda: archive.place_cards(load_results(archive.spark.read.text(a.input, wholetext=True), "value"), "value").select("card"),
        "place-backfill": lambda: archive.place_backfill(a.out, function(a.lookup)),
        "eval-card": lambda: eval_card(archive, a),
    }
    try:
        out = run[a.command]()
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    if hasattr(out, "toJSON"):
        for line in out.toJSON().toLocalIterator():
            print(line)
    else:
        print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
