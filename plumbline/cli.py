"""Command line: validate, inspect, trials, describe, fetch, probe."""

from __future__ import annotations

import argparse
import csv
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from . import constants as C
from .errors import EngineError, SchemaError
from .operators import grid
from .plans.describe import describe_series
from .plans.pipeline import load_config, run_validation
from .sources import series, suggest, tradelog
from .sources.symbology import load_symbology


#: Where a level series comes from.
SOURCE = (("--source", {"choices": ("file", "http"), "default": "file"}), ("--from-file", {}), ("--url", {}), ("--key-variable", {}), ("--start", {}), ("--end", {}))


def session() -> SparkSession:
    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def validate(args: argparse.Namespace) -> None:
    kind = os.path.splitext(args.out)[1]
    if kind not in (".json", ".html", ".tex"):
        raise SystemExit(2)
    report = run_validation(session(), args.log, args.config, datetime.now(UTC).isoformat(timespec="seconds"))
    with open(args.out, "w", encoding="utf-8") as f:
        f.write({".json": report.to_json, ".html": report.to_html, ".tex": report.to_latex}[kind]())
    if args.also_json:
        report.write_json(os.path.splitext(args.out)[0] + ".json")


def inspect(args: argparse.Namespace) -> None:
    with open(args.log, encoding="utf-8-sig", newline="") as f:
        header = next(csv.reader(f), [])
    print(suggest.mapping_draft(os.path.splitext(os.path.basename(args.log))[0], suggest.suggest_columns(header)), end="")


def trials(args: argparse.Namespace) -> None:
    spark, config = session(), load_config(args.config)
    base = os.path.dirname(os.path.abspath(args.config))
    mapping, symbols = tradelog.load_mapping(os.path.join(base, config.mapping_path)), load_symbology(os.path.join(base, config.symbology_path))
    names = [os.path.splitext(os.path.basename(p))[0] for p in args.logs]
    if len(set(names)) < len(names):
        raise SchemaError("logs' names repeat")
    frames = [tradelog.read_trade_log(spark, p, mapping, symbols, n).trades for p, n in zip(args.logs, names, strict=True)]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    matrix, choice, trimmed = grid.build_trials(union, first_log=names[0], basis=config.basis, capital=config.initial_capital)
    grid.wide_trials(matrix).coalesce(1).write.mode("overwrite").option("header", True).csv(args.out)
    print(json.dumps({"period": choice.period, "trimmed": trimmed}, sort_keys=True))


def describe(args: argparse.Namespace) -> None:
    """From a file, or from what ``fetch`` has brought into a cache."""
    if args.file:
        levels, missing = series.read_series(session(), args.file, args.symbol)
    else:
        if not args.cache:
            raise SchemaError("describe reads a --file or a --cache")
        levels, missing = series.load_series(session(), series.FileCache(args.cache), _key(args), _fetcher(args), _now())
    print(json.dumps(describe_series(levels, args.risk_free_rate) | {"missing": missing}, indent=2, sort_keys=True))


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _key(args: argparse.Namespace) -> series.CacheKey:
    return series.CacheKey(args.source, "levels", args.symbol, args.start or "", args.end or "")


def _fetcher(args: argparse.Namespace):
    if args.source == "file":
        if not args.from_file or not os.path.isfile(args.from_file):
            raise SchemaError(f"no file to read: {args.from_file or 'name it with --from-file'}")
        return series.file_fetcher(args.from_file)
    if not args.url:
        raise SchemaError("an address is needed: --url, with {symbol}, {start}, {end} and {key} where they belong")
    return series.http_fetcher(args.url, args.key_variable)


def fetch(args: argparse.Namespace) -> None:
    """Bring a level series into the cache; every request is noted, also those that the cache answers."""
    spark, cache = session(), series.FileCache(args.cache)
    before = cache.summary(spark)["downloads"]
    levels, missing = series.load_series(spark, cache, _key(args), _fetcher(args), _now())
    told = cache.summary(spark)
    print(json.dumps(told | {"observations": levels.count(), "missing": missing, "was_cached": told["downloads"] == before, "damaged": cache.verify(spark)}, sort_keys=True))
    if args.out:
        kept = series.to_returns(levels) if args.as_returns else levels.withColumnRenamed("value", "ret")
        series.write_reference_csv(kept.selectExpr(f"day * {C.DAY_NS} AS period_end_ns", "ret"), args.out)


def probe_log(args: argparse.Namespace) -> None:
    spark, mapping = session(), tradelog.load_mapping(args.mapping)
    probes = tradelog.probe_trade_log(spark, args.log, mapping)
    for line in suggest.evidence_lines(tradelog.read_declarations(spark, args.log, mapping), probes, mapping):
        print(f"# {line}")
    print(suggest.symbology_draft(probes), end="")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = p.add_subparsers(required=True)
    for name, run, options in (
        ("validate", validate, (("log", {}), ("--config", {"required": True}), ("--out", {"required": True}), ("--also-json", {"action": "store_true"}))),
        ("inspect", inspect, (("log", {}),)),
        ("trials", trials, (("logs", {"nargs": "+"}), ("--config", {"required": True}), ("--out", {"required": True}))),
        ("describe", describe, (("symbol", {}), ("--file", {}), *SOURCE, ("--cache", {}), ("--risk-free-rate", {"type": float, "default": 0.0}))),
        ("fetch", fetch, (("symbol", {}), *SOURCE, ("--cache", {"required": True}), ("--as-returns", {"action": "store_true"}), ("--out", {}))),
        ("probe", probe_log, (("log", {}), ("--mapping", {"required": True}))),
    ):
        s = sub.add_parser(name)
        for flag, how in options:
            s.add_argument(flag, **how)
        s.set_defaults(run=run)
    args = p.parse_args(argv)
    try:
        args.run(args)
    except EngineError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
