"""Queries that go through files: the star-schema log is exported, then imported, probed and declared anew.

Files lie in the shared folder. The oracle never sees them: it computes the same rows from the tables.
"""

from __future__ import annotations

import os
import uuid
from datetime import date, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.staging import shared_folder
from ..operators import grid, probe, validate
from ..sources import calendars, series, timeformats, tradelog
from ..sources.symbology import SymbologyMap, SymbolSpec
from . import registry
from .pipeline import sha256_of
from .registry import query_of as query

#: Contracts by the number of a brand.
MULTIPLIER = "CASE WHEN CAST(substr(symbol, 7) AS INT) % 2 = 0 THEN 50e0 ELSE 20e0 END"
BRANDS = [f"Brand#{k}" for k in range(1, 26)]
SOURCE = "desk"
SYMBOLS = SymbologyMap({b: SymbolSpec("V", 50.0 if int(b[6:]) % 2 == 0 else 20.0, 0.01, "usd", "weekdays", source_ids={SOURCE: f"x-{b}"}) for b in BRANDS})
ONE_ROW = tradelog.ColumnMapping(
    SOURCE, {"trade_id": "id", "symbol": "name", "side": "dir", "qty": "n", "entry_time": "opened", "exit_time": "closed", "entry_price": "p0", "exit_price": "p1", "fees": "fee", "pnl": "gross"},
    fee_convention="NEGATED", pnl_convention="GROSS", timestamp_format="%d.%m.%Y %H:%M:%S", timezone="Etc/GMT+5", tag_columns=("setup",),
)
TWO_ROWS = tradelog.ColumnMapping(
    SOURCE, {"trade_id": "id", "symbol": "name", "side": "dir", "qty": "n", "fees": "fee", "pnl": "gross"}, fee_convention="NEGATED", pnl_convention="GROSS", timezone="Etc/GMT+5",
    row_layout="TWO_ROWS_PER_TRADE", pair_key_column="id", leg_column="leg", entry_markers=("In",), exit_markers=("Out",), timestamp_column="at", price_column="px",
)

#: The stand-in log with one multiplier a symbol, profits before fees and exact to the cent.
PLAIN = f"""
SELECT trade_id, symbol, side, qty, entry_ns, exit_ns, entry_px, exit_px, fees, mult, round(side * (exit_px - entry_px) * qty * mult, 4) AS gross, CASE WHEN qty > 25 THEN 'NA' ELSE 'late' END AS setup
FROM (SELECT *, {MULTIPLIER} AS mult FROM {{trades}}) t"""
plain = registry.R("plain", PLAIN, (registry.trades,))


def folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    return path


def local(path: str) -> str:
    """For files that the driver writes itself."""
    out = path.removeprefix("file://")
    os.makedirs(os.path.dirname(out), exist_ok=True)
    return out


def _stamp(ns: str, padded: bool = False) -> str:
    """Clock time of an instant as the desk writes it, without leading zeros, or as ISO 8601 without an offset."""
    day, hour = f"date_from_unix_date(CAST({ns} div 86400000000000 AS INT))", f"({ns} div 3600000000000) % 24"
    if padded:
        return f"CAST({day} AS STRING) || ' ' || lpad(CAST({hour} AS STRING), 2, '0') || ':00:00'"
    return f"CAST(day({day}) AS STRING) || '.' || CAST(month({day}) AS STRING) || '.' || CAST(year({day}) AS STRING) || ' ' || CAST({hour} AS STRING) || ':00:00'"


def export_one_row(spark: SparkSession, sf_dir: str) -> str:
    rows = plain.frame(spark, sf_dir).selectExpr(
        "trade_id AS id", "'x-' || symbol AS name", "CASE WHEN side > 0 THEN ' Buy' ELSE 'SHORT' END AS dir", "CAST(qty AS STRING) AS n", f"{_stamp('entry_ns')} AS opened", f"{_stamp('exit_ns')} AS closed",
        "CAST(entry_px AS STRING) AS p0", "CAST(exit_px AS STRING) AS p1", "CAST(-fees AS STRING) AS fee", "CAST(gross AS STRING) AS gross", "setup",
    )
    path = folder(spark, "log")
    rows.write.csv(path, header=True)
    return path


def export_two_rows(spark: SparkSession, sf_dir: str) -> str:
    t = plain.frame(spark, sf_dir)
    common = ["trade_id AS id", "'x-' || symbol AS name", "CAST(qty AS STRING) AS n", "CAST(-fees AS STRING) AS fee", "CAST(gross AS STRING) AS gross"]
    leg = lambda word, turn, ns, px: t.selectExpr(*common, f"'{word}' AS leg", f"CASE WHEN {turn} * side > 0 THEN 'buy' ELSE 'sell' END AS dir", f"{_stamp(ns, True)} AS at", f"CAST({px} AS STRING) AS px")
    path = folder(spark, "legs")
    leg("in", 1, "entry_ns", "entry_px").unionByName(leg(" OUT", -1, "exit_ns", "exit_px")).write.csv(path, header=True)
    return path


PLAIN_DUCK = plain.duck()

IMPORTED = f"""
SELECT trade_id, symbol, side, qty, mult AS multiplier, entry_ns + 18000000000000 AS entry_ns, exit_ns + 18000000000000 AS exit_ns, entry_px, exit_px, fees, gross - fees AS pnl, setup, 'USD' AS currency
FROM ({PLAIN_DUCK}) p"""


@query("import_one_row", IMPORTED, "trade_id", "symbol", "CAST(side AS INT) AS side", "entry_ns", "exit_ns", "setup", "currency", qty=6, multiplier=6, entry_px=6, exit_px=6, fees=6, pnl=3)
def import_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tradelog.read_trade_log(spark, export_one_row(spark, sf_dir), ONE_ROW, SYMBOLS)
    return got.trades.withColumn("setup", F.col("tags")["setup"]).withColumn("currency", F.lit(got.currency))


@query("import_paired_legs", IMPORTED, "trade_id", "symbol", "CAST(side AS INT) AS side", "entry_ns", "exit_ns", "currency", qty=6, multiplier=6, entry_px=6, exit_px=6, fees=6, pnl=3)
def import_paired_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tradelog.read_trade_log(spark, export_two_rows(spark, sf_dir), TWO_ROWS, SYMBOLS)
    return got.trades.withColumn("currency", F.lit(got.currency))


JUDGED_DUCK = f"""
WITH p AS ({PLAIN_DUCK}), q AS (
  SELECT max(step) AS quantum FROM (SELECT step, max(abs(gross / step - round_even(gross / step, 0))) AS off, max(abs(gross / step)) AS big FROM p, (SELECT unnest(list_transform(range(-6, 9), lambda k: 10.0 ** (-k))) AS step) s GROUP BY step) x
  WHERE off <= greatest(1e-9 * greatest(1, big), 1e-6)),
m AS (SELECT 'x-' || symbol AS symbol, gross, fees, side * (exit_px - entry_px) * qty AS move FROM p),
s AS (SELECT symbol, count(*) FILTER (move <> 0) AS n_usable, list_sort(list((gross + fees) / move) FILTER (move <> 0)) AS net, list_sort(list(gross / move) FILTER (move <> 0)) AS gro,
             median(abs(gross)) FILTER (move <> 0) AS typical_pnl, median(fees) AS fee, max(fees) AS top FROM m GROUP BY symbol),
k AS (SELECT *, quantile_cont(1, 0.5) AS one, list_aggregate(net, 'quantile_cont', [0.25, 0.5, 0.75]) AS a, list_aggregate(gro, 'quantile_cont', [0.25, 0.5, 0.75]) AS b FROM s GROUP BY ALL)
SELECT symbol, n_usable, a[2] AS implied_net, b[2] AS implied_gross, abs((a[3] - a[1]) / a[2]) AS spread_net, abs((b[3] - b[1]) / b[2]) AS spread_gross, typical_pnl, quantum AS pnl_quantum,
       CASE WHEN top = 0 THEN 'NO_COST' WHEN fee < quantum THEN 'UNDETECTABLE' ELSE 'DECISIVE' END AS detectability,
       CASE WHEN quantum <= typical_pnl / 4 THEN CASE WHEN abs((a[3] - a[1]) / a[2]) <= abs((b[3] - b[1]) / b[2]) THEN a[2] ELSE b[2] END END AS implied,
       CASE WHEN top > 0 AND fee >= quantum THEN CASE WHEN abs((a[3] - a[1]) / a[2]) <= abs((b[3] - b[1]) / b[2]) THEN 'NET' ELSE 'GROSS' END END AS convention
FROM k, q"""


@query("probe_log", JUDGED_DUCK, "symbol", "n_usable", "detectability", "convention", implied_net=6, implied_gross=6, spread_net=6, spread_gross=6, typical_pnl=5, pnl_quantum=9, implied=6)
def probe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.judged_symbols(tradelog.probe_rows(tradelog.read_strings(spark, export_one_row(spark, sf_dir)), ONE_ROW))


QUANTA = {"cents": "round(l_extendedprice, 2)", "hundreds": "round(l_quantity) * 100e0", "whole": "l_quantity", "tenths": "l_quantity / 10e0", "quarters": "l_quantity / 4e0", "nothing": "l_quantity * 0e0"}
QUANTA_DUCK = " UNION ALL ".join(
    f"SELECT '{name}' AS name, coalesce((SELECT max(step) FROM (SELECT step, bool_and(abs(v / step - round_even(v / step, 0)) <= 1e-6 + 1e-9 * abs(v / step)) AS ok FROM (SELECT {sql} AS v FROM lineitem) x, (SELECT unnest(list_transform(range(-6, 9), lambda k: 10.0 ** (-k))) AS step) s GROUP BY step HAVING max(abs(v)) > 0) y WHERE ok), 0) AS quantum"
    for name, sql in QUANTA.items()
)


@query("pnl_quantum", QUANTA_DUCK, "name", quantum=9)
def pnl_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return spark.createDataFrame([(name, probe.quantum_of(items.selectExpr(f"{sql} AS v"), "v")) for name, sql in QUANTA.items()], "name string, quantum double")


@query(
    "read_declarations",
    f"SELECT CASE WHEN min(-fees) >= 0 THEN 'POSITIVE' WHEN max(-fees) <= 0 THEN 'NEGATIVE' ELSE 'MIXED' END AS fee_sign, strftime(make_timestamp(min(entry_ns) // 1000), '%-d.%-m.%Y %-H:%M:%S') AS first_entry, true AS format_reads_them FROM ({PLAIN_DUCK}) p",
    "fee_sign", "first_entry", "format_reads_them",
)
def read_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "first")
    rows = tradelog.read_strings(spark, export_one_row(spark, sf_dir))
    rows.withColumn("at", timeformats.parse_column(F.col("opened"), ONE_ROW.timestamp_format, "UTC")).orderBy("at", "id").drop("at").coalesce(1).write.csv(path, header=True)  # a file in order, as a desk writes it
    got = tradelog.read_declarations(spark, path, ONE_ROW)
    return spark.createDataFrame([(got["fee_sign"], got["first_entry"], got["format_reads_them"])], "fee_sign string, first_entry string, format_reads_them boolean")


@query("trials_through_a_file", f"SELECT config_id, period_end_ns, ret FROM ({registry.trials.duck()}) t", "config_id", "period_end_ns", ret=9)
def trials_through_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "trials")
    grid.wide_trials(registry.trials.frame(spark, sf_dir).select("config_id", "period_end_ns", "ret")).write.csv(path, header=True)
    return series.read_wide_trials(spark, path)


@query("reference_through_a_file", f"SELECT period_end_ns // 1000 * 1000 AS period_end_ns, ret FROM ({registry.weekly.duck()}) w", "period_end_ns", ret=9)
def reference_through_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a reference, read back and aligned with the log's own periods, exactly."""
    path = folder(spark, "reference")
    weekly = registry.weekly.frame(spark, sf_dir).selectExpr("period_end_ns div 1000 * 1000 AS period_end_ns", "ret")
    series.write_reference_csv(weekly, local(path))
    return series.align(weekly, series.read_wide_reference(spark, path))


LEVELS = "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, sum(abs(value)) + 1e0 AS level FROM {events} WHERE event_type IN (SELECT min(event_type) FROM {events}) GROUP BY CAST(CAST(ts AS DATE) AS STRING)"
day_levels = registry.R("levels", LEVELS)
LEVELS_DUCK = "SELECT CAST(ts AS DATE) AS d, sum(abs(value)) + 1 AS level FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1"


def cached_levels(spark: SparkSession, sf_dir: str) -> tuple[series.FileCache, DataFrame, int]:
    """A level series as a file with one gap, loaded twice through a cache."""
    base = folder(spark, "levels")
    rows = day_levels.frame(spark, sf_dir).orderBy("day").collect()  # some days
    with open(local(f"{base}/levels.csv"), "w", encoding="utf-8") as f:
        f.write("date,value\n" + "".join(f"{r.day},{r.level!r}\n" for r in rows) + "2999-01-01,.\n")
    cache, key = series.FileCache(local(f"{base}/cache/x").rpartition("/")[0]), series.CacheKey("file", "levels", "first", "a", "b")
    for stamp in ("2024-01-01", "2024-01-02"):
        levels, missing = series.load_series(spark, cache, key, series.file_fetcher(local(f"{base}/levels.csv")), stamp)
    return cache, levels, missing


@query("level_series_returns", f"SELECT k - 1 AS obs_idx, date_diff('day', DATE '1970-01-01', d) AS day, ret FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, level / lag(level) OVER (ORDER BY d) - 1 AS ret FROM ({LEVELS_DUCK}) l) x WHERE ret IS NOT NULL", "CAST(obs_idx AS BIGINT) AS obs_idx", "CAST(day AS BIGINT) AS day", ret=9)
def level_series_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_returns(cached_levels(spark, sf_dir)[1])


@query("level_series_periods", f"SELECT 'first' AS log_id, k - 2 AS period_idx, date_diff('day', DATE '1970-01-01', d) * 86400000000000 AS period_end_ns, 1 AS n_trades, ret FROM (SELECT d, row_number() OVER (ORDER BY d) AS k, level / lag(level) OVER (ORDER BY d) - 1 AS ret FROM ({LEVELS_DUCK}) l) x WHERE ret IS NOT NULL", "log_id", "CAST(period_idx AS BIGINT) AS period_idx", "period_end_ns", "n_trades", ret=9)
def level_series_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.to_period_returns(cached_levels(spark, sf_dir)[1])


@query("cache_coverage", f"SELECT 'first' AS symbol, 2 AS requests, 1 AS downloads, 1 AS missing, 0 AS damaged, count(*) AS n FROM ({LEVELS_DUCK}) l", "symbol", "CAST(requests AS BIGINT) AS requests", "CAST(downloads AS BIGINT) AS downloads", "CAST(missing AS BIGINT) AS missing", "CAST(damaged AS BIGINT) AS damaged", "CAST(n AS BIGINT) AS n")
def cache_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, levels, missing = cached_levels(spark, sf_dir)
    told = cache.summary(spark)
    return cache.coverage(spark).select("symbol", "requests").withColumns({"downloads": F.lit(told["downloads"]), "missing": F.lit(missing), "damaged": F.lit(len(cache.verify(spark))), "n": F.lit(levels.count())})


@query(
    "venue_sessions",
    "SELECT k - 1 AS session_idx, coalesce(lag(ns) OVER (ORDER BY ns), ns - 86400000000000) AS prev_close_ns, ns AS close_ns FROM (SELECT row_number() OVER (ORDER BY d) AS k, CAST(epoch(d) AS BIGINT) * 1000000000 + CASE WHEN strftime(d, '%m-%d') = '12-24' THEN 18 ELSE 21 END * 3600000000000 AS ns FROM (SELECT unnest(generate_series(DATE '2020-12-01', DATE '2021-01-31', INTERVAL 1 DAY)) AS d) x WHERE isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('12-25', '01-01')) s",
    "CAST(session_idx AS BIGINT) AS session_idx", "prev_close_ns", "close_ns",
)
def venue_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winter sessions of a venue five hours behind, with holidays and an early close."""
    venue = calendars.VenueCalendar("c", "America/New_York", time(16), holidays=(date(2020, 12, 25), date(2021, 1, 1)), early_closes={date(2020, 12, 24): time(13)})
    return venue.sessions(spark, date(2020, 12, 1), date(2021, 1, 31))


FORMS = {"day_first": ("d/M/yyyy", "%-d/%-m/%Y"), "month_first": ("M/d/yyyy", "%-m/%-d/%Y"), "dotted": ("d.M.yyyy HH:mm", "%-d.%-m.%Y %H:%M"), "together": ("yyyyMMdd", "%Y%m%d")}
MATCHES_DUCK = " UNION ALL ".join(f"SELECT '{name}' AS form, '{p}' AS pattern FROM orders HAVING count(*) = count(try_strptime(strftime(o_orderdate, '{duck}'), '{p}'))" for name, (_, duck) in FORMS.items() for p in timeformats.PATTERNS)


@query("time_formats", MATCHES_DUCK, "form", "pattern")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = [(name, p) for name, (form, _) in FORMS.items() for p in timeformats.matching_formats(orders.select(F.date_format("o_orderdate", form).alias("s")), "s")["parsing"]]
    return spark.createDataFrame(out, "form string, pattern string")


#: How each check is broken in one trade, and the refusal that must follow.
BROKEN = {
    "exit before entry": ("exit_ns", "entry_ns - 1", "TradeIntegrityError"), "no size": ("qty", "0e0", "TradeIntegrityError"), "negative fee": ("fees", "-1e0", "TradeIntegrityError"), "not a number": ("entry_px", "double('NaN')", "TradeIntegrityError"),
    "infinite": ("pnl", "double('Infinity')", "TradeIntegrityError"), "wrong profit": ("pnl", "pnl + 1000e0", "TradeIntegrityError"), "unknown symbol": ("symbol", "'nowhere'", "SchemaError"), "repeated id": ("trade_id", "(SELECT max(trade_id) FROM {good})", "TradeIntegrityError"),
    "nothing broken": ("qty", "qty", "none"),
}


@query("refused_logs", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v[2]}')" for k, v in [*BROKEN.items(), ("empty log", ("", "", "InsufficientSampleError"))]) + ") v(broken, refusal)", "broken", "refusal")
def refused_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = plain.frame(spark, sf_dir).selectExpr("trade_id", "symbol", "side", "qty", "mult AS multiplier", "entry_ns", "exit_ns", "entry_px", "exit_px", "fees", "gross - fees AS pnl")
    first = good.agg(F.min("trade_id")).first()[0]
    cases = {k: spark.sql("SELECT " + ", ".join(f"CASE WHEN trade_id = '{first}' THEN {v} ELSE {c} END AS {c}" if c == col else c for c in good.columns) + " FROM {good}", good=good) for k, (col, v, _) in BROKEN.items()}
    out = []
    for name, rows in (cases | {"empty log": good.limit(0)}).items():
        try:
            validate.validate_trades(rows, SYMBOLS.tick_sizes())
            out.append((name, "none"))
        except EngineError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "broken string, refusal string")


@query("offending_trades", f"SELECT string_agg(trade_id, ', ' ORDER BY trade_id) || ', ...' AS shown FROM (SELECT trade_id FROM ({PLAIN_DUCK}) p WHERE qty > 10 ORDER BY trade_id LIMIT 5) x", "shown")
def offending_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(validate.offenders(plain.frame(spark, sf_dir), F.col("qty") > 10),)], "shown string")


@query("sha256_of_a_file", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_name) || chr(10)) AS digest FROM region", "digest")
def sha256_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").orderBy("r_name").collect()]
    path = local(folder(spark, "names"))
    with open(path, "wb") as f:
        f.write("".join(f"{n}\r\n" for n in names).encode())
    return spark.createDataFrame([(sha256_of(path),)], "digest string")
