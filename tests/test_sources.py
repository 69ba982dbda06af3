import json
import random
from datetime import date, time

import pytest
from pyspark.sql import functions as F

from plumbline.errors import SchemaError
from plumbline.plans.pipeline import load_config, run_validation
from plumbline.plans.report import SECTIONS, Evidence
from plumbline.sources import series, suggest, tradelog
from plumbline.sources.calendars import VenueCalendar
from plumbline.sources.symbology import load_symbology
from plumbline.sources.timeformats import inferred_format, matching_formats, parse_column

SYMBOLS = "symbols:\n  ES: {venue: CME, multiplier: 50, tick_size: 0.25, currency: usd, calendar: c, source_ids: {desk: ESZ4}}\n"
MAPPING = """source: desk
fee_convention: POSITIVE
pnl_convention: NET
pnl_source: COLUMN
timestamp_format: '%Y-%m-%d %H:%M:%S'
timezone: America/New_York
columns: {trade_id: id, symbol: name, side: dir, qty: n, entry_time: opened, exit_time: closed, entry_price: p0, exit_price: p1, fees: fee, pnl: net}
tag_columns: [setup]
"""


def write_log(path, n=200, bad=None):
    rows = ["id,name,dir,n,opened,closed,p0,p1,fee,net,setup"]
    day, k, r = date(2024, 1, 2), 0, random.Random(1)
    while k < n:
        if day.weekday() < 5:
            move = r.choice([1, 1, -1]) * 0.25 * r.randrange(1, 6)
            rows.append(f"{k},ESZ4,Long,1,{day} 10:00:00,{day} 11:00:00,100,{100 + move},2,{move * 50 - 2},{'NA' if k % 2 else 'b'}")
            k += 1
        day = date.fromordinal(day.toordinal() + 1)
    if bad:
        rows[3] = bad(rows[3])
    path.write_text("\n".join(rows) + "\n")


@pytest.fixture
def files(tmp_path):
    (tmp_path / "s.yaml").write_text(SYMBOLS)
    (tmp_path / "m.yaml").write_text(MAPPING)
    (tmp_path / "c.yaml").write_text("symbology_path: s.yaml\nmapping_path: m.yaml\ninitial_capital: 100000\nseed: 7\nn_paths: 50\nruin_barrier: 99000\n")
    write_log(tmp_path / "log.csv")
    return tmp_path


def test_import_binds_and_keeps_tags(spark, files):
    got = tradelog.read_trade_log(spark, str(files / "log.csv"), tradelog.load_mapping(str(files / "m.yaml")), load_symbology(str(files / "s.yaml")))
    assert got.currency == "USD" and got.n_rows_read == 200
    row = got.trades.orderBy(F.col("trade_id").cast("int")).first()
    assert row.symbol == "ES" and row.side == 1 and row.multiplier == 50 and row.tags == {"setup": "b"}
    assert row.entry_ns == 1704207600 * 10**9  # 10:00 in New York is 15:00 UTC


@pytest.mark.parametrize(
    ("change", "words"),
    [(lambda r: r.replace("ESZ4", "XX"), "unknown symbols: XX"), (lambda r: r.replace("Long", "Up"), "unknown sides: Up"), (lambda r: r.replace(",100,", ",x,"), "entry_px"), (lambda r: r.replace("10:00:00", "late"), "times")],
)
def test_import_refuses_what_it_cannot_read(spark, files, change, words):
    write_log(files / "log.csv", 20, change)
    with pytest.raises(SchemaError, match=words):
        tradelog.read_trade_log(spark, str(files / "log.csv"), tradelog.load_mapping(str(files / "m.yaml")), load_symbology(str(files / "s.yaml")))


def test_mapping_rules():
    for bad in (MAPPING.replace("fees: fee, ", ""), MAPPING.replace("America/New_York", "Nowhere"), MAPPING.replace("side: dir", "sides: dir"), MAPPING + "row_layout: TWO_ROWS_PER_TRADE\n"):
        with pytest.raises(SchemaError):
            tradelog.mapping_from_text(bad)


def test_two_rows_a_trade(spark, files):
    rows = ["no,leg,name,dir,at,px,n,fee,net"]
    for k in range(5):
        rows += [f"{k},Entry Long,ES,Long,2024-01-0{k + 2} 10:00:00,100,1,0,0", f"{k},Exit Long,ES,Short,2024-01-0{k + 2} 11:00:00,101,1,2,48"]
    (files / "p.csv").write_text("\n".join(rows) + "\n")
    m = tradelog.ColumnMapping("desk", {"trade_id": "no", "symbol": "name", "side": "dir", "qty": "n", "fees": "fee", "pnl": "net"}, timezone="UTC", timestamp_format="%Y-%m-%d %H:%M:%S", row_layout=tradelog.PAIRED, pair_key_column="no", leg_column="leg", entry_markers=("entry long",), exit_markers=("Exit Long",), timestamp_column="at", price_column="px")
    got = tradelog.read_trade_log(spark, str(files / "p.csv"), m, load_symbology(str(files / "s.yaml")))
    r = got.trades.orderBy("trade_id").first()
    assert got.trades.count() == 5 and (r.side, r.entry_px, r.exit_px, r.pnl) == (1, 100.0, 101.0, 48.0)
    (files / "p.csv").write_text("\n".join(rows[:-1]) + "\n")
    with pytest.raises(SchemaError, match="one entry and one exit"):
        tradelog.read_trade_log(spark, str(files / "p.csv"), m, load_symbology(str(files / "s.yaml")))


def test_whole_report(spark, files):
    report = run_validation(spark, str(files / "log.csv"), str(files / "c.yaml"), "2024-12-31T00:00:00Z")
    assert tuple(e.name for e in report.panel) == SECTIONS
    assert {"trade_metrics", "calendar_metrics", "grid_selection", "resampling", "risk_tail", "drawdown_distribution", "risk_of_ruin", "track_record"} <= set(report.sections_run)
    assert report.entry("pbo").status == "NOT_REQUESTED" and report.entry("verdict").status == "SUPPRESSED"
    assert json.loads(report.to_json())["grid"]["period"] == "DAILY" and "<table>" in report.to_html() and report.to_html().count("<svg") == 3 and "tabular" in report.to_latex()
    with pytest.raises(SchemaError):
        Evidence("x", "RAN")
    assert load_config(str(files / "c.yaml")).seed == 7


def test_clock_changes(spark):
    df = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-03-10 03:30:00",), ("2024-07-01 00:00:00",)], "s string")
    got = [r[0] for r in df.select(parse_column(F.col("s"), "%Y-%m-%d %H:%M:%S", "America/New_York")).collect()]
    assert got[0] is None and got[1] == 1710055800 * 10**9 and got[2] == 1719806400 * 10**9


def test_formats_are_tried_on_every_row(spark):
    df = spark.createDataFrame([("05/03/2024",), ("06/04/2024",)], "s string")
    both = matching_formats(df, "s")
    assert both["ambiguous"] and both["only"] is None
    assert matching_formats(df.union(spark.createDataFrame([("25/03/2024",)], "s string")), "s")["only"] == "%d/%m/%Y"
    same = spark.createDataFrame([("05/05/2024",)], "s string")
    found = matching_formats(same, "s")
    assert len(found["parsing"]) == 2 and not found["ambiguous"] and found["only"] is None  # two agree, so none is the only one


def test_stamps_without_leading_zeros(spark):
    df = spark.createDataFrame([("3/25/2024 9:30",), ("12/1/2024 10:05",)], "s string")
    assert matching_formats(df, "s")["only"] == "%m/%d/%Y %H:%M"
    assert [r[0] for r in df.select(parse_column(F.col("s"), "%m/%d/%Y %H:%M", "UTC")).collect()] == [1711359000 * 10**9, 1733047500 * 10**9]
    assert inferred_format(df, ["s"]) == "%m/%d/%Y %H:%M"
    assert inferred_format(spark.createDataFrame([("2024-03-25 09:30:00",), ("2024-03-25T09:30:00+02:00",)], "s string"), ["s"]) is None
    with pytest.raises(SchemaError, match="declare the time format"):
        inferred_format(spark.createDataFrame([("5/6/2024",)], "s string"), ["s"])


def test_a_clock_time_that_comes_twice_is_refused(spark):
    df = spark.createDataFrame([("2024-11-03 00:30:00",), ("2024-11-03 01:30:00",), ("2024-11-03 02:30:00",)], "s string")
    got = [r[0] for r in df.select(parse_column(F.col("s"), "%Y-%m-%d %H:%M:%S", "America/New_York")).collect()]
    assert got == [1730608200 * 10**9, None, 1730619000 * 10**9]


def test_probe_needs_no_times_and_no_contracts(spark, files):
    write_log(files / "log.csv", 50, lambda r: r.replace("10:00:00", "late"))
    m = tradelog.load_mapping(str(files / "m.yaml"))
    (got,) = tradelog.probe_trade_log(spark, str(files / "log.csv"), m)
    assert got["symbol"] == "ESZ4" and abs(got["implied"] - 50) < 1e-6
    lines = suggest.evidence_lines(tradelog.read_declarations(spark, str(files / "log.csv"), m), [got], m)
    assert any("NET" in x for x in lines) and any("as declared" in x for x in lines)
    assert len(tradelog.preview(spark, str(files / "log.csv"), 3)) == 3
    write_log(files / "log.csv", 20, lambda r: r.replace("Long", "Up"))
    with pytest.raises(SchemaError, match="unknown sides: Up"):
        tradelog.probe_trade_log(spark, str(files / "log.csv"), m)
    with pytest.raises(SchemaError):
        tradelog.probe_rows(tradelog.read_strings(spark, str(files / "log.csv")).drop("fee"), m)


def test_header_contests_stay_open():
    two = suggest.suggest_columns(["id", "symbol", "open price", "open price 2"])
    assert two.columns == {"trade_id": "id", "symbol": "symbol", "entry_price": "open price"}
    open_ = suggest.suggest_columns(["entry", "exit"])  # one name that several fields begin like
    assert set(open_.ambiguous) >= {"entry_price"} or "entry_time" in open_.columns


def test_reference_file_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1_700_000_000_123_456_000, 0.1), (1_700_086_400_000_000_000, -1e-9)], "period_end_ns long, ret double")
    series.write_reference_csv(rows, str(tmp_path / "r.csv"))
    got = series.read_wide_reference(spark, str(tmp_path / "r.csv"))
    assert sorted(map(tuple, got.select("period_end_ns", "ret").collect())) == sorted(map(tuple, rows.collect()))


def test_fetch_goes_through_the_cache(spark, tmp_path, capsys):
    from plumbline.cli import main

    (tmp_path / "s.csv").write_text("date,value\n" + "".join(f"{date.fromordinal(738000 + k)},{100 + (k * 7) % 13}\n" for k in range(80)))
    args = ["fetch", "x", "--cache", str(tmp_path / "c"), "--from-file", str(tmp_path / "s.csv"), "--as-returns", "--out", str(tmp_path / "r.csv")]
    assert main(args) == 0 and json.loads(capsys.readouterr().out)["was_cached"] is False
    assert main(args) == 0 and json.loads(capsys.readouterr().out)["was_cached"] is True
    assert (tmp_path / "r.csv").read_text().startswith("period_end,ret\n")
    assert main(["describe", "x", "--cache", str(tmp_path / "c"), "--from-file", str(tmp_path / "s.csv")]) == 0 and json.loads(capsys.readouterr().out)["n_observations"] == 80
    assert main(["fetch", "x", "--cache", str(tmp_path / "c"), "--source", "http"]) == 1
    with pytest.raises(SchemaError, match="no NOWHERE_KEY"):
        series.http_fetcher("http://localhost/{symbol}?{key}", "NOWHERE_KEY")(series.CacheKey("h", "d", "x", "a", "b"))
    assert series.observations_csv(b'{"observations": [{"date": "2024-01-01", "value": "."}]}') == b"date,value\n2024-01-01,.\n" and series.observations_csv(b"a,b\n") == b"a,b\n"


def test_calendar(spark):
    c = VenueCalendar("c", "America/New_York", time(16), holidays=(date(2024, 1, 3),), early_closes={date(2024, 1, 4): time(13)})
    got = [r.close_ns // 10**9 for r in c.sessions(spark, date(2024, 1, 1), date(2024, 1, 6)).orderBy("session_idx").collect()]
    assert [(x % 86400) // 3600 for x in got] == [21, 21, 18, 21] and len(got) == 4
    with pytest.raises(SchemaError):
        VenueCalendar("c", "Mars/Base", time(16))


def test_header_suggestions():
    got = suggest.suggest_columns(["Ticket", "Symbol", "Type", "Volume", "Open Time", "Close Time", "Open Price", "Close Price", "Commission", "Profit", "Magic"])
    assert got.is_complete and got.columns["entry_time"] == "Open Time" and got.unused == ("Magic",)
    assert "# side: no column" in suggest.mapping_draft("x", suggest.suggest_columns(["id"]))


def test_series_and_cache(spark, tmp_path):
    (tmp_path / "s.csv").write_text("date,value\n2024-01-01,10\n2024-01-02,.\n2024-01-03,11\n2024-01-04,12.1\n")
    got, missing = series.read_series(spark, str(tmp_path / "s.csv"), "x")
    assert missing == 1 and [round(r.ret, 6) for r in series.to_returns(got).orderBy("obs_idx").collect()] == [0.1, 0.1]
    cache, key = series.FileCache(str(tmp_path / "cache")), series.CacheKey("f", "d", "x", "a", "b")
    for _ in range(2):
        cache.get(key, series.file_fetcher(str(tmp_path / "s.csv")), "2024-01-05", 2.0)
    assert cache.summary(spark) == {"total_cost": 2.0, "downloads": 1} and cache.verify(spark) == []
    with open(cache.path_of(key), "ab") as f:
        f.write(b"x")
    assert cache.verify(spark) == [key.digest] and cache.coverage(spark).first().requests == 2


def test_wide_matrix_and_alignment(spark, tmp_path):
    (tmp_path / "t.csv").write_text("period_end,a,b\n1000,0.1,0.2\n2000,0.3,0.4\n")
    long = series.read_wide_trials(spark, str(tmp_path / "t.csv"))
    assert long.count() == 4
    with pytest.raises(SchemaError, match="1 periods"):
        series.align(spark.createDataFrame([(1000,), (3000,)], "period_end_ns long"), long)


def test_streams(spark, tmp_path):
    from plumbline.streaming.daily import daily_pnl, running_drawdown

    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00", 5.0), ("a", "2024-01-01 12:00:00", -9.0), ("a", "2024-01-03 12:00:00", 4.0), ("a", "2024-01-09 12:00:00", 1.0)], "log_id string, t string, pnl double").select("log_id", F.col("t").cast("timestamp").alias("exit_time"), "pnl")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily_pnl(stream).writeStream.format("memory").queryName("daily").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.pnl for r in spark.sql("SELECT * FROM daily ORDER BY period_start").collect()] == [-4.0, 4.0]
    periods = spark.createDataFrame([("a", "2024-01-01", 10.0), ("a", "2024-01-02", -22.0)], "log_id string, period_end string, pnl double")
    periods.write.parquet(str(tmp_path / "in2"))
    q = running_drawdown(spark.readStream.schema(periods.schema).parquet(str(tmp_path / "in2")), 100.0).writeStream.format("memory").queryName("dd").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert round(spark.sql("SELECT * FROM dd").first().max_drawdown, 6) == 0.2


def test_command_line(spark, files, capsys):
    from plumbline.cli import main

    assert main(["inspect", str(files / "log.csv")]) == 0 and "trade_id: 'id'" in capsys.readouterr().out
    assert main(["probe", str(files / "log.csv"), "--mapping", str(files / "m.yaml")]) == 0 and "the log implies 50" in capsys.readouterr().out
    (files / "s.csv").write_text("date,value\n" + "".join(f"{date.fromordinal(738000 + k)},{100 + (k * 7) % 13}\n" for k in range(80)))
    assert main(["describe", "x", "--file", str(files / "s.csv")]) == 0 and json.loads(capsys.readouterr().out)["period"] == "DAILY"
    (files / "m.yaml").write_text(MAPPING.replace("fee_convention: POSITIVE", "fee_convention: NEGATED"))
    assert main(["validate", str(files / "log.csv"), "--config", str(files / "c.yaml"), "--out", str(files / "r.json")]) == 1


def test_histogram_counts_everything(spark):
    from plumbline.plans import charts

    counts = charts.histogram(spark.range(100).selectExpr("cast(id as double) v"), "v", 10)
    assert counts == [10] * 10
    assert charts.line_chart([1.0, 2.0], "t").startswith("<svg") and "<rect" in charts.bar_chart({"a": 1.0, "b": -1.0}, "t")
