"""Import of closed trades from delimited files through a declared mapping.

A file is read as strings; names, symbols, sides, numbers and times are bound in one projection, and what can't be
read is counted in one aggregate. Rows are never dropped or merged. Strings such as NA are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..operators.validate import validate_trades
from .symbology import SymbologyMap
from .timeformats import SPARK_PATTERNS, inferred_format, parse_column

POSITIVE, NEGATED = "POSITIVE", "NEGATED"
COLUMN, DERIVE = "COLUMN", "DERIVE"
NET, GROSS = "NET", "GROSS"
ONE_ROW, PAIRED = "ONE_ROW_PER_TRADE", "TWO_ROWS_PER_TRADE"
#: The words for either side.
LONG_WORDS, SHORT_WORDS = ("long", "buy", "b", "1", "+1"), ("short", "sell", "s", "-1")
FIELDS = ("trade_id", "symbol", "side", "qty", "entry_time", "exit_time", "entry_price", "exit_price", "fees", "pnl")


@dataclass(frozen=True)
class ColumnMapping:
    """Which source column is which field, and the conventions of fees, profits, times and layout."""

    source: str
    columns: dict[str, str]
    fee_convention: str = POSITIVE
    pnl_source: str = COLUMN
    pnl_convention: str = NET
    timestamp_format: str | None = None
    timezone: str | None = None
    tag_columns: tuple[str, ...] = ()
    row_layout: str = ONE_ROW
    pair_key_column: str | None = None
    leg_column: str | None = None
    entry_markers: tuple[str, ...] = ()
    exit_markers: tuple[str, ...] = ()
    timestamp_column: str | None = None
    price_column: str | None = None
    delimiter: str = ","

    def __post_init__(self) -> None:
        if unknown := sorted(set(self.columns) - set(FIELDS)):
            raise SchemaError(f"no such fields: {', '.join(unknown)}")
        if self.timezone is not None and self.timezone not in available_timezones():
            raise SchemaError(f"no such time zone: {self.timezone}")
        for name, value, allowed in (("fee_convention", self.fee_convention, (POSITIVE, NEGATED)), ("pnl_source", self.pnl_source, (COLUMN, DERIVE)), ("pnl_convention", self.pnl_convention, (NET, GROSS)), ("row_layout", self.row_layout, (ONE_ROW, PAIRED))):
            if value not in allowed:
                raise SchemaError(f"{name} is one of {', '.join(allowed)}, got {value}")
        if missing := sorted(self.required - set(self.columns)):
            raise SchemaError(f"fields without a column: {', '.join(missing)}")
        if self.row_layout == PAIRED:
            if not all((self.pair_key_column, self.leg_column, self.entry_markers, self.exit_markers, self.timestamp_column, self.price_column)):
                raise SchemaError("paired rows need a key, a leg, its markers, a time and a price")
            if both := {m.casefold().strip() for m in self.entry_markers} & {m.casefold().strip() for m in self.exit_markers}:
                raise SchemaError(f"markers of both legs: {', '.join(sorted(both))}")

    @property
    def required(self) -> set[str]:
        need = set(FIELDS) - ({"pnl"} if self.pnl_source == DERIVE else set())
        return need - ({"entry_time", "exit_time", "entry_price", "exit_price"} if self.row_layout == PAIRED else set())


def load_mapping(path: str) -> ColumnMapping:
    with open(path, encoding="utf-8") as f:
        return mapping_from_text(f.read())


def mapping_from_text(text: str) -> ColumnMapping:
    import yaml

    raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise SchemaError("a mapping is a table of names")
    raw = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    raw["columns"] = {k: v for k, v in (raw.get("columns") or {}).items()}
    upper = ("fee_convention", "pnl_source", "pnl_convention", "row_layout")
    try:
        return ColumnMapping(**{k: str(v).upper() if k in upper else v for k, v in raw.items()})
    except TypeError as e:
        raise SchemaError(f"mapping: {e}") from e


@dataclass(frozen=True)
class ImportResult:
    trades: DataFrame
    currency: str
    calendars: list[str]
    n_rows_read: int
    warnings: list[str] = field(default_factory=list)


def read_strings(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as strings, nothing inferred."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, nullValue=None, emptyValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def pair_legs(rows: DataFrame, m: ColumnMapping) -> DataFrame:
    """Two rows a trade become one: values of the exit leg, side, time and price of entry from the entry leg."""
    leg = F.lower(F.trim(F.col(m.leg_column)))
    is_in, is_out = leg.isin([x.casefold().strip() for x in m.entry_markers]), leg.isin([x.casefold().strip() for x in m.exit_markers])
    if unknown := [r[0] for r in rows.where(~F.coalesce(is_in | is_out, F.lit(False))).select(m.leg_column).distinct().orderBy(m.leg_column).limit(10).collect()]:
        raise SchemaError(f"unknown legs: {', '.join(map(str, unknown))}")
    bad = rows.groupBy(m.pair_key_column).agg(F.count_if(is_in).alias("i"), F.count_if(is_out).alias("o")).where("i <> 1 OR o <> 1")
    if found := [r[0] for r in bad.orderBy(m.pair_key_column).limit(5).collect()]:
        raise SchemaError(f"trades without one entry and one exit: {', '.join(map(str, found))}")
    entry = rows.where(is_in).select(F.col(m.pair_key_column).alias("_key"), F.col(m.timestamp_column).alias("_entry_time"), F.col(m.price_column).alias("_entry_price"), F.col(m.columns["side"]).alias("_side"))
    both = rows.where(is_out).join(entry, F.col(m.pair_key_column) == F.col("_key"))
    return both.withColumn("_exit_time", F.col(m.timestamp_column)).withColumn("_exit_price", F.col(m.price_column))


def parse_side(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*LONG_WORDS), 1).when(word.isin(*SHORT_WORDS), -1).cast("byte")


def bind(rows: DataFrame, m: ColumnMapping, symbols: SymbologyMap, log_id: str = "log") -> tuple[DataFrame, list[str]]:
    """Canonical trades; every cell that can't be read is refused with its column and count."""
    cols = dict(m.columns)
    if m.row_layout == PAIRED:
        rows = pair_legs(rows, m)
        cols |= {"entry_time": "_entry_time", "exit_time": "_exit_time", "entry_price": "_entry_price", "exit_price": "_exit_price", "side": "_side"}
    if missing := sorted(v for v in {*cols.values(), *m.tag_columns} if v not in rows.columns):
        raise SchemaError(f"columns not in the file: {', '.join(missing)}")
    col = lambda f: F.col(f"`{cols[f]}`")
    number = lambda f: F.trim(col(f)).try_cast("double")
    pattern = m.timestamp_format or inferred_format(rows, [cols["entry_time"], cols["exit_time"]])
    spec = symbols.as_map(m.source)
    found = F.try_element_at(spec, F.trim(col("symbol"))) if spec is not None else F.lit(None)
    fees = -number("fees") if m.fee_convention == NEGATED else number("fees")
    warnings: list[str] = []
    out = rows.select(
        F.lit(log_id).alias("log_id"), F.trim(col("trade_id")).alias("trade_id"), F.trim(col("symbol")).alias("_raw_symbol"), found.canonical.alias("symbol"), F.trim(col("side")).alias("_raw_side"), parse_side(col("side")).alias("side"),
        number("qty").alias("qty"), found.multiplier.alias("multiplier"), parse_column(col("entry_time"), pattern, m.timezone).alias("entry_ns"), parse_column(col("exit_time"), pattern, m.timezone).alias("exit_ns"),
        number("entry_price").alias("entry_px"), number("exit_price").alias("exit_px"), (F.lit(0.0) + fees).alias("fees"), *([number("pnl").alias("_pnl")] if "pnl" in cols else [F.lit(0.0).alias("_pnl")]),
        (F.create_map(*[x for t in m.tag_columns for x in (F.lit(t), F.col(f"`{t}`"))]) if m.tag_columns else F.create_map().cast("map<string,string>")).alias("tags"),
    )
    gross = F.col("side") * (F.col("exit_px") - F.col("entry_px")) * F.col("qty") * F.col("multiplier")
    if m.pnl_source == DERIVE:
        pnl = gross - F.col("fees")
        warnings.append("profits are derived from prices, so the coherence check can't fail")
    else:
        pnl = F.col("_pnl") - F.col("fees") if m.pnl_convention == GROSS else F.col("_pnl")
    checks = ("qty", "entry_px", "exit_px", "fees", "_pnl")
    bad = out.agg(
        F.count("*").alias("n"), *[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in checks], F.count_if(F.col("entry_ns").isNull() | F.col("exit_ns").isNull()).alias("times"),
        F.count_if(F.col("side").isNull()).alias("sides"), F.count_if(F.col("symbol").isNull()).alias("symbols"),
    ).first()
    if not bad.n:
        raise SchemaError("the file has no rows")
    if bad.symbols:
        names = [r[0] for r in out.where("symbol IS NULL").select("_raw_symbol").distinct().orderBy("_raw_symbol").limit(10).collect()]
        raise SchemaError(f"unknown symbols: {', '.join(map(str, names))}")
    if bad.sides:
        names = [r[0] for r in out.where("side IS NULL").select("_raw_side").distinct().orderBy("_raw_side").limit(10).collect()]
        raise SchemaError(f"unknown sides: {', '.join(map(str, names))}")
    for c in (*checks, "times"):
        if bad[c]:
            raise SchemaError(f"{bad[c]} cells of {c.strip('_')} can't be read")
    kept = [c for c in out.columns if not c.startswith("_")]
    return out.withColumn("gross_pnl", gross).withColumn("pnl", pnl).select(*kept, "gross_pnl", "pnl"), warnings


def read_trade_log(spark: SparkSession, path: str, mapping: ColumnMapping, symbology: SymbologyMap, log_id: str = "log", rtol: float = 1e-6) -> ImportResult:
    rows = read_strings(spark, path, mapping.delimiter)
    trades, warnings = bind(rows, mapping, symbology, log_id)
    used = [r[0] for r in trades.select("symbol").distinct().collect()]  # a row a symbol
    currency = symbology.require_single_currency(used)
    validate_trades(trades, {s: symbology.symbols[s].tick_size for s in used}, rtol)
    return ImportResult(trades, currency, sorted({symbology.symbols[s].calendar for s in used}), rows.count(), warnings)


def probe_rows(rows: DataFrame, m: ColumnMapping) -> DataFrame:
    """(row_no, symbol, side, qty, entry_px, exit_px, fees, pnl) of a log whose contracts aren't known yet.

    Nothing is validated and times aren't read, so a log can be probed while its mapping is still in the making.
    """
    cols = dict(m.columns)
    if m.row_layout == PAIRED:
        rows = pair_legs(rows, m)
        cols |= {"entry_price": "_entry_price", "exit_price": "_exit_price", "side": "_side"}
    needed = ("symbol", "side", "qty", "entry_price", "exit_price", "fees", "pnl")
    if absent := [f for f in needed if f not in cols]:
        raise SchemaError(f"a multiplier can't be read without {', '.join(absent)}")
    if missing := [cols[f] for f in needed if cols[f] not in rows.columns]:
        raise SchemaError(f"columns not in the file: {', '.join(missing)}")
    col = lambda f: F.trim(F.col(f"`{cols[f]}`"))
    number = lambda f: col(f).try_cast("double")
    fees = -number("fees") if m.fee_convention == NEGATED else number("fees")
    out = rows.select(
        F.monotonically_increasing_id().alias("row_no"), col("symbol").alias("symbol"), col("side").alias("_word"), parse_side(col("side")).alias("side"), number("qty").alias("qty"),
        number("entry_price").alias("entry_px"), number("exit_price").alias("exit_px"), (F.lit(0.0) + fees).alias("fees"), number("pnl").alias("pnl"),
    )
    if unknown := [r[0] for r in out.where("side IS NULL").select("_word").distinct().orderBy("_word").limit(10).collect()]:
        raise SchemaError(f"unknown sides: {', '.join(map(str, unknown))}")
    return out.drop("_word")


def probe_trade_log(spark: SparkSession, path: str, m: ColumnMapping) -> list[dict]:
    """``probe_symbols`` of a file, without an import."""
    from ..operators.probe import probe_symbols

    return probe_symbols(probe_rows(read_strings(spark, path, m.delimiter), m))


def preview(spark: SparkSession, path: str, rows: int = 5, delimiter: str = ",") -> list[dict]:
    """The first rows of a file as they stand."""
    return [r.asDict() for r in read_strings(spark, path, delimiter).limit(rows).collect()]


def read_declarations(spark: SparkSession, path: str, m: ColumnMapping) -> dict:
    """What a file shows of its own: the sign of its fees, its first stamps, and whether the declared format reads them."""
    rows = read_strings(spark, path, m.delimiter)
    fee = F.trim(F.col(f"`{m.columns['fees']}`")).try_cast("double")
    low, high = rows.agg(F.min(fee), F.max(fee)).first()
    sign = "ZERO" if not low and not high else "POSITIVE" if low >= 0 else "NEGATIVE" if high <= 0 else "MIXED"
    stamps = [m.timestamp_column] * 2 if m.row_layout == PAIRED else [m.columns["entry_time"], m.columns["exit_time"]]
    first = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys(stamps)]).first()
    if first is None:
        raise SchemaError("the file has no rows")
    values = [first[c] for c in stamps]
    reads = spark.createDataFrame([(v,) for v in values], "v string").select(parse_column(F.col("v"), m.timestamp_format, m.timezone).alias("t")).where("t IS NULL").count() == 0
    return {"fee_sign": sign, "first_entry": values[0], "first_exit": values[1], "format_reads_them": reads, "known_patterns": len(SPARK_PATTERNS)}


def zone_of(m: ColumnMapping) -> ZoneInfo | None:
    return ZoneInfo(m.timezone) if m.timezone else None
