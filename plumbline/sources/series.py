"""Level series: two-column files, returns, and a cache of fetched files with a manifest."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, SchemaError
from .tradelog import read_strings


def read_series(spark: SparkSession, path: str, series_id: str, delimiter: str = ",") -> tuple[DataFrame, int]:
    """((series_id, obs_idx, day, value), missing): dates must all read, cells without a number are dropped and counted."""
    rows = read_strings(spark, path, delimiter)
    if len(rows.columns) < 2:
        raise SchemaError("a series has a date and a value")
    d, v = (F.trim(F.col(f"`{c}`")) for c in rows.columns[:2])
    typed = rows.select(F.unix_date(F.substring(d, 1, 10).try_cast("date")).cast("long").alias("day"), v.try_cast("double").alias("value"))
    n, bad, missing = typed.agg(F.count("*"), F.count_if(F.col("day").isNull()), F.count_if(F.col("value").isNull() | F.isnan("value"))).first()
    if bad:
        raise SchemaError(f"{bad} dates of {series_id} can't be read")
    if n == missing:
        raise InsufficientSampleError(f"{series_id} has no usable observation", 0, 1)
    kept = typed.where(F.col("value").isNotNull() & ~F.isnan("value"))
    w = Window.orderBy("day")  # one series: some thousand rows
    out = kept.select(F.lit(series_id).alias("series_id"), (F.row_number().over(w) - 1).alias("obs_idx"), "day", "value")
    if out.groupBy("day").count().where("count > 1").limit(1).count():
        raise SchemaError(f"dates of {series_id} repeat")
    return out, missing


def to_returns(series: DataFrame) -> DataFrame:
    """Simple returns; the first row has none. A level of zero is refused."""
    if series.where("value = 0").limit(1).count():
        raise SchemaError("a level of zero has no return")
    w = Window.partitionBy("series_id").orderBy("obs_idx")
    out = series.select("series_id", "obs_idx", "day", (F.col("value") / F.lag("value").over(w) - 1).alias("ret"))
    return out.where("ret IS NOT NULL")


def to_period_returns(series: DataFrame) -> DataFrame:
    """Returns in the shape of a log's periods; every period counts as active."""
    if series.where("value <= 0").limit(1).count():
        raise SchemaError("levels must be positive")
    return to_returns(series).select(F.col("series_id").alias("log_id"), (F.col("obs_idx") - 1).alias("period_idx"), (F.col("day") * C.DAY_NS).alias("period_end_ns"), F.lit(1).alias("n_trades"), "ret")


def align(grid: DataFrame, source: DataFrame, key: str = "period_end_ns") -> DataFrame:
    """Rows of ``source`` for exactly the periods of ``grid``; a period without its row is refused, further rows are left."""
    if lost := grid.join(source, key, "left_anti").count():
        raise SchemaError(f"{lost} periods are missing in the series")
    return source.join(grid.select(key).distinct(), key)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last one read."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in others])


def read_wide_trials(spark: SparkSession, path: str) -> DataFrame:
    """(config_id, period_end_ns, ret) from a file with a stamp and a column for each of at least two configurations."""
    rows = read_strings(spark, path)
    if len(rows.columns) < 3:
        raise SchemaError("a matrix of trials has a stamp and two configurations at least")
    stamp, *names = rows.columns
    ns = F.coalesce(F.col(f"`{stamp}`").try_cast("bigint"), F.unix_micros(F.col(f"`{stamp}`").try_cast("timestamp")) * 1000)
    wide = rows.select(ns.alias("period_end_ns"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names])
    long = wide.unpivot(["period_end_ns"], [f"`{c}`" for c in names], "config_id", "ret")
    if bad := long.where("ret IS NULL OR period_end_ns IS NULL").count():
        raise SchemaError(f"{bad} cells of the matrix can't be read")
    return long


@dataclass(frozen=True)
class CacheKey:
    source: str
    dataset: str
    symbol: str
    start: str
    end: str

    @property
    def digest(self) -> str:
        return hashlib.sha256("\n".join(asdict(self).values()).encode()).hexdigest()[:32]


class FileCache:
    """Read-through store of payloads that never change; each request, hit or miss, adds a line to the manifest."""

    def __init__(self, root: str):
        self.root = root
        self.manifest_path = os.path.join(root, "manifest.jsonl")

    def path_of(self, key: CacheKey) -> str:
        return os.path.join(self.root, "raw", f"{key.digest}.bin")

    def get(self, key: CacheKey, fetch: Callable[[CacheKey], bytes], recorded_at: str, cost: float = 0.0) -> bytes:
        path, hit = self.path_of(key), os.path.exists(self.path_of(key))
        if hit:
            with open(path, "rb") as f:
                payload = f.read()
        else:
            payload = fetch(key)
            if not payload:
                raise SchemaError(f"{key.source} gave nothing for {key.symbol}")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.part", "wb") as f:
                f.write(payload)
            os.replace(f"{path}.part", path)
        line = asdict(key) | {"digest": key.digest, "hit": hit, "recorded_at": recorded_at, "cost": 0.0 if hit else cost, "sha256": hashlib.sha256(payload).hexdigest()}
        with open(self.manifest_path, "a", encoding="utf-8") as f:
            f.write(json.dumps(line, sort_keys=True) + "\n")
        return payload

    def manifest(self, spark: SparkSession) -> DataFrame:
        schema = "source string, dataset string, symbol string, start string, end string, digest string, hit boolean, recorded_at string, cost double, sha256 string"
        return spark.read.schema(schema).json(self.manifest_path) if os.path.exists(self.manifest_path) else spark.createDataFrame([], schema)

    def summary(self, spark: SparkSession) -> dict:
        row = self.manifest(spark).agg(F.coalesce(F.sum("cost"), F.lit(0.0)), F.count_if(~F.col("hit"))).first()
        return {"total_cost": row[0], "downloads": row[1]}

    def coverage(self, spark: SparkSession) -> DataFrame:
        return self.manifest(spark).groupBy("source", "dataset", "symbol", "start", "end").agg(F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"), F.count("*").alias("requests"))

    def verify(self, spark: SparkSession) -> list[str]:
        """Digests whose file is gone or no longer hashes to what the manifest says."""
        told = self.manifest(spark).select("digest", "sha256").distinct()
        files = spark.read.format("binaryFile").load(os.path.join(self.root, "raw")).select(F.regexp_extract("path", r"([0-9a-f]{32})\.bin$", 1).alias("digest"), F.sha2("content", 256).alias("found"))
        return [r[0] for r in told.join(files, "digest", "left").where("found IS NULL OR found <> sha256").select("digest").distinct().orderBy("digest").collect()]


def reference_csv(returns: DataFrame) -> DataFrame:
    """(period_end, ret) as text, the form that ``read_wide_reference`` reads: ISO 8601 in UTC and the shortest exact number."""
    utc = F.to_utc_timestamp(F.timestamp_micros(F.expr("period_end_ns div 1000")), F.current_timezone())  # shown by the session's clock
    stamp = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return returns.orderBy("period_end_ns").select(stamp.alias("period_end"), F.col("ret").cast("string").alias("ret"))


def write_reference_csv(returns: DataFrame, path: str) -> None:
    """One file of one series, some thousand rows."""
    lines = ["period_end,ret", *(f"{r.period_end},{r.ret}" for r in reference_csv(returns).collect())]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def load_series(spark: SparkSession, cache: FileCache, key: CacheKey, fetch: Callable[[CacheKey], bytes], recorded_at: str, delimiter: str = ",") -> tuple[DataFrame, int]:
    """A level series through the cache: fetched at most once, noted in the manifest each time, read from the kept file."""
    cache.get(key, fetch, recorded_at)
    return read_series(spark, cache.path_of(key), key.symbol, delimiter)


def http_fetcher(url: str, key_variable: str | None = None, timeout: float = 30.0) -> Callable[[CacheKey], bytes]:
    """Fetches ``url`` with {symbol}, {start}, {end} and {key} filled in; the key comes from the environment and is never kept.

    A table of JSON rows under "observations" (date, value) becomes the two columns that a level series has;
    anything else is kept as it came.
    """

    def fetch(key: CacheKey) -> bytes:
        import urllib.error
        import urllib.parse
        import urllib.request

        secret = os.environ.get(key_variable, "") if key_variable else ""
        if key_variable and not secret:
            raise SchemaError(f"the environment has no {key_variable}")
        filled = url.format(**{k: urllib.parse.quote(v, safe="") for k, v in {"symbol": key.symbol, "start": key.start, "end": key.end, "key": secret}.items()})
        try:
            with urllib.request.urlopen(filled, timeout=timeout) as got:
                payload = got.read()
        except (urllib.error.URLError, TimeoutError) as e:
            raise SchemaError(f"{key.source} can't be reached for {key.symbol}: {getattr(e, 'reason', e)}") from None
        return observations_csv(payload)

    return fetch


def observations_csv(payload: bytes) -> bytes:
    try:
        told = json.loads(payload)
    except ValueError:
        return payload
    if not isinstance(told, dict) or "observations" not in told:
        raise SchemaError("the answer holds no observations")
    return "\n".join(["date,value", *(f"{o['date']},{o['value']}" for o in told["observations"])]).encode() + b"\n"


def file_fetcher(path: str) -> Callable[[CacheKey], bytes]:
    def fetch(_: CacheKey) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    return fetch


def read_wide_reference(spark: SparkSession, path: str) -> DataFrame:
    """(period_end_ns, ret) from a file of stamps and returns; of repeated stamps the last one counts."""
    rows = read_strings(spark, path)
    if len(rows.columns) < 2:
        raise SchemaError("a reference has a stamp and a return")
    stamp, value = (F.col(f"`{c}`") for c in rows.columns[:2])
    ns = F.coalesce(stamp.try_cast("bigint"), F.unix_micros(stamp.try_cast("timestamp")) * 1000)
    typed = rows.select(ns.alias("period_end_ns"), value.try_cast("double").alias("ret"), F.monotonically_increasing_id().alias("_row"))
    if bad := typed.where("ret IS NULL OR period_end_ns IS NULL").count():
        raise SchemaError(f"{bad} cells of the reference can't be read")
    return last_wins(typed, "period_end_ns", "_row")
