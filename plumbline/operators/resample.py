"""Block length and stationary bootstrap. Draws are keyed by (seed, stream, path, step), so they don't depend on partitions.

Paths are made where they are used, partitioned by path: no index matrix is ever held. ``rng`` is ``md5`` (the
same numbers in other engines), ``xxhash64`` (faster) or ``counter`` (whole paths as arrays, fastest).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError
from .grid import _sql
from .metrics import autocovariances, dispersion_is_negligible

#: One hash a cell: 32 bits choose where a block begins, 32 bits whether one begins.
DRAWS = """
SELECT path_id, step, n_obs, CAST(floor(u1 * n_obs) AS BIGINT) AS anchor, step = 0 OR u2 < <restart> AS fresh
FROM (SELECT path_id, step, n_obs, <u1> AS u1, <u2> AS u2
      FROM (SELECT path_id, step, n_obs, <hash> AS h
            FROM (SELECT path_id, n_obs, explode(sequence(CAST(0 AS BIGINT), n_steps - 1)) AS step FROM {path_ids}) s) k) u"""

#: Paths by number, each with how many observations it draws from and how many steps it takes.
PATH_IDS = """
SELECT path_id, CAST(n AS BIGINT) AS n_obs, CAST(n AS BIGINT) AS n_steps
FROM (SELECT explode(sequence(CAST(0 AS BIGINT), CAST(<n_paths> - 1 AS BIGINT))) AS path_id) p JOIN (SELECT count(DISTINCT period_idx) AS n FROM {returns}) c ON c.n > 0"""

INDICES = """
SELECT path_id, step, (last_value(CASE WHEN fresh THEN anchor END, true) OVER w + step - last_value(CASE WHEN fresh THEN step END, true) OVER w) % n_obs AS src_idx
FROM {draws} WINDOW w AS (PARTITION BY path_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

INDICES_DUCK = INDICES.replace("END, true)", "END IGNORE NULLS)")

LEVELS = """
SELECT i.path_id, i.step + 1 AS step, <capital> * (1e0 + sum(r.ret) OVER (PARTITION BY i.path_id ORDER BY i.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level
FROM {indices} i JOIN {returns} r ON i.src_idx = r.period_idx
UNION ALL SELECT path_id, CAST(0 AS BIGINT) AS step, <capital> AS level FROM {path_ids}"""

MD5 = {"hash": "md5('<seed>|<stream>|' || CAST(path_id AS STRING) || '|' || CAST(step AS STRING))", "u1": "CAST(conv(substr(h, 1, 8), 16, 10) AS DOUBLE) / 4294967296e0", "u2": "CAST(conv(substr(h, 9, 8), 16, 10) AS DOUBLE) / 4294967296e0"}
MD5_DUCK = {"hash": MD5["hash"], "u1": "CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0", "u2": "CAST(CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0"}
XXHASH = {"hash": "xxhash64('<seed>|<stream>', path_id, step)", "u1": "CAST(shiftrightunsigned(h, 32) AS DOUBLE) / 4294967296e0", "u2": "CAST(h & 4294967295L AS DOUBLE) / 4294967296e0"}


def fill(sql: str, values: dict) -> str:
    for _ in range(2):
        for k, v in values.items():
            sql = sql.replace(f"<{k}>", str(v))
    return sql


@dataclass(frozen=True)
class BlockLength:
    block_length: float
    lag_selection: int
    bandwidth: int
    cap: float
    capped: bool
    n_obs: int
    automatic: bool = True
    warnings: list[str] = field(default_factory=list)


def flat_top(x: float) -> float:
    x = abs(x)
    return 1.0 if x <= 0.5 else max(0.0, 2 * (1 - x))


def block_length_from(gamma: list[float], n: int) -> BlockLength:
    """The plug-in rule from autocovariances of lags 0 to at least the largest lag it looks at."""
    k_run = max(5, math.ceil(math.sqrt(math.log10(n))))
    m_max = math.ceil(math.sqrt(n)) + k_run
    n_lags = min(m_max + k_run, n - 1)
    rho = [g / gamma[0] for g in gamma[: n_lags + 1]]
    limit = 2 * math.sqrt(math.log10(n) / n)
    warnings: list[str] = []
    chosen = next((m for m in range(1, min(m_max, n_lags) + 1) if (run := rho[m + 1 : m + k_run + 1]) and all(abs(r) < limit for r in run)), None)
    if chosen is None:
        chosen = m_max
        warnings.append("autocorrelation doesn't die out within the lags looked at")
    band = min(2 * chosen, m_max, n_lags)
    weights = [(k, flat_top(k / band)) for k in range(-band, band + 1)]
    g = math.fsum(w * gamma[abs(k)] for k, w in weights)
    slope = math.fsum(w * abs(k) * gamma[abs(k)] for k, w in weights)
    raw = 1.0 if g == 0 or slope == 0 else (slope**2 / g**2) ** (1 / 3) * n ** (1 / 3)
    cap = math.ceil(min(3 * math.sqrt(n), n / 3))
    b = min(max(raw, 1.0), float(cap))
    if b > n / C.MIN_BLOCK_SAMPLE_RATIO:
        raise InsufficientSampleError("the series is too short for its block length", n / b, C.MIN_BLOCK_SAMPLE_RATIO)
    return BlockLength(b, chosen, band, float(cap), raw > cap, n, True, warnings)


def estimate_block_length(returns: DataFrame) -> BlockLength:
    """Block length of one series (period_idx, ret); one job for a row of moments and one for the table of lags."""
    n, low, high, std, big = returns.agg(F.count("ret"), F.min("ret"), F.max("ret"), F.stddev_pop("ret"), F.max(F.abs("ret"))).first()
    if n < 8:
        raise InsufficientSampleError("a block length needs eight observations", n, 8)
    if dispersion_is_negligible(n, high - low, std, big):
        return BlockLength(1.0, 0, 0, float(math.ceil(min(3 * math.sqrt(n), n / 3))), False, n)
    k_run = max(5, math.ceil(math.sqrt(math.log10(n))))
    most = min(math.ceil(math.sqrt(n)) + 2 * k_run, n - 1)
    rows = autocovariances(returns if "log_id" in returns.columns else returns.withColumn("log_id", F.lit("")), most).collect()
    return block_length_from([r.gamma for r in sorted(rows, key=lambda r: r.lag)], n)


def path_ids(spark, n_paths: int, n_obs: int, n_steps: int) -> DataFrame:
    return spark.range(n_paths).select(F.col("id").alias("path_id"), F.lit(n_obs).cast("long").alias("n_obs"), F.lit(n_steps).cast("long").alias("n_steps"))


#: Cells that a task makes at once, and periods (8 bytes each) up to which a log's returns are broadcast to the draws.
CELLS, BROADCAST_PERIODS = 1 << 20, 1_000_000
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of counters in which every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _K[1]
        x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def counter_indices(path_ids: np.ndarray, n_obs: int, n_steps: int, block_length: float, seed: int, stream: str) -> np.ndarray:
    """(paths, steps) of drawn periods; a cell depends on seed, stream, path and step alone."""
    key = np.uint64(int.from_bytes(hashlib.md5(f"{seed}|{stream}".encode()).digest()[:8], "little"))
    with np.errstate(over="ignore"):
        rows = _scrambled(path_ids.astype(np.uint64) * _K[0] + key)[:, None]
        cells = _scrambled(rows + np.arange(1, n_steps + 1, dtype=np.uint64) * _K[0])
    step = np.arange(n_steps)
    begin = np.where((cells & np.uint64(0xFFFFFFFF)) < np.uint64(min(2**32, round(2**32 / block_length))), step, 0)
    begin = np.maximum.accumulate(begin, axis=1)
    anchor = ((cells >> np.uint64(32)) * np.uint64(n_obs) >> np.uint64(32)).astype(np.int64)
    return (np.take_along_axis(anchor, begin, axis=1) + step - begin) % n_obs


def _counter_rows(spark, n_paths: int, width: int, make, names: list[str], schema: str) -> DataFrame:
    """A table (path, step, value) from ``make(paths)``, an array of ``width`` values for each path."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for k in range(0, len(ids), max(1, CELLS // width)):
                part = ids[k : k + max(1, CELLS // width)]
                value = make(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, width)), pa.array(np.tile(np.arange(width), len(part))), pa.array(value.ravel())], names)

    return spark.range(n_paths).mapInArrow(rows, schema)


def bootstrap_indices(spark, n_obs: int, n_paths: int, n_steps: int, block_length: float, seed: int, stream: str = "path", rng: str = "md5") -> DataFrame:
    """(path_id, step, src_idx): circular blocks of mean length ``block_length``; a length of 1 draws each step anew.

    ``rng``: md5 and xxhash64 draw in SQL, counter draws whole paths in arrays, without a shuffle.
    """
    if block_length < 1 or n_obs < 1 or n_paths < 1 or n_steps < 1:
        raise InsufficientSampleError("the bootstrap needs observations, paths, steps and blocks of one or more", (n_obs, n_paths, n_steps, block_length), 1)
    if rng == "counter":
        make = lambda ids: counter_indices(ids, n_obs, n_steps, block_length, seed, stream)
        return _counter_rows(spark, n_paths, n_steps, make, ["path_id", "step", "src_idx"], "path_id long, step long, src_idx long")
    values = {"restart": f"{1 / block_length!r}e0" if "e" not in repr(1 / block_length) else repr(1 / block_length), "seed": seed, "stream": stream} | (MD5 if rng == "md5" else XXHASH)
    draws = spark.sql(fill(DRAWS, values), path_ids=path_ids(spark, n_paths, n_obs, n_steps))
    return spark.sql(fill(INDICES, values), draws=draws)


def resample_equity_paths(returns: DataFrame, n_paths: int, seed: int, capital: float, basis: str = C.FIXED_INITIAL, block_length: float | None = None, n_steps: int | None = None, rng: str = "counter") -> DataFrame:
    """(path_id, step, level): equity along resampled periods, step 0 is the capital."""
    spark = returns.sparkSession
    n = returns.count()
    b = block_length if block_length is not None else estimate_block_length(returns).block_length
    steps = n_steps or n
    if rng == "counter" and n <= BROADCAST_PERIODS:
        values = spark.sparkContext.broadcast(np.array([r.ret for r in returns.select("period_idx", "ret").orderBy("period_idx").collect()], float))
        grow = (lambda x: 1 + np.cumsum(x, axis=1)) if basis == C.FIXED_INITIAL else (lambda x: np.cumprod(1 + x, axis=1))

        def make(ids: np.ndarray) -> np.ndarray:
            drawn = values.value[counter_indices(ids, n, steps, b, seed, "path")]
            return capital * np.concatenate([np.ones((len(ids), 1)), grow(drawn)], axis=1)

        return _counter_rows(spark, n_paths, steps + 1, make, ["path_id", "step", "level"], "path_id long, step long, level double")
    indices = bootstrap_indices(spark, n, n_paths, steps, b, seed, rng=rng)
    start = f"CAST({capital!r} AS DOUBLE)"
    if basis == C.FIXED_INITIAL:
        return spark.sql(LEVELS.replace("<capital>", start), indices=indices, returns=returns.select("period_idx", "ret"), path_ids=path_ids(spark, n_paths, n, steps))
    drawn = indices.join(returns.select(F.col("period_idx").alias("src_idx"), "ret"), "src_idx").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step", "ret"))).alias("r"))
    grown = F.aggregate("r", F.array(F.lit(float(capital))), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) * (1 + x.ret))))
    return drawn.select("path_id", F.posexplode(grown).alias("step", "level")).withColumn("step", F.col("step").cast("long"))


def count_ruined(paths: DataFrame) -> int:
    return paths.groupBy("path_id").agg(F.min("level").alias("low")).where("low <= 0").count()
