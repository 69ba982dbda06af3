"""Tail, drawdown, ruin and leverage over simulated paths (path_id, step, level). Quantiles are exact."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, SchemaError, TradeIntegrityError, UnitMismatchError
from ..functions.special import normal_cdf
from .grid import _sql

TERMINAL = "SELECT path_id, max_by(level, step) / min_by(level, step) - 1e0 AS terminal FROM {paths} GROUP BY path_id"

DRAWDOWNS = """
SELECT path_id, max(1e0 - level / peak) AS max_drawdown
FROM (SELECT path_id, level, max(level) OVER (PARTITION BY path_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM {paths}) p GROUP BY path_id"""

TAIL = """
SELECT -max(cut) AS value_at_risk, -avg(CASE WHEN terminal <= cut THEN terminal END) AS expected_shortfall, count(*) AS n_paths
FROM (SELECT terminal FROM {terminals}) t JOIN (SELECT percentile(terminal, <tail>) AS cut FROM {terminals}) c ON t.terminal IS NOT NULL"""

PASSAGE = """
SELECT path_id, coalesce(min(CASE WHEN level <= <barrier> THEN step END), -1) AS first_step FROM {paths} GROUP BY path_id"""

PASSAGE_SUMMARY = """
SELECT CAST(sum(CASE WHEN first_step >= 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS probability, count(*) AS n_paths,
       CAST(sum(CASE WHEN first_step < 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS never_hit_fraction,
       percentile(CAST(CASE WHEN first_step >= 0 THEN first_step END AS DOUBLE), 0.5e0) AS median_step FROM {passages}"""

ABSORBED = """
SELECT path_id, step, CASE WHEN max(CASE WHEN level <= <barrier> THEN 1 ELSE 0 END) OVER (PARTITION BY path_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN <barrier> ELSE level END AS level FROM {paths}"""

STEP_RETURNS = {
    C.FIXED_INITIAL: "SELECT path_id, step, ret FROM (SELECT path_id, step, (level - lag(level) OVER w) / first_value(level) OVER w AS ret FROM {paths} WINDOW w AS (PARTITION BY path_id ORDER BY step)) x WHERE ret IS NOT NULL",
    C.CURRENT_EQUITY: "SELECT path_id, step, ret FROM (SELECT path_id, step, level / lag(level) OVER w - 1e0 AS ret FROM {paths} WINDOW w AS (PARTITION BY path_id ORDER BY step)) x WHERE ret IS NOT NULL",
}

KELLY = """
SELECT path_id, CASE WHEN var_pop(ret) > 0 THEN avg(ret) / var_pop(ret) END AS kelly FROM {steps} GROUP BY path_id"""

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _enough(n: int) -> None:
    if n < C.MIN_TAIL_PATHS:
        raise InsufficientSampleError("too few paths for a tail", n, C.MIN_TAIL_PATHS)


def _level(level: float) -> None:
    if not 0 < level < 1:
        raise SchemaError(f"a level lies between 0 and 1, got {level}")


def terminal_returns(paths: DataFrame) -> DataFrame:
    return _sql(paths, TERMINAL, paths=paths)


def path_returns(paths: DataFrame, basis: str = C.FIXED_INITIAL) -> DataFrame:
    return _sql(paths, STEP_RETURNS[basis], paths=paths)


def max_drawdowns(paths: DataFrame, check: bool = True) -> DataFrame:
    if check and (low := paths.agg(F.min("level")).first()[0]) is not None and low <= 0:
        raise TradeIntegrityError("a drawdown is undefined once a level is used up", low, 0)
    return _sql(paths, DRAWDOWNS, paths=paths)


def tail_risk(paths: DataFrame, level: float = C.DEFAULT_TAIL_LEVEL) -> DataFrame:
    _level(level)
    return _sql(paths, TAIL.replace("<tail>", f"CAST({1 - level!r} AS DOUBLE)"), terminals=terminal_returns(paths))


#: Up to so many values (16 bytes each) they are broadcast to the draws; beyond it they are joined.
BROADCAST_VALUES = 1_000_000


def bootstrap_interval(values: DataFrame, column: str, measure: str, tail: float, seed: int, replicates: int = 1000, confidence: float = 0.95, stream: str = "interval") -> dict:
    """Standard error and percentile interval from resampled copies of ``values``; every measure draws the same indices.

    ``measure`` is var, es or mean. Values, one a simulated path, are numbered in ascending order on the executors;
    copies are drawn and grouped there too.
    """
    from ..functions.random import uniform

    spark = values.sparkSession
    n = values.agg(F.count(column)).first()[0]
    numbered = values.agg(F.sort_array(F.collect_list(F.col(column).cast("double"))).alias("v")).select(F.posexplode("v").alias("i", "x"))
    draws = spark.range(replicates).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    drawn = draws.withColumn("i", F.floor(uniform(seed, stream, "rep", "k") * n).cast("int")).join(F.broadcast(numbered) if n <= BROADCAST_VALUES else numbered, "i")
    if measure == "mean":
        per = drawn.groupBy("rep").agg(F.avg("x").alias("m"))
    else:
        cuts = drawn.groupBy("rep").agg(F.expr(f"percentile(x, {tail})").alias("cut"), F.sort_array(F.collect_list("x")).alias("xs"))
        low = F.filter("xs", lambda x: x <= F.col("cut"))
        per = cuts.select("rep", (-F.aggregate(low, F.lit(0.0), lambda s, x: s + x) / F.size(low) if measure == "es" else -F.col("cut")).alias("m"))
    side = (1 - confidence) / 2
    got = per.agg(F.stddev_samp("m").alias("se"), F.expr(f"percentile(m, array({side}, {1 - side}))").alias("ci")).first()
    return {"standard_error": got.se, "ci_low": got.ci[0], "ci_high": got.ci[1], "confidence_level": confidence, "n_paths": n, "seed": seed}


def value_at_risk(paths: DataFrame, seed: int, level: float = C.DEFAULT_TAIL_LEVEL, **options) -> dict:
    t = terminal_returns(paths)
    row = tail_risk(paths, level).first()
    _enough(row.n_paths)
    return {"value": row.value_at_risk} | bootstrap_interval(t, "terminal", "var", 1 - level, seed, **options)


def expected_shortfall(paths: DataFrame, seed: int, level: float = C.DEFAULT_TAIL_LEVEL, **options) -> dict:
    t = terminal_returns(paths)
    row = tail_risk(paths, level).first()
    _enough(row.n_paths)
    return {"value": row.expected_shortfall} | bootstrap_interval(t, "terminal", "es", 1 - level, seed, **options)


def drawdown_distribution(paths: DataFrame, seed: int, observed: float | None = None, quantiles: tuple[float, ...] = QUANTILES, **options) -> dict:
    d = max_drawdowns(paths)
    row = d.agg(F.avg("max_drawdown").alias("mean"), F.count("*").alias("n"), F.expr(f"percentile(max_drawdown, array({', '.join(map(str, quantiles))}))").alias("q"), F.avg((F.col("max_drawdown") <= F.lit(observed)).cast("double")).alias("at")).first()
    _enough(row.n)
    return {"mean": {"value": row.mean} | bootstrap_interval(d, "max_drawdown", "mean", 0, seed, **options), "quantiles": dict(zip(quantiles, row.q, strict=True)), "observed": observed, "observed_quantile": row.at if observed is not None else None, "n_paths": row.n}


def first_steps(paths: DataFrame, barrier: float) -> DataFrame:
    """(path_id, first_step): the first step at or below the barrier, -1 for a path that never gets there."""
    return _sql(paths, PASSAGE.replace("<barrier>", f"CAST({barrier!r} AS DOUBLE)"), paths=paths)


def first_passage(paths: DataFrame, barrier: float, seed: int, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95), unit: str = "PERIOD", **options) -> dict:
    """Chance to touch the barrier within the horizon, with its bootstrap interval, and quantiles of when.

    The quantiles are over the paths that touch it (none: empty). Paths by trade have no horizon in time and are
    refused. The level is seen once a period, so a fall and return within one doesn't count. ``first_steps``
    has the step of each path.
    """
    if unit != "PERIOD":
        raise UnitMismatchError(f"ruin over a horizon needs paths by period, these are by {unit}")
    start = paths.where("step = 0").agg(F.min("level")).first()[0]
    if start is not None and barrier >= start:
        raise InsufficientSampleError("the barrier doesn't lie below the start, so every path is ruined before its first step", barrier, start)
    p = first_steps(paths, barrier)
    hit = F.when(F.col("first_step") >= 0, F.col("first_step"))
    row = p.agg(F.count("*").alias("n"), F.count(hit).alias("h"), F.expr(f"percentile(CASE WHEN first_step >= 0 THEN first_step END, array({', '.join(map(str, quantiles))}))").alias("q")).first()
    _enough(row.n)
    interval = bootstrap_interval(p.select((F.col("first_step") >= 0).cast("double").alias("hit")), "hit", "mean", 0, seed, **options)
    return {"probability": row.h / row.n, "barrier": barrier, "never_hit_fraction": 1 - row.h / row.n, "quantiles": dict(zip(quantiles, row.q, strict=True)) if row.h else {}, "horizon_steps": paths.agg(F.max("step")).first()[0]} | interval


def absorb_at_barrier(paths: DataFrame, barrier: float) -> DataFrame:
    return _sql(paths, ABSORBED.replace("<barrier>", f"CAST({barrier!r} AS DOUBLE)"), paths=paths)


def kelly_from_paths(paths: DataFrame, basis: str = C.FIXED_INITIAL, quantiles: tuple[float, ...] = QUANTILES, confidence: float = 0.95) -> dict:
    steps = path_returns(paths, basis)
    pooled = steps.agg(F.avg("ret"), F.var_pop("ret")).first()
    per = _sql(paths, KELLY, steps=steps)
    cuts = (1 - confidence, *quantiles)
    q = per.agg(F.expr(f"percentile(kelly, array({', '.join(map(str, cuts))}))")).first()[0]
    return {"point": pooled[0] / pooled[1] if pooled[1] else None, "adjusted": q[0] if q else None, "quantiles": dict(zip(quantiles, q[1:], strict=True)) if q else {}, "confidence_level": confidence, "basis": basis}


def brownian_ruin_probability(drift: float, sigma: float, distance: float, horizon: float, corrected: bool = True) -> float:
    """Chance that a walk with this drift and deviation a step falls by ``distance`` within ``horizon`` steps."""
    if sigma <= 0 or distance <= 0 or horizon <= 0:
        raise InsufficientSampleError("deviation, distance and horizon must be positive", (sigma, distance, horizon), 0)
    d = distance + (C.BARRIER_CONTINUITY_CORRECTION * sigma if corrected else 0)
    root = sigma * math.sqrt(horizon)
    return min(1.0, normal_cdf((-d - drift * horizon) / root) + math.exp(-2 * drift * d / sigma**2) * normal_cdf((-d + drift * horizon) / root))


def expected_max_drawdown(sigma: float, horizon: float, corrected: bool = True) -> float:
    """Mean deepest fall of a walk without drift; the correction, for looking only at whole steps, counts for the peak and for the level."""
    if sigma <= 0 or horizon <= 0:
        raise InsufficientSampleError("deviation and horizon must be positive", (sigma, horizon), 0)
    return sigma * (C.EXPECTED_MAX_DRAWDOWN_COEFFICIENT * math.sqrt(horizon) - (2 * C.BARRIER_CONTINUITY_CORRECTION if corrected else 0))
