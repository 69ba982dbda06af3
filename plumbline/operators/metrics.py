"""Descriptive and HAC-corrected statistics of trades and periods.

Sums are centred before they are squared. What the driver sees is one row a log and a table of lags.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, SchemaError
from ..functions.special import normal_ppf
from .grid import _sql

TRADE_METRICS = """
WITH m AS (SELECT log_id, avg(ret) AS mu FROM {returns} GROUP BY log_id),
c AS (SELECT r.log_id, r.ret, m.mu, r.ret - m.mu AS d FROM {returns} r JOIN m ON r.log_id = m.log_id)
SELECT log_id, count(*) AS n_trades, max(mu) AS expectancy,
       CAST(sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS hit_rate,
       CAST(sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_wins, CAST(sum(CASE WHEN ret < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_losses,
       sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END) AS profit_factor,
       avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END) AS win_loss_ratio,
       avg(CASE WHEN ret > 0 THEN ret END) AS mean_win, avg(CASE WHEN ret < 0 THEN ret END) AS mean_loss,
       max(ret) AS largest_win, min(ret) AS largest_loss,
       CASE WHEN sum(d * d) > 0 THEN (sum(d * d * d) / count(*)) / power(sum(d * d) / count(*), 1.5e0) ELSE 0e0 END AS skewness,
       CASE WHEN sum(d * d) > 0 THEN (sum(d * d * d * d) / count(*)) / power(sum(d * d) / count(*), 2e0) ELSE 0e0 END AS kurtosis
FROM c GROUP BY log_id"""

CENTRED = """
SELECT r.log_id, r.period_idx, r.ret - <rf> - m.mu AS c, m.n, m.mu
FROM {returns} r JOIN (SELECT log_id, count(*) AS n, avg(ret - <rf>) AS mu FROM {returns} GROUP BY log_id) m ON r.log_id = m.log_id"""

#: Biased autocovariances (denominator T) for lags 0 to max_lag.
AUTOCOVARIANCE = """
SELECT a.log_id, a.lag, sum(a.c * b.c) / max(a.n) AS gamma, max(a.n) AS n
FROM (SELECT log_id, period_idx, c, n, explode(sequence(CAST(0 AS BIGINT), least(CAST(<max_lag> AS BIGINT), CAST(n AS BIGINT) - 1))) AS lag FROM {centred}) a
JOIN {centred} b ON a.log_id = b.log_id AND b.period_idx = a.period_idx - a.lag GROUP BY a.log_id, a.lag"""

BANDWIDTH = """
SELECT log_id, n, lags, CASE WHEN s0 = 0 THEN 0 ELSE least(greatest(CAST(floor(1.1447e0 * power(4e0 * (s1 / s0) * (s1 / s0) * n, 1e0 / 3e0)) AS BIGINT), 0), n - 1) END AS bandwidth
FROM (SELECT log_id, n, lags, sum(CASE WHEN lag = 0 THEN gamma ELSE 2e0 * gamma END) AS s0, sum(2e0 * lag * gamma) AS s1
      FROM (SELECT *, least(greatest(CAST(floor(4e0 * power(n / 100e0, 2e0 / 9e0)) AS BIGINT), 1), n - 1) AS lags FROM {gammas}) g WHERE lag <= lags GROUP BY log_id, n, lags) s"""

LONG_RUN_VARIANCE = """
SELECT g.log_id, max(b.bandwidth) AS bandwidth, sum(CASE WHEN lag = 0 THEN gamma ELSE 2e0 * (1e0 - lag / (b.bandwidth + 1e0)) * gamma END) AS long_run_variance
FROM {gammas} g JOIN {bandwidths} b ON g.log_id = b.log_id WHERE g.lag <= b.bandwidth GROUP BY g.log_id"""

#: Of the returns, and of their excess e over the rate; a spread at the size of rounding errors counts as none.
PERIOD_METRICS = """
SELECT log_id, n_periods, active_fraction, n_periods / <ppy> AS years, growth - 1e0 AS cumulative_return,
       CASE WHEN growth > 0 THEN power(growth, <ppy> / n_periods) - 1e0 END AS cagr, deviation * sqrt(<ppy>) AS volatility_annualised,
       CASE WHEN spread THEN mean / deviation END AS sharpe_per_period, CASE WHEN spread THEN sqrt(<ppy>) * mean / deviation END AS sharpe_annualised,
       CASE WHEN downside > 0 THEN sqrt(<ppy>) * mean / sqrt(downside) END AS sortino, CASE WHEN spread AND variance > 0 THEN mean / variance END AS kelly
FROM (SELECT log_id, count(*) AS n_periods, CAST(sum(CASE WHEN n_trades > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS active_fraction, <growth> AS growth,
             stddev_samp(ret) AS deviation, avg(ret - <rf>) AS mean, var_pop(ret - <rf>) AS variance, avg(power(least(ret - <rf>, 0e0), 2e0)) AS downside,
             max(ret) > min(ret) AND stddev_pop(ret - <rf>) > count(*) * 2.220446049250313e-16 * max(abs(ret - <rf>)) AS spread
      FROM {returns} GROUP BY log_id) m"""

#: What one unit of capital becomes: returns on the initial capital add up, returns on current equity compound.
GROWTH = {
    C.FIXED_INITIAL: "1e0 + sum(ret)",
    C.CURRENT_EQUITY: "aggregate(transform(array_sort(collect_list(struct(period_idx, ret))), x -> x.ret), 1e0, (level, r) -> level * (1e0 + r))",
}

EQUITY = """
SELECT log_id, period_idx, <capital> * (1e0 + sum(ret) OVER (PARTITION BY log_id ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM {returns}"""

DRAWDOWN = """
WITH e AS (SELECT log_id, CAST(-1 AS BIGINT) AS idx, <capital> AS equity FROM {curve} GROUP BY log_id UNION ALL SELECT log_id, CAST(period_idx AS BIGINT) AS idx, equity FROM {curve}),
p AS (SELECT *, max(equity) OVER (PARTITION BY log_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM e),
u AS (SELECT *, equity / peak - 1e0 AS uw FROM p),
w AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY uw, idx) AS place FROM u),
t AS (SELECT log_id, idx AS trough, peak AS top, uw AS depth FROM w WHERE place = 1),
b AS (SELECT u.log_id, min(CASE WHEN u.equity = t.top AND u.idx <= t.trough THEN u.idx END) AS peak_idx, min(CASE WHEN u.idx > t.trough AND u.equity >= t.top THEN u.idx END) AS back, max(u.idx) AS last_idx,
             CAST(sum(CASE WHEN u.idx >= 0 AND u.uw < 0 THEN 1 ELSE 0 END) AS DOUBLE) / (count(*) - 1) AS time_underwater
      FROM u JOIN t ON u.log_id = t.log_id GROUP BY u.log_id)
SELECT t.log_id, -t.depth AS max_drawdown, CASE WHEN t.depth < 0 THEN coalesce(b.back, b.last_idx) - b.peak_idx ELSE 0 END AS max_drawdown_duration,
       t.depth = 0 OR b.back IS NOT NULL AS recovered, b.time_underwater
FROM t JOIN b ON t.log_id = b.log_id"""


def de_annualise_rate(rate: float, periods_per_year: float) -> float:
    if rate <= -1:
        raise SchemaError(f"a rate of {rate} leaves nothing")
    return (1 + rate) ** (1 / periods_per_year) - 1


def newey_west_lag_selection(n: int) -> int:
    return max(int(C.NW_LAG_SELECTION_COEFFICIENT * (n / 100) ** C.NW_LAG_SELECTION_EXPONENT), 1)


def dispersion_is_negligible(n: int, spread: float, std_pop: float, largest: float) -> bool:
    return spread == 0 or std_pop <= n * sys.float_info.epsilon * largest


def trade_metrics(returns: DataFrame) -> DataFrame:
    """Population skewness and plain (non-excess) kurtosis; null where there is no win or no loss to divide by."""
    return _sql(returns, TRADE_METRICS, returns=returns)


def equity_curve(returns: DataFrame, basis: str = C.FIXED_INITIAL, capital: float = 1.0) -> DataFrame:
    """(log_id, period_idx, equity): cumulative sum, or product with a basis of current equity."""
    if basis == C.FIXED_INITIAL:
        return _sql(returns, EQUITY.replace("<capital>", f"CAST({capital} AS DOUBLE)"), returns=returns)
    packed = returns.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("period_idx", "ret"))).alias("r"))
    start = F.struct(F.lit(float(capital)).alias("level"), F.array().cast("array<double>").alias("all"))
    grown = F.aggregate("r", start, lambda s, x: F.struct((s.level * (1 + x.ret)).alias("level"), F.concat(s["all"], F.array(s.level * (1 + x.ret))).alias("all")))
    out = packed.select("log_id", "r", grown["all"].alias("e")).select("log_id", F.posexplode("e").alias("i", "equity"), "r")
    return out.select("log_id", F.get("r", F.col("i")).period_idx.alias("period_idx"), "equity")


def drawdown_profile(curve: DataFrame, capital: float) -> DataFrame:
    """Deepest fall, its length from the first peak to recovery (or the end), and the share of periods under water."""
    return _sql(curve, DRAWDOWN.replace("<capital>", f"CAST({capital} AS DOUBLE)"), curve=curve)


def period_metrics(returns: DataFrame, periods_per_year: float, risk_free_rate: float = 0.0, basis: str = C.FIXED_INITIAL) -> DataFrame:
    """A row a log. Growth follows the basis that the returns stand on; what isn't defined is null (``period_warnings`` says why)."""
    rf = de_annualise_rate(risk_free_rate, periods_per_year)
    sql = PERIOD_METRICS.replace("<growth>", GROWTH[basis]).replace("<ppy>", f"CAST({periods_per_year!r} AS DOUBLE)").replace("<rf>", f"CAST({rf!r} AS DOUBLE)")
    return _sql(returns, sql, returns=returns)


def period_warnings(row: dict) -> list[str]:
    """What a reader of a row of ``period_metrics`` should know."""
    out = []
    if row["sharpe_per_period"] is None:
        out.append("the returns have no dispersion, so no Sharpe ratio is defined")
    if row["active_fraction"] < 1:
        out.append(f"{row['active_fraction']:.4f} of the periods have a trade; the empty ones count, as capital stood ready in them")
    if row["cagr"] is None:
        out.append("the capital is used up at the end, so no yearly growth is defined")
    if row["sortino"] is None:
        out.append("no period fell below the rate, so no Sortino ratio is defined")
    return out


def autocovariances(returns: DataFrame, max_lag: int, rf: float = 0.0) -> DataFrame:
    centred = _sql(returns, CENTRED.replace("<rf>", f"CAST({rf!r} AS DOUBLE)"), returns=returns)
    return _sql(returns, AUTOCOVARIANCE.replace("<max_lag>", str(max_lag)), centred=centred)


def bandwidths(gammas: DataFrame) -> DataFrame:
    return _sql(gammas, BANDWIDTH, gammas=gammas)


def bartlett_variance(gamma: list[float], bandwidth: int) -> float:
    return gamma[0] + 2 * math.fsum((1 - k / (bandwidth + 1)) * gamma[k] for k in range(1, bandwidth + 1))


def mertens_sharpe_variance(sharpe: float, skew: float, kurt: float, n: int) -> float:
    """Variance of a per-period Sharpe ratio of independent returns."""
    return (1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2) / n


def sharpe_ratio(returns: DataFrame, periods_per_year: float, risk_free_rate: float = 0.0, confidence: float = C.DEFAULT_CONFIDENCE_LEVEL, bandwidth: int | None = None) -> dict:
    """HAC Sharpe ratio of one log, with its delta-method error and interval; nothing is defined without dispersion."""
    q, rf = periods_per_year, de_annualise_rate(risk_free_rate, periods_per_year)
    e = returns.select("period_idx", (F.col("ret") - F.lit(rf)).alias("e"))
    n, mean, low, high, big = e.agg(F.count("e"), F.avg("e"), F.min("e"), F.max("e"), F.max(F.abs("e"))).first()
    if n < 2:
        raise InsufficientSampleError("a Sharpe ratio needs two periods", n, 2)
    pop = e.agg(F.avg(F.pow(F.col("e") - mean, 2)), F.avg(F.pow("e", 2))).first()
    out = {"n_periods": n, "risk_free_rate_per_period": rf, "confidence_level": confidence, "periods_per_year": q, "lag_selection_parameter": min(newey_west_lag_selection(n), n - 1), "sample_variance": pop[0] * n / (n - 1)}
    if dispersion_is_negligible(n, high - low, math.sqrt(pop[0]), big):
        return out | dict.fromkeys(("per_period_sample", "per_period_population", "annualised_sqrt_q", "annualised_hac", "standard_error", "ci_low", "ci_high")) | {"bandwidth": 0, "long_run_variance": 0.0}
    centred = e.select("period_idx", (F.col("e") - mean).alias("x"), (F.pow("e", 2) - pop[1]).alias("y"))

    def lags(most: int) -> list[tuple]:
        a = centred.select(F.col("period_idx").alias("i"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"))
        both = a.join(centred, F.col("period_idx") == F.col("i") - F.col("lag"))
        got = both.groupBy("lag").agg(*[F.sum(p * r) / n for p, r in ((F.col("x0"), F.col("x")), (F.col("x0"), F.col("y")), (F.col("y0"), F.col("x")), (F.col("y0"), F.col("y")))]).collect()
        return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.lag)]

    table = lags(out["lag_selection_parameter"])
    if bandwidth is None:
        s0 = table[0][0] + 2 * sum(r[0] for r in table[1:])
        s1 = 2 * sum(k * r[0] for k, r in enumerate(table))
        bandwidth = 0 if s0 == 0 else min(max(int(C.NW_BARTLETT_BANDWIDTH_CONSTANT * (4 * (s1 / s0) ** 2 * n) ** (1 / 3)), 0), n - 1)
    if bandwidth >= len(table):
        table = lags(bandwidth)
    weight = [1 - k / (bandwidth + 1) for k in range(bandwidth + 1)]
    omega = [table[0][k] + sum(w * (table[j][k] + table[j][{1: 2, 2: 1}.get(k, k)]) for j, w in enumerate(weight) if j) for k in range(4)]
    v, s = pop
    grad = (s / v**1.5, -mean / (2 * v**1.5))
    variance = grad[0] ** 2 * omega[0] + grad[0] * grad[1] * (omega[1] + omega[2]) + grad[1] ** 2 * omega[3]
    sample = mean / math.sqrt(v * n / (n - 1))
    point, error = math.sqrt(q) * sample, math.sqrt(q) * math.sqrt(max(variance, 0) / n)
    z = normal_ppf(0.5 + confidence / 2)
    return out | {
        "per_period_sample": sample, "per_period_population": mean / math.sqrt(v), "annualised_sqrt_q": point, "annualised_hac": math.sqrt(q) * mean / math.sqrt(omega[0]) if omega[0] > 0 else None,
        "standard_error": error, "ci_low": point - z * error, "ci_high": point + z * error, "bandwidth": bandwidth, "long_run_variance": omega[0],
    }
