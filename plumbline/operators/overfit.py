"""Corrections for search: probabilistic and deflated Sharpe ratio, track record, CSCV and superior predictive ability.

Trials are long: (config_idx, config_id, period_idx, ret). CSCV reads the rows once, into sums of blocks; the
masks then combine sums. The bootstrap of SPA counts how often a replicate draws a period, so replicates times
periods shrink before they meet the configurations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import OverfitInputError
from ..functions.special import normal_cdf, normal_ppf
from .grid import _sql
from .resample import DRAWS, INDICES, MD5, XXHASH, estimate_block_length, fill, path_ids

MOMENTS = """
SELECT c.log_id, max(c.n) AS n_periods, max(c.mu) / nullif(sqrt(sum(d * d) / count(*)), 0e0) AS sharpe,
       (sum(d * d * d) / count(*)) / nullif(power(sum(d * d) / count(*), 1.5e0), 0e0) AS skewness, (sum(d * d * d * d) / count(*)) / nullif(power(sum(d * d) / count(*), 2e0), 0e0) AS kurtosis
FROM (SELECT log_id, c AS d, n, mu FROM {centred}) c GROUP BY c.log_id"""

PSR_Z = """
SELECT log_id, n_periods, sharpe, skewness, kurtosis,
       (sharpe - <benchmark>) * sqrt(n_periods - 1e0) / sqrt(1e0 - skewness * sharpe + (kurtosis - 1e0) / 4e0 * sharpe * sharpe) AS z FROM {moments}"""

TRIAL_SHARPES = """
SELECT config_id, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret - <rf>) / stddev_samp(ret) ELSE 0e0 END AS sharpe FROM {trials} GROUP BY config_id"""

BLOCKS = """
SELECT config_idx, block, CAST(count(*) AS DOUBLE) AS n, sum(ret) AS s, sum(ret * ret) AS ss
FROM (SELECT config_idx, ret, period_idx div <size> AS block FROM {trials}) t WHERE block < <splits> GROUP BY config_idx, block"""

#: Sharpe ratios inside and outside of each mask, for every configuration. Sums over all choices of the lower and of
#: the upper half of the blocks are made once a configuration; a mask then looks up one of each.
SIDES = """
SELECT mask, config_idx, CASE WHEN v1 > <eps> THEN (s1 / n1) / sqrt(v1) ELSE 0e0 END AS inside, CASE WHEN v0 > <eps> THEN (s0 / n0) / sqrt(v0) ELSE 0e0 END AS outside
FROM (SELECT mask, config_idx, n1, s1, n0, s0, (q1 - s1 * s1 / n1) / (n1 - 1e0) AS v1, (q0 - s0 * s0 / n0) / (n0 - 1e0) AS v0
      FROM (SELECT mask, config_idx, n1, s1, q1, all_n - n1 AS n0, all_s - s1 AS s0, all_ss - q1 AS q0
            FROM (SELECT mask, config_idx, all_n, all_s, all_ss, low_n[lo] + high_n[hi] AS n1, low_s[lo] + high_s[hi] AS s1, low_ss[lo] + high_ss[hi] AS q1
                  FROM (SELECT *, CAST(mask & <low_mask> AS INT) AS lo, CAST(shiftright(mask, <low_bits>) AS INT) AS hi
                        FROM (SELECT *, explode(filter(sequence(CAST(0 AS BIGINT), CAST(<all> - 1 AS BIGINT)), m -> bit_count(m) = <half>)) AS mask
                              FROM (SELECT config_idx, all_n, all_s, all_ss, <tables>
                                    FROM (SELECT config_idx, collect_list(struct(block, n, s, ss)) AS b, sum(n) AS all_n, sum(s) AS all_s, sum(ss) AS all_ss FROM {blocks} GROUP BY config_idx) p) t) x) y) z) g) v"""

#: Where the best configuration inside a mask stands among all of them outside; one grouping by mask.
LOGITS = """
SELECT mask, CAST(size(filter(places, o -> o <= best)) AS BIGINT) AS place, CAST(size(places) AS BIGINT) AS n_configs
FROM (SELECT mask, max_by(outside, struct(inside, -config_idx)) AS best, collect_list(outside) AS places FROM {sides} GROUP BY mask) m"""

PBO = """
SELECT CAST(sum(CASE WHEN lg <= 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS probability, percentile(lg, 0.5e0) AS median_logit, count(*) AS n_combinations, max(n_configs) AS n_configs
FROM (SELECT ln((place / (n_configs + 1e0)) / (1e0 - place / (n_configs + 1e0))) AS lg, n_configs FROM {logits}) x"""

REPLICATES = """
SELECT m.rep, t.config_idx, sum(m.times * t.ret) / <n_obs> AS mean_star
FROM (SELECT path_id AS rep, src_idx, CAST(count(*) AS DOUBLE) AS times FROM {indices} GROUP BY path_id, src_idx) m JOIN {trials} t ON m.src_idx = t.period_idx GROUP BY m.rep, t.config_idx"""

SPA = """
WITH means AS (SELECT config_idx, avg(ret) AS d FROM {trials} GROUP BY config_idx),
w AS (SELECT config_idx, sqrt(<n_obs> * var_samp(mean_star)) AS omega FROM {replicates} GROUP BY config_idx),
k AS (SELECT m.config_idx, d, omega, omega > 0 AS live, -omega / sqrt(<n_obs> + 0e0) * sqrt(2e0 * ln(ln(<n_obs> + 0e0))) AS thr FROM means m JOIN w ON m.config_idx = w.config_idx),
obs AS (SELECT max(CASE WHEN live THEN greatest(sqrt(<n_obs> + 0e0) * d / omega, 0e0) ELSE 0e0 END) AS stat, max(sqrt(<n_obs> + 0e0) * d) AS plain FROM k),
sim AS (SELECT r.rep, max(CASE WHEN live THEN greatest(sqrt(<n_obs> + 0e0) * (mean_star - d + least(d, 0e0)) / omega, 0e0) ELSE 0e0 END) AS low,
               max(CASE WHEN live THEN greatest(sqrt(<n_obs> + 0e0) * (mean_star - d + CASE WHEN d < thr THEN d ELSE 0e0 END) / omega, 0e0) ELSE 0e0 END) AS mid,
               max(CASE WHEN live THEN greatest(sqrt(<n_obs> + 0e0) * (mean_star - d) / omega, 0e0) ELSE 0e0 END) AS up, max(sqrt(<n_obs> + 0e0) * (mean_star - d)) AS rc
        FROM {replicates} r JOIN k ON r.config_idx = k.config_idx GROUP BY r.rep)
SELECT avg(CASE WHEN low >= stat THEN 1e0 ELSE 0e0 END) AS p_value_lower, avg(CASE WHEN mid >= stat THEN 1e0 ELSE 0e0 END) AS p_value_consistent,
       avg(CASE WHEN up >= stat THEN 1e0 ELSE 0e0 END) AS p_value_upper, avg(CASE WHEN rc >= plain THEN 1e0 ELSE 0e0 END) AS p_value_reality_check, max(stat) AS statistic
FROM sim JOIN obs ON obs.stat IS NOT NULL"""


@dataclass(frozen=True)
class ProbabilisticSharpe:
    probability: float
    observed_sharpe: float
    benchmark_sharpe: float
    n_periods: int
    skewness: float
    kurtosis: float
    denominator: float


def sample_moments(excess: DataFrame) -> tuple[int, float, float, float]:
    """(T, population Sharpe ratio, skewness, kurtosis) of the column ret."""
    n, mean = excess.agg(F.count("ret"), F.avg("ret")).first()
    if n < 3:
        raise OverfitInputError("moments need three periods", n, 3)
    d = F.col("ret") - F.lit(mean)
    m2, m3, m4, big = excess.agg(F.avg(d**2), F.avg(d**3), F.avg(d**4), F.max(F.abs("ret"))).first()
    if math.sqrt(m2) <= n * 2.220446049250313e-16 * big:
        raise OverfitInputError("the returns have no dispersion", math.sqrt(m2), 0)
    return n, mean / math.sqrt(m2), m3 / m2**1.5, m4 / m2**2


def _psr(n: int, sr: float, skew: float, kurt: float, benchmark: float) -> ProbabilisticSharpe:
    under = 1 - skew * sr + (kurt - 1) / 4 * sr**2
    if under <= 0:
        raise OverfitInputError("the variance of the ratio isn't positive", under, 0)
    return ProbabilisticSharpe(normal_cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(under)), sr, benchmark, n, skew, kurt, math.sqrt(under))


def probabilistic_sharpe_ratio(excess: DataFrame, benchmark_sharpe: float = 0.0) -> ProbabilisticSharpe:
    return _psr(*sample_moments(excess), benchmark_sharpe)


def expected_maximum_sharpe(n_trials: int, trial_variance: float) -> float:
    if n_trials < 2:
        raise OverfitInputError("a search has two trials at least", n_trials, 2)
    if not trial_variance > 0:
        raise OverfitInputError("the trials' ratios have no variance", trial_variance, 0)
    g = C.EULER_MASCHERONI
    return math.sqrt(trial_variance) * ((1 - g) * normal_ppf(1 - 1 / n_trials) + g * normal_ppf(1 - 1 / (n_trials * math.e)))


def deflated_sharpe_ratio(excess: DataFrame, n_trials: int, trial_variance: float) -> dict:
    moments = sample_moments(excess)
    top = expected_maximum_sharpe(n_trials, trial_variance)
    p = _psr(*moments, top)
    return {"probability": p.probability, "expected_maximum": top, "n_trials": n_trials, "trial_variance": trial_variance, "psr_against_zero": _psr(*moments, 0.0).probability, "observed_sharpe": p.observed_sharpe, "n_periods": p.n_periods, "skewness": p.skewness, "kurtosis": p.kurtosis}


def minimum_track_record_length(excess: DataFrame, periods_per_year: float, target_probability: float = 0.95, benchmark_sharpe: float = 0.0) -> dict:
    """Periods until the ratio would pass the benchmark with this probability; out of reach is a result, no error."""
    n, sr, skew, kurt = sample_moments(excess)
    base = {"observed_periods": n, "observed_sharpe": sr, "target_probability": target_probability, "benchmark_sharpe": benchmark_sharpe}
    if sr <= benchmark_sharpe:
        return base | {"attainable": False, "periods": None, "years": None, "sufficient": False}
    need = 1 + (1 - skew * sr + (kurt - 1) / 4 * sr**2) * (normal_ppf(target_probability) / (sr - benchmark_sharpe)) ** 2
    return base | {"attainable": True, "periods": need, "years": need / periods_per_year, "sufficient": n >= need}


def trial_sharpes(trials: DataFrame, rf: float = 0.0) -> DataFrame:
    return _sql(trials, TRIAL_SHARPES.replace("<rf>", f"CAST({rf!r} AS DOUBLE)"), trials=trials)


def cscv_values(size: int | str, splits: int) -> dict:
    """``size`` is the periods of a block, a number or SQL for one."""
    low = splits // 2
    table = lambda x, first, bits: (
        f"transform(sequence(CAST(0 AS BIGINT), CAST({(1 << bits) - 1} AS BIGINT)), m -> aggregate(b, 0e0, (total, y) -> total + "
        f"CASE WHEN y.block >= {first} AND y.block < {first + bits} AND (shiftright(m, CAST(y.block AS INT) - {first}) & 1) = 1 THEN y.{x} ELSE 0e0 END))"
    )
    tables = ", ".join(f"{table(x, first, bits)} AS {side}_{x}" for side, first, bits in (("low", 0, low), ("high", low, splits - low)) for x in ("n", "s", "ss"))
    return {"size": size, "splits": splits, "all": 1 << splits, "half": splits // 2, "eps": "1e-30", "low_mask": (1 << low) - 1, "low_bits": low, "tables": tables}


def probability_of_backtest_overfitting(trials: DataFrame, n_splits: int = C.DEFAULT_CSCV_SPLITS) -> dict:
    n_periods, n_configs = trials.agg(F.count_distinct("period_idx"), F.count_distinct("config_idx")).first()
    if n_splits < 2 or n_splits % 2:
        raise OverfitInputError("the number of splits must be even", n_splits, 2)
    if n_configs < 2:
        raise OverfitInputError("a matrix has two configurations at least", n_configs, 2)
    if n_periods // n_splits < 2:
        raise OverfitInputError("a split has two periods at least", n_periods // n_splits, 2)
    v = cscv_values(n_periods // n_splits, n_splits)
    # few rows from here on: a block and configuration each, then a mask and configuration
    blocks = _sql(trials, fill(BLOCKS, v), trials=trials)
    sides = _sql(trials, fill(SIDES, v), blocks=blocks)
    logits = _sql(trials, LOGITS, sides=sides)
    row = _sql(trials, PBO, logits=logits).first()
    return row.asDict() | {"n_splits": n_splits, "periods_used": v["size"] * n_splits}


def less_benchmark(trials: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Trials' returns over those of a benchmark (period_idx, ret), which must have each of their periods once and no other."""
    periods = trials.select("period_idx").distinct().join(benchmark.select("period_idx", F.col("ret").alias("rival")), "period_idx", "full_outer")
    n, lost = periods.agg(F.count("*"), F.count_if(F.col("rival").isNull())).first()
    if lost or n != trials.agg(F.count_distinct("period_idx")).first()[0]:
        raise OverfitInputError("the benchmark must cover exactly the periods of the trials", benchmark.count(), n)
    return trials.join(benchmark.select("period_idx", F.col("ret").alias("rival")), "period_idx").withColumn("ret", F.col("ret") - F.col("rival")).drop("rival")


def superior_predictive_ability(trials: DataFrame, seed: int, n_bootstrap: int = 1000, block_length: float | None = None, rng: str = "xxhash64", benchmark: DataFrame | None = None) -> dict:
    """Against a benchmark's returns (period_idx, ret), or zero without one. One set of draws serves all configurations."""
    if benchmark is not None:
        trials = less_benchmark(trials, benchmark)
    n_obs, n_configs = trials.agg(F.count_distinct("period_idx"), F.count_distinct("config_idx")).first()
    if n_obs < 8:
        raise OverfitInputError("too few periods", n_obs, 8)
    best = trials.groupBy("config_idx").agg(F.avg("ret").alias("m")).agg(F.max(F.struct("m", (-F.col("config_idx")).alias("c")))).first()[0]
    b = block_length if block_length is not None else estimate_block_length(trials.where(F.col("config_idx") == -best.c).select("period_idx", "ret")).block_length
    v = {"n_obs": n_obs, "restart": f"CAST({1 / b!r} AS DOUBLE)", "seed": seed, "stream": "spa"} | (MD5 if rng == "md5" else XXHASH)
    ids = path_ids(trials.sparkSession, n_bootstrap, n_obs, n_obs)
    indices = _sql(trials, fill(INDICES, v), draws=_sql(trials, fill(DRAWS, v), path_ids=ids))
    replicates = _sql(trials, fill(REPLICATES, v), indices=indices, trials=trials)
    row = _sql(trials, fill(SPA, v), trials=trials, replicates=replicates).first()
    return row.asDict() | {"best_config": -best.c, "n_configs": n_configs, "n_periods": n_obs, "n_bootstrap": n_bootstrap, "block_length": b, "seed": seed}
