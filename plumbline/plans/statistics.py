"""Queries of the operators that answer with one record, beside oracles written from their definitions in SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.random import uniform_duck
from ..operators import grid, metrics, overfit, propfirm, regimes, resample, risk, verdict
from ..sources.series import to_period_returns
from . import registry
from .describe import describe_series
from .registry import query_of as query

WEEKLY_DUCK, DAILY_DUCK, TRADES_DUCK, PATHS_DUCK, LABELS_DUCK, TRIALS_DUCK = (r.duck() for r in (registry.weekly, registry.daily, registry.trades, registry.levels, registry.labels, registry.trials))
RF = 0.045
#: The rate of a week, in SQL.
RATE = f"(power(1 + {RF}, 1 / {C.WEEKS_PER_YEAR!r}) - 1)"
Z = NormalDist().inv_cdf(0.975)

#: Centred returns as lists, with their squares beside them; gamma(k) of any two by products of moved lists.
SHARPE_DUCK = f"""
WITH r AS (SELECT period_idx, ret - {RATE} AS e FROM ({WEEKLY_DUCK}) w), m AS (SELECT avg(e) AS mu, avg(e * e) AS s, count(*) AS n FROM r),
l AS (SELECT list(e - mu ORDER BY period_idx) AS x, list(e * e - s ORDER BY period_idx) AS y, max(mu) AS mu, max(s) AS s, max(n) AS n, max(s) - max(mu) * max(mu) AS v FROM r, m),
p AS (SELECT *, greatest(CAST(floor(4 * power(n / 100.0, 2 / 9.0)) AS BIGINT), 1) AS lags FROM l),
g AS (SELECT *, list_transform(generate_series(0, lags), lambda k: list_sum(list_transform(generate_series(k + 1, n), lambda i: x[i] * x[i - k])) / n) AS c FROM p),
b AS (SELECT *, least(CAST(floor(1.1447 * power(4 * power(2 * list_sum(list_transform(generate_series(1, lags), lambda k: k * c[k + 1])) / (c[1] + 2 * list_sum(list_transform(generate_series(1, lags), lambda k: c[k + 1]))), 2) * n, 1 / 3.0)) AS BIGINT), n - 1) AS band FROM g),
o AS (SELECT *, list_transform(generate_series(-band, band), lambda k: 1 - abs(k) / (band + 1.0)) AS w,
             list_transform(generate_series(-band, band), lambda k: list_sum(list_transform(generate_series(1 + greatest(k, 0), n + least(k, 0)), lambda i: x[i] * x[i - k])) / n) AS xx,
             list_transform(generate_series(-band, band), lambda k: list_sum(list_transform(generate_series(1 + greatest(k, 0), n + least(k, 0)), lambda i: x[i] * y[i - k])) / n) AS xy,
             list_transform(generate_series(-band, band), lambda k: list_sum(list_transform(generate_series(1 + greatest(k, 0), n + least(k, 0)), lambda i: y[i] * y[i - k])) / n) AS yy FROM b),
d AS (SELECT *, list_dot_product(w, xx) AS oxx, list_dot_product(w, xy) AS oxy, list_dot_product(w, yy) AS oyy, s / power(v, 1.5) AS g1, -mu / (2 * power(v, 1.5)) AS g2 FROM o),
e AS (SELECT *, sqrt({C.WEEKS_PER_YEAR!r} * (g1 * g1 * oxx + 2 * g1 * g2 * oxy + g2 * g2 * oyy) / n) AS se, sqrt({C.WEEKS_PER_YEAR!r}) * mu / sqrt(v * n / (n - 1)) AS point FROM d)
SELECT n AS n_periods, lags AS lag_selection_parameter, band AS bandwidth, {RATE} AS risk_free_rate_per_period, mu / sqrt(v * n / (n - 1)) AS per_period_sample, mu / sqrt(v) AS per_period_population, point AS annualised_sqrt_q,
       sqrt({C.WEEKS_PER_YEAR!r}) * mu / sqrt(oxx) AS annualised_hac, se AS standard_error, point - {Z!r} * se AS ci_low, point + {Z!r} * se AS ci_high FROM e"""


@query("sharpe_ratio", SHARPE_DUCK, "CAST(n_periods AS BIGINT) AS n_periods", "CAST(lag_selection_parameter AS BIGINT) AS lag_selection_parameter", "CAST(bandwidth AS BIGINT) AS bandwidth", risk_free_rate_per_period=10, per_period_sample=8, per_period_population=8, annualised_sqrt_q=8, annualised_hac=7, standard_error=7, ci_low=7, ci_high=7)
def sharpe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.sharpe_ratio(registry.weekly_rows.frame(spark, sf_dir), C.WEEKS_PER_YEAR, RF)
    keep = ("n_periods", "lag_selection_parameter", "bandwidth", "risk_free_rate_per_period", "per_period_sample", "per_period_population", "annualised_sqrt_q", "annualised_hac", "standard_error", "ci_low", "ci_high")
    return spark.createDataFrame([tuple(got[k] for k in keep)], ", ".join(f"{k} {'long' if k in keep[:3] else 'double'}" for k in keep))


@query("sharpe_without_dispersion", "SELECT 5 AS n_periods, 0 AS bandwidth, true AS undefined", "CAST(n_periods AS BIGINT) AS n_periods", "CAST(bandwidth AS BIGINT) AS bandwidth", "undefined")
def sharpe_without_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.sharpe_ratio(registry.flat.frame(spark, sf_dir).where("log_id = 'flat'"), 12.0)
    return spark.createDataFrame([(got["n_periods"], got["bandwidth"], got["annualised_sqrt_q"] is None and got["ci_low"] is None)], "n_periods long, bandwidth long, undefined boolean")


MERTENS_DUCK = f"""
WITH r AS (SELECT ret, avg(ret) OVER () AS mu, count(*) OVER () AS n FROM ({WEEKLY_DUCK}) w),
m AS (SELECT max(n) AS n, max(mu) / sqrt(avg((ret - mu) ** 2)) AS sr, avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5 AS g, avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2 AS k FROM r)
SELECT sr AS sharpe, g AS skewness, k AS kurtosis, (1 + sr * sr / 2 - g * sr + (k - 3) / 4 * sr * sr) / n * 1e6 AS variance_e6 FROM m"""


@query("mertens_variance", MERTENS_DUCK, sharpe=8, skewness=7, kurtosis=6, variance_e6=6)
def mertens_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, sr, skew, kurt = overfit.sample_moments(registry.weekly_rows.frame(spark, sf_dir))
    return spark.createDataFrame([(sr, skew, kurt, metrics.mertens_sharpe_variance(sr, skew, kurt, n) * 1e6)], "sharpe double, skewness double, kurtosis double, variance_e6 double")


#: The plug-in rule: the first lag after which a run of autocorrelations is small, then a flat-topped sum.
BLOCK_DUCK = f"""
WITH l AS (SELECT list(ret - mu ORDER BY period_idx) AS x, count(*) AS n FROM (SELECT ret, period_idx, avg(ret) OVER () AS mu FROM ({WEEKLY_DUCK}) w) c),
p AS (SELECT *, greatest(5, CAST(ceil(sqrt(log10(n))) AS BIGINT)) AS run, CAST(ceil(sqrt(n)) AS BIGINT) + greatest(5, CAST(ceil(sqrt(log10(n))) AS BIGINT)) AS most FROM l),
g AS (SELECT *, list_transform(generate_series(0, most + run), lambda k: list_sum(list_transform(generate_series(k + 1, n), lambda i: x[i] * x[i - k])) / n) AS c FROM p),
f AS (SELECT *, coalesce(list_min(list_filter(generate_series(1, most), lambda m: list_bool_and(list_transform(c[m + 2 : m + run + 1], lambda v: abs(v / c[1]) < 2 * sqrt(log10(n) / n))))), most) AS m FROM g),
b AS (SELECT *, least(2 * m, most) AS band FROM f),
s AS (SELECT *, list_sum(list_transform(generate_series(-band, band), lambda k: least(1, 2 * (1 - abs(k / CAST(band AS DOUBLE)))) * c[abs(k) + 1])) AS g0, list_sum(list_transform(generate_series(-band, band), lambda k: least(1, 2 * (1 - abs(k / CAST(band AS DOUBLE)))) * abs(k) * c[abs(k) + 1])) AS g1 FROM b)
SELECT n AS n_obs, m AS lag_selection, band AS bandwidth, least(greatest(power(g1 * g1 / (g0 * g0), 1 / 3.0) * power(n, 1 / 3.0), 1), ceil(least(3 * sqrt(n), n / 3.0))) AS block_length FROM s"""


@query("block_length", BLOCK_DUCK, "CAST(n_obs AS BIGINT) AS n_obs", "CAST(lag_selection AS BIGINT) AS lag_selection", "CAST(bandwidth AS BIGINT) AS bandwidth", block_length=6)
def block_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = resample.estimate_block_length(registry.weekly_rows.frame(spark, sf_dir))
    return spark.createDataFrame([(b.n_obs, b.lag_selection, b.bandwidth, b.block_length)], "n_obs long, lag_selection long, bandwidth long, block_length double")


REPS = 200


def drawn_duck(values: str) -> str:
    """(rep, x): resampled copies of ``values`` (x) by the keyed uniform, values numbered in ascending order."""
    u = uniform_duck(3, "interval", "rep", "k")
    return f"v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM ({values}) raw), d AS (SELECT rep, CAST(floor({u} * n) AS BIGINT) AS i FROM (SELECT unnest(range({REPS})) AS rep) a, (SELECT i AS k, n FROM v) b), c AS (SELECT d.rep, v.x FROM d JOIN v ON d.i = v.i)"


TERMINAL_DUCK = f"SELECT arg_max(level, step) / arg_min(level, step) - 1 AS x FROM ({PATHS_DUCK}) p GROUP BY path_id"
INTERVAL_DUCK = f"""
WITH {drawn_duck(TERMINAL_DUCK)}, t AS (SELECT rep, quantile_cont(x, 0.05) AS cut FROM c GROUP BY rep), e AS (SELECT c.rep, max(cut) AS cut, avg(x) FILTER (x <= cut) AS below FROM c JOIN t ON c.rep = t.rep GROUP BY c.rep)
SELECT 'var' AS measure, stddev_samp(-cut) AS standard_error, quantile_cont(-cut, 0.025) AS ci_low, quantile_cont(-cut, 0.975) AS ci_high FROM e
UNION ALL SELECT 'es', stddev_samp(-below), quantile_cont(-below, 0.025), quantile_cont(-below, 0.975) FROM e"""


@query("tail_intervals", INTERVAL_DUCK, "measure", standard_error=8, ci_low=8, ci_high=8)
def tail_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = registry.levels.frame(spark, sf_dir)
    rows = [(name, *(got[k] for k in ("standard_error", "ci_low", "ci_high"))) for name, f in (("var", risk.value_at_risk), ("es", risk.expected_shortfall)) for got in [f(paths, 3, replicates=REPS)]]
    return spark.createDataFrame(rows, "measure string, standard_error double, ci_low double, ci_high double")


BARRIER = 9_500_000.0
HITS = f"SELECT path_id, min(step) FILTER (level <= {BARRIER}) AS hit_at FROM ({PATHS_DUCK}) p GROUP BY path_id"
PASSAGE_DUCK = f"""
WITH {drawn_duck(f"SELECT CASE WHEN hit_at IS NULL THEN 0e0 ELSE 1e0 END AS x FROM ({HITS}) h")}, m AS (SELECT rep, avg(x) AS share FROM c GROUP BY rep), s AS (SELECT avg(CASE WHEN hit_at IS NULL THEN 0e0 ELSE 1e0 END) AS probability, quantile_cont(hit_at, 0.5) AS median_step, max(horizon) AS horizon_steps FROM ({HITS}) h, (SELECT max(step) AS horizon FROM ({PATHS_DUCK}) p) z)
SELECT max(probability) AS probability, 1 - max(probability) AS never_hit_fraction, max(median_step) AS median_step, max(horizon_steps) AS horizon_steps, stddev_samp(share) AS standard_error, quantile_cont(share, 0.025) AS ci_low, quantile_cont(share, 0.975) AS ci_high FROM m, s"""


@query("first_passage", PASSAGE_DUCK, "CAST(horizon_steps AS BIGINT) AS horizon_steps", probability=9, never_hit_fraction=9, median_step=3, standard_error=8, ci_low=8, ci_high=8)
def first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = risk.first_passage(registry.levels.frame(spark, sf_dir), BARRIER, 3, replicates=REPS)
    row = (got["horizon_steps"], got["probability"], got["never_hit_fraction"], got["quantiles"].get(0.5), got["standard_error"], got["ci_low"], got["ci_high"])
    return spark.createDataFrame([row], "horizon_steps long, probability double, never_hit_fraction double, median_step double, standard_error double, ci_low double, ci_high double")


SQRT_N = "sqrt(CAST(n AS DOUBLE))"
#: Two points of the normal distribution for twenty-five trials, from another library's tables.
TRIALS_TRIED = 25
P1, P2 = NormalDist().inv_cdf(1 - 1 / TRIALS_TRIED), NormalDist().inv_cdf(1 - 1 / (TRIALS_TRIED * math.e))
DEFLATED_DUCK = f"""
WITH t AS (SELECT config_id, avg(ret) / stddev_samp(ret) AS sr FROM ({TRIALS_DUCK}) x GROUP BY config_id), v AS (SELECT var_samp(sr) AS tv, max(sr) AS best, arg_max(config_id, (sr, config_id)) AS best_id FROM t),
r AS (SELECT ret, avg(ret) OVER () AS mu, count(*) OVER () AS n FROM ({WEEKLY_DUCK}) w), m AS (SELECT max(n) AS n, max(mu) / sqrt(avg((ret - mu) ** 2)) AS sr, avg((ret - mu) ** 3) / avg((ret - mu) ** 2) ** 1.5 AS g, avg((ret - mu) ** 4) / avg((ret - mu) ** 2) ** 2 AS k FROM r)
SELECT best_id, tv AS trial_variance, sqrt(tv) * ({1 - C.EULER_MASCHERONI!r} * {P1!r} + {C.EULER_MASCHERONI!r} * {P2!r}) AS expected_maximum, sr AS observed_sharpe,
       (sr - sqrt(tv) * ({1 - C.EULER_MASCHERONI!r} * {P1!r} + {C.EULER_MASCHERONI!r} * {P2!r})) * sqrt(n - 1.0) / sqrt(1 - g * sr + (k - 1) / 4 * sr * sr) AS z FROM v, m"""


@query("deflated_sharpe", DEFLATED_DUCK, "best_id", trial_variance=9, expected_maximum=8, observed_sharpe=8, z=6)
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability is shown as its place on the normal distribution."""
    sharpes = overfit.trial_sharpes(registry.trials.frame(spark, sf_dir))
    spread, best = sharpes.agg(F.var_samp("sharpe"), F.max(F.struct("sharpe", "config_id"))).first()
    got = overfit.deflated_sharpe_ratio(registry.weekly_rows.frame(spark, sf_dir), TRIALS_TRIED, spread)
    under = 1 - got["skewness"] * got["observed_sharpe"] + (got["kurtosis"] - 1) / 4 * got["observed_sharpe"] ** 2
    z = (got["observed_sharpe"] - got["expected_maximum"]) * math.sqrt(got["n_periods"] - 1) / math.sqrt(under)
    if not math.isclose(NormalDist().cdf(z), got["probability"], abs_tol=1e-12):
        raise AssertionError("the probability doesn't belong to its place")
    return spark.createDataFrame([(best.config_id, got["trial_variance"], got["expected_maximum"], got["observed_sharpe"], z)], "best_id string, trial_variance double, expected_maximum double, observed_sharpe double, z double")


SPA_BENCH = f"""
WITH t AS ({TRIALS_DUCK}), b AS (SELECT period_idx, avg(ret) AS rival FROM t GROUP BY period_idx)
SELECT config_id, count(*) AS n, sum(ret - rival) / count(*) AS mean FROM t JOIN b ON t.period_idx = b.period_idx GROUP BY config_id"""


@query("trials_less_benchmark", SPA_BENCH, "config_id", "n", mean=10)
def trials_less_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each configuration over the mean of all, as the test of superior ability takes them."""
    t = registry.trials.frame(spark, sf_dir)
    less = overfit.less_benchmark(t, t.groupBy("period_idx").agg(F.avg("ret").alias("ret")))
    return less.groupBy("config_id").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"))


#: Sessions a year from the weekdays themselves; rungs as ``select_grid`` judges them.
GRID_DUCK = f"""
WITH s AS (SELECT unnest(generate_series(CAST(min(make_timestamp(exit_ns // 1000)) AS DATE) - INTERVAL 7 DAY, CAST(max(make_timestamp(exit_ns // 1000)) AS DATE) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS d FROM ({TRADES_DUCK}) t),
k AS (SELECT count(*) AS n, date_diff('day', min(d), max(d)) / 365.25 AS years FROM s WHERE isodow(d) < 6)
SELECT period, CASE period WHEN 'DAILY' THEN (SELECT (n - 1) / years FROM k) WHEN 'WEEKLY' THEN 365.25 / 7 ELSE 12 END AS periods_per_year, n_periods FROM (
  SELECT 'DAILY' AS period, count(*) AS n_periods FROM ({DAILY_DUCK}) d) x"""


@query("grid_choice", GRID_DUCK, "period", "n_periods", periods_per_year=6)
def grid_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen rung with its rate and number of periods, after the calendar was found to cover the log.

    Returns are on the initial capital, so a log that uses its equity up has a rung too.
    """
    t = registry.trades.frame(spark, sf_dir).cache()
    choice = grid.select_grid(t)
    n = grid.period_returns(t, choice.period, capital=1e7).count()
    t.unpersist()
    return spark.createDataFrame([(choice.period, choice.periods_per_year, n)], "period string, periods_per_year double, n_periods long")


STATES_DUCK = f"""
WITH l AS (SELECT joint, CASE WHEN joint < 0 THEN -1 ELSE CASE WHEN joint // 3 >= 2 THEN 2 ELSE 0 END + CASE WHEN joint % 3 >= 2 THEN 1 ELSE 0 END END AS two FROM ({LABELS_DUCK}) x)
SELECT two AS joint, count(*) AS n FROM l GROUP BY two"""


@query("collapsed_states", STATES_DUCK, "CAST(joint AS BIGINT) AS joint", "n")
def collapsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = regimes.collapse(registry.labels.frame(spark, sf_dir), C.DEFAULT_STATES_PER_AXIS, C.DEFAULT_STATES_PER_AXIS)
    return two.groupBy("joint").agg(F.count("*").alias("n"))


@query("aligned_attribution", f"WITH l AS ({LABELS_DUCK}), s AS (SELECT l.joint, sum(w.ret) AS total, count(*) AS n FROM ({WEEKLY_DUCK}) w JOIN l ON w.period_idx = l.period_idx WHERE l.joint >= 0 GROUP BY l.joint) SELECT joint, n, total, abs(total) / (SELECT sum(abs(total)) FROM s) AS share FROM s", "CAST(joint AS BIGINT) AS joint", "n", total=9, share=8)
def aligned_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's returns by the regime of the same period, where every period must have its partner."""
    returns = registry.weekly_rows.frame(spark, sf_dir)
    beside = registry.labels.frame(spark, sf_dir).join(returns.select("period_idx", "period_end_ns"), "period_idx")
    return regimes.attribute_by_regime(regimes.aligned_labels(returns, beside))


#: A path through the states by recursion, with the pools and cumulative rows of the matrix as lists.
N_MARKOV, MARKOV_STEPS, SEED = 50, 100, 7
U = lambda stream, k: uniform_duck(SEED, stream, "path_id", k)
MARKOV_DUCK = f"""
WITH RECURSIVE l AS (SELECT period_idx, ret, joint FROM ({LABELS_DUCK}) x), thin AS (SELECT min(n) < {C.MIN_STATE_OBS} AS yes FROM (SELECT count(*) AS n FROM l WHERE joint >= 0 GROUP BY joint) y),
j AS (SELECT period_idx, ret, CASE WHEN joint < 0 THEN -1 WHEN (SELECT yes FROM thin) THEN CASE WHEN joint // 3 >= 2 THEN 2 ELSE 0 END + CASE WHEN joint % 3 >= 2 THEN 1 ELSE 0 END ELSE joint END AS s FROM l),
st AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place, list(ret ORDER BY ret) AS pool, count(*) AS n FROM j WHERE s >= 0 GROUP BY s),
mv AS (SELECT s AS src, lead(s) OVER (ORDER BY period_idx) AS dst FROM j), cn AS (SELECT src, dst, count(*) AS n FROM mv WHERE src >= 0 AND dst >= 0 GROUP BY src, dst),
pr AS (SELECT a.place AS src, b.place AS dst, CASE WHEN t.n IS NULL THEN 1.0 / (SELECT count(*) FROM st) ELSE coalesce(c.n, 0) / CAST(t.n AS DOUBLE) END AS p FROM st a CROSS JOIN st b LEFT JOIN cn c ON c.src = a.s AND c.dst = b.s LEFT JOIN (SELECT src, sum(n) AS n FROM cn GROUP BY src) t ON t.src = a.s),
cu AS (SELECT src, list(c ORDER BY dst) AS cum FROM (SELECT src, dst, sum(p) OVER (PARTITION BY src ORDER BY dst) AS c FROM pr) z GROUP BY src),
f AS (SELECT list(c ORDER BY place) AS cum FROM (SELECT place, sum(n / CAST((SELECT sum(n) FROM st) AS DOUBLE)) OVER (ORDER BY place) AS c FROM st) z),
last AS (SELECT max(place) AS top FROM st),
walk AS (
  SELECT path_id, 0 AS step, least(len(list_filter(f.cum, lambda c: {U("state", "0")} > c)), top) AS place FROM (SELECT unnest(range({N_MARKOV})) AS path_id) p, f, last
  UNION ALL SELECT path_id, step + 1, least(len(list_filter(cu.cum, lambda c: {U("state", "step + 1")} > c)), top) FROM walk JOIN cu ON cu.src = walk.place, last WHERE step + 1 < {MARKOV_STEPS})
SELECT path_id, step, pool[1 + CAST(floor({U("draw", "step")} * n) AS BIGINT)] AS ret FROM walk JOIN st ON walk.place = st.place"""


@query("markov_paths", MARKOV_DUCK, "path_id", "CAST(step AS BIGINT) AS step", ret=9)
def markov_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.markov_resample(registry.labels.frame(spark, sf_dir), N_MARKOV, SEED, MARKOV_STEPS, allow_collapse=True)


#: The desk's days one after the other.
D = registry.DESK
DESK_DUCK = f"""
WITH RECURSIVE p AS (SELECT path_id, step, level - lag(level) OVER (PARTITION BY path_id ORDER BY step) AS x FROM ({PATHS_DUCK}) q),
days AS (SELECT path_id, list(x ORDER BY step) AS xs FROM p WHERE x IS NOT NULL GROUP BY path_id),
run AS (
  SELECT path_id, xs, 0 AS day, 0 AS outcome, {D.account_size}::DOUBLE AS equity, {D.account_size}::DOUBLE AS peak, 0 AS traded, -1 AS pass_day, false AS alive, -1 AS since, {D.account_size}::DOUBLE AS fe, {D.account_size}::DOUBLE AS fp, 0::DOUBLE AS payouts, -1 AS first_payout FROM days
  UNION ALL
  SELECT path_id, xs, day + 1, o, e, pk, tr, CASE WHEN outcome = 0 AND o = 1 THEN day + 1 ELSE pass_day END, (alive AND NOT blown) OR (outcome = 0 AND o = 1), CASE WHEN outcome = 0 AND o = 1 THEN day ELSE since END,
         CASE WHEN pays THEN {D.account_size} ELSE f1 END, CASE WHEN pays THEN {D.account_size} ELSE f2 END, payouts + CASE WHEN pays THEN due ELSE 0 END, CASE WHEN pays AND first_payout < 0 THEN day + 1 ELSE first_payout END
  FROM (SELECT *, act AND NOT blown AND day > since AND (day - since) % {D.funded.payout_cycle_days} = 0 AND due >= {D.funded.min_payout} AND due > 0 AS pays
        FROM (SELECT *, act AND f1 <= f2 - {D.funded.max_loss} AS blown, greatest(f1 - {D.account_size}, 0) * {D.funded.profit_split} AS due,
                     CASE WHEN outcome <> 0 THEN outcome WHEN x < -{D.daily_loss_limit} THEN 2 WHEN e <= pk - {D.max_loss} THEN 3 WHEN e >= {D.account_size + D.profit_target} AND tr >= {D.min_trading_days} THEN 1 WHEN day + 1 >= {D.max_evaluation_days} THEN 4 ELSE 0 END AS o
              FROM (SELECT *, greatest(peak, e) AS pk, CASE WHEN act THEN greatest(fp, f1) ELSE fp END AS f2
                    FROM (SELECT *, CASE WHEN outcome = 0 THEN equity + x ELSE equity END AS e, traded + CASE WHEN outcome = 0 AND x <> 0 THEN 1 ELSE 0 END AS tr, CASE WHEN act THEN fe + x ELSE fe END AS f1
                          FROM (SELECT *, xs[day + 1] AS x, alive AND since < day AS act FROM run WHERE day < len(xs)) a) b) c) d) g)
SELECT path_id, CASE WHEN outcome = 0 THEN 5 ELSE outcome END AS outcome, pass_day AS days_to_pass, first_payout AS days_to_first_payout, payouts, payouts - {D.evaluation_fee} + CASE WHEN pass_day >= 0 THEN {D.evaluation_fee if D.fee_refunded_on_pass else 0.0} ELSE 0 END AS net_value
FROM run WHERE day = len(xs)"""


@query("propfirm_outcomes", DESK_DUCK, "path_id", "CAST(outcome AS INT) AS outcome", "CAST(days_to_pass AS INT) AS days_to_pass", "CAST(days_to_first_payout AS INT) AS days_to_first_payout", payouts=2, net_value=2)
def propfirm_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propfirm.path_outcomes(registry.levels.frame(spark, sf_dir), D)


@query("propfirm_summary", f"SELECT avg(CASE WHEN days_to_pass >= 0 THEN 1e0 ELSE 0e0 END) AS pass_probability, avg(CASE WHEN days_to_first_payout >= 0 THEN 1e0 ELSE 0e0 END) AS payout_probability, avg(net_value) AS expected_net_value, quantile_cont(net_value, 0.75) AS upper, quantile_cont(days_to_pass, 0.5) FILTER (days_to_pass >= 0) AS median_days, count(*) AS n_paths FROM ({DESK_DUCK}) d", "n_paths", pass_probability=9, payout_probability=9, expected_net_value=2, upper=2, median_days=3)
def propfirm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = propfirm.evaluate(registry.levels.frame(spark, sf_dir), D)
    row = (got["n_paths"], got["pass_probability"], got["payout_probability"], got["expected_net_value"], got["net_value_percentiles"][0.75], got["days_to_pass"].get(0.5))
    return spark.createDataFrame([row], "n_paths long, pass_probability double, payout_probability double, expected_net_value double, upper double, median_days double")


#: Cumulative prospect value from its definition: differences of the weighting function of tail probabilities.
CPT = verdict.Preferences()
CPT_DUCK = f"""
WITH o AS (SELECT config_id AS candidate, ret AS x, count(*) OVER (PARTITION BY config_id) AS n, row_number() OVER (PARTITION BY config_id ORDER BY ret) AS i FROM ({TRIALS_DUCK}) t),
q AS (SELECT candidate, x, i / CAST(n AS DOUBLE) AS a, (i - 1) / CAST(n AS DOUBLE) AS b, (n - i + 1) / CAST(n AS DOUBLE) AS c, (n - i) / CAST(n AS DOUBLE) AS d FROM o),
v AS (SELECT candidate, sum(CASE WHEN x < 0 THEN -{CPT.loss_aversion} * (-x) ** {CPT.beta} * (a ** {CPT.delta} / (a ** {CPT.delta} + (1 - a) ** {CPT.delta}) ** (1 / {CPT.delta}) - b ** {CPT.delta} / (b ** {CPT.delta} + (1 - b) ** {CPT.delta}) ** (1 / {CPT.delta}))
                              ELSE x ** {CPT.alpha} * (c ** {CPT.gamma} / (c ** {CPT.gamma} + (1 - c) ** {CPT.gamma}) ** (1 / {CPT.gamma}) - d ** {CPT.gamma} / (d ** {CPT.gamma} + (1 - d) ** {CPT.gamma}) ** (1 / {CPT.gamma})) END) AS v FROM q GROUP BY candidate),
e AS (SELECT candidate, CASE WHEN v >= 0 THEN v ** (1 / {CPT.alpha}) ELSE -((-v / {CPT.loss_aversion}) ** (1 / {CPT.beta})) END AS certainty_equivalent FROM v)
SELECT candidate, certainty_equivalent * 1e3 AS equivalent_e3, row_number() OVER (ORDER BY certainty_equivalent DESC, candidate) AS place FROM e"""


@query("rank_configurations", CPT_DUCK, "candidate", "CAST(place AS BIGINT) AS place", equivalent_e3=6)
def rank_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by the certainty equivalent of their weekly returns."""
    t = registry.trials.frame(spark, sf_dir)
    found = frozenset(C.DEFAULT_RANKING_REQUIREMENTS)
    names = [r[0] for r in t.select("config_id").distinct().orderBy("config_id").collect()]  # a row a configuration
    ranked = verdict.rank([verdict.Candidate(n, t.where(F.col("config_id") == n).select(F.col("ret").alias("outcome")), found) for n in names])["ranked"]
    return spark.createDataFrame([(r["name"], k + 1, r["certainty_equivalent"] * 1e3) for k, r in enumerate(ranked)], "candidate string, place long, equivalent_e3 double")


#: Days of all events as a level series that grows; growth over the first level, rate from its own span.
DESCRIBED_DUCK = """
WITH l AS (SELECT CAST(ts AS DATE) AS d, sum(abs(value)) + 1 AS level FROM events GROUP BY 1), r AS (SELECT d, level, level / lag(level) OVER (ORDER BY d) - 1 AS ret FROM l),
s AS (SELECT count(*) AS n, (count(*) - 1) / (date_diff('day', min(d), max(d)) / 365.25) AS q, arg_max(level, d) / arg_min(level, d) AS grown, avg(ret) AS m, stddev_samp(ret) AS sd FROM r)
SELECT 'DAILY' AS period, n AS n_observations, q AS periods_per_year, grown - 1 AS cumulative_return, ln(grown) * q / (n - 1) AS log_growth, sqrt(q) * m / sd AS sharpe_annualised, sqrt(q) * sd AS volatility_annualised FROM s"""


@query("describe_series", DESCRIBED_DUCK, "period", "n_observations", periods_per_year=6, cumulative_return=8, log_growth=6, sharpe_annualised=7, volatility_annualised=7)
def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    levels = events.groupBy(F.unix_date(F.col("ts").cast("date")).cast("long").alias("day")).agg((F.sum(F.abs("value")) + 1).alias("value"))
    levels = spark.sql("SELECT 'all' AS series_id, row_number() OVER (ORDER BY day) - 1 AS obs_idx, day, value FROM {levels}", levels=levels)
    got = describe_series(levels)
    if to_period_returns(levels).count() != got["n_periods"]:
        raise AssertionError("a period is lost")
    row = (got["period"], got["n_observations"], got["periods_per_year"], got["cumulative_return"], math.log1p(got["cagr"]), got["sharpe_annualised"], got["volatility_annualised"])
    return spark.createDataFrame([row], "period string, n_observations long, periods_per_year double, cumulative_return double, log_growth double, sharpe_annualised double, volatility_annualised double")


#: Closed forms, by active fraction; the ratio of a diluted series is also measured on two-valued returns.
CLOSED_DUCK = """
WITH p AS (SELECT (r_regionkey + 1) / 10.0 AS p FROM region)
SELECT p, (p * (1 - p) ** 4 + (1 - p) * p ** 4) / (p * (1 - p) ** 2 + (1 - p) * p ** 2) ** 2 AS kurtosis, 1 / sqrt(1 + (1 - p) * 0.04) AS dilution_annualised, sqrt(p / (1 + (1 - p) * 0.04)) AS dilution_per_period, 1 / sqrt(10 * p) AS one_period, 0.25 * 50 * p AS tolerance FROM p"""


@query("closed_forms", CLOSED_DUCK, p=3, kurtosis=9, dilution_annualised=9, dilution_per_period=9, one_period=9, tolerance=9)
def closed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/region.parquet").count()
    ps = [k / 10 for k in range(1, n + 1)]
    rows = [(p, C.sparsity_kurtosis(p), C.dilution_ratio_annualised(p, 0.2), C.dilution_ratio_per_period(p, 0.2), C.degenerate_annual_sharpe(10 * p), C.pnl_atol(0.25, 50, p)) for p in ps]
    return spark.createDataFrame(rows, "p double, kurtosis double, dilution_annualised double, dilution_per_period double, one_period double, tolerance double")
