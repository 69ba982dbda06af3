"""Queries of the validation engine by name, over the star-schema tables, and the SQL that gives the same rows.

A query is a chain of relations (``functions.dialect``): the operators' own texts, composed into one Spark plan.
Money is rounded to cents and ratios to nine places, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import constants as C
from ..functions.dialect import Relation, even_rounds
from ..functions.special import normal_cdf_sql
from ..operators import grid, metrics, overfit, regimes, resample, risk, verdict
from ..operators.propfirm import DeskRules, FundedRules
from ..sources.testdata import CAPITAL, TRADES
from ..operators.validate import COUNTS
from . import independent

R = Relation
CAP = f"CAST({CAPITAL!r} AS DOUBLE)"
RF = 0.045 / C.WEEKS_PER_YEAR
CAPV, FIXED, RFV, PPY = (("capital", CAP),), (("growth", metrics.GROWTH[C.FIXED_INITIAL]),), (("rf", f"CAST({RF!r} AS DOUBLE)"),), (("ppy", f"CAST({C.WEEKS_PER_YEAR!r} AS DOUBLE)"),)

# ---- relations ------------------------------------------------------------------------------------------------------

trades = R("trades", TRADES, values=(("log", "'book'"),))
by_symbol = R("trades", TRADES, values=(("log", "symbol"),))


def sessions_of(t: Relation) -> Relation:
    bounds = R("bounds", grid.BOUNDS, (t,))
    return R("sessions", grid.SESSIONS, (bounds,), (("lo", "first_day - 7"), ("hi", "last_day + 7"), ("close_ns", 75_600_000_000_000)))


sessions = sessions_of(trades)

#: Written apart for the other engine: an as-of join instead of days, calendar functions instead of arithmetic.
DAILY_ASOF = """
SELECT t.log_id, t.trade_id, t.entry_ns, t.exit_ns, t.pnl, s.close_ns AS period_end_ns FROM {trades} t ASOF JOIN {sessions} s ON t.exit_ns <= s.close_ns"""
WEEKLY_TRUNC = """
SELECT log_id, trade_id, entry_ns, exit_ns, pnl, epoch_us(date_trunc('week', make_timestamp(exit_ns // 1000)) + INTERVAL 7 DAY) * 1000 - 1 AS period_end_ns FROM {trades}"""
MONTHLY_TRUNC = """
SELECT log_id, trade_id, entry_ns, exit_ns, pnl, epoch_us(date_trunc('month', make_timestamp(exit_ns // 1000)) + INTERVAL 1 MONTH) * 1000 - 1 AS period_end_ns FROM {trades}"""
MONTHLY_SERIES = """
SELECT log_id, epoch_us(unnest(generate_series(make_timestamp((lo + 1) // 1000), make_timestamp((hi + 1) // 1000), INTERVAL 1 MONTH))) * 1000 - 1 AS period_end_ns
FROM (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {totals} GROUP BY log_id) k"""
WEEKLY_SERIES = """
SELECT log_id, unnest(generate_series(lo, hi, 604800000000000)) AS period_end_ns FROM (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {totals} GROUP BY log_id) k"""

DAILY_RANGE = """
SELECT k.log_id, s.close_ns AS period_end_ns FROM {sessions} s
JOIN (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {totals} GROUP BY log_id) k ON s.close_ns BETWEEN k.lo AND k.hi"""


def sums_of(t: Relation, period: str) -> Relation:
    if period == "DAILY":
        s = sessions_of(t)
        totals = R("totals", grid.TOTALS, (R("keyed", grid.DAILY_KEY, (t, s), other=DAILY_ASOF),), stage=True)
        g = R("grid", grid.DAILY_GRID, (totals, s), other=DAILY_RANGE)
    elif period == "WEEKLY":
        totals = R("totals", grid.TOTALS, (R("keyed", grid.WEEKLY_KEY, (t,), other=WEEKLY_TRUNC),), stage=True)
        g = R("grid", grid.WEEKLY_GRID, (totals,), other=WEEKLY_SERIES)
    else:
        totals = R("totals", grid.TOTALS, (R("keyed", grid.MONTHLY_KEY, (t,), other=MONTHLY_TRUNC),), stage=True)
        g = R("grid", grid.MONTHLY_GRID, (totals,), other=MONTHLY_SERIES)
    return R("sums", grid.PERIOD_SUMS, (g, totals))


def returns_of(t: Relation, period: str, basis: str = C.FIXED_INITIAL) -> Relation:
    return R("returns", grid.RETURNS[basis], (sums_of(t, period),), CAPV)


#: The oracle's own running sum: one window over the whole log.
RUNNING_PLAIN = """
SELECT log_id, trade_id, exit_ns, pnl, row_number() OVER (PARTITION BY log_id ORDER BY exit_ns, trade_id) - 1 AS trade_idx,
       <capital> + sum(pnl) OVER (PARTITION BY log_id ORDER BY exit_ns, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM {trades}"""
running = R("running", "running equity", (trades,), CAPV, other=RUNNING_PLAIN, run=lambda trades: grid.running_equity(trades, CAPITAL))
weekly, daily, monthly = (returns_of(trades, p) for p in ("WEEKLY", "DAILY", "MONTHLY"))
trade_ret = R("returns", grid.TRADE_RETURNS[C.FIXED_INITIAL], (running,), CAPV)
centred = R("centred", metrics.CENTRED, (weekly,), RFV)
#: The oracle's lag table: a window shift for each lag instead of a join.
gammas = R("gammas", metrics.AUTOCOVARIANCE, (centred,), (("max_lag", 40),), other=independent.AUTOCOVARIANCE, stage=True)
bands = R("bandwidths", metrics.BANDWIDTH, (gammas,))
curve = R("curve", metrics.EQUITY, (weekly,), CAPV)

PATHS = 200
#: Draws cover the log's own number of periods, whatever it is.
DRAW = {"seed": 7, "restart": "CAST(0.25 AS DOUBLE)"}


def paths_of(returns: Relation, stream: str) -> tuple[Relation, Relation]:
    """(path ids, indices of drawn periods) over the periods of a relation of returns."""
    ids = R("path_ids", resample.PATH_IDS, (returns,), (("n_paths", PATHS),))
    duck = resample.fill(resample.DRAWS, DRAW | {"stream": stream} | resample.MD5_DUCK).replace("explode(sequence(", "unnest(generate_series(").replace("STRING", "VARCHAR")
    draws = R("draws", resample.fill(resample.DRAWS, DRAW | {"stream": stream} | resample.MD5), (ids,), other=duck)
    return ids, R("indices", resample.INDICES, (draws,), other=resample.INDICES_DUCK)


weekly_rows = R("returns", "SELECT * FROM {weekly}", (R("weekly", "SELECT * FROM {returns}", (weekly,)),), stage=True)
ids, indices = paths_of(weekly_rows, "path")
levels = R("paths", resample.LEVELS, (indices, weekly_rows, ids), CAPV, stage=True)
terminals = R("terminals", risk.TERMINAL, (levels,))
drawdowns = R("drawdowns", risk.DRAWDOWNS, (levels,))
passages = R("passages", risk.PASSAGE, (levels,), (("barrier", "CAST(9500000.0 AS DOUBLE)"),))
steps = R("steps", risk.STEP_RETURNS[C.FIXED_INITIAL], (levels,))

trial_returns = R("returns", "SELECT * FROM {by_symbol}", (R("by_symbol", "SELECT * FROM {returns}", (returns_of(by_symbol, "WEEKLY"),)),), stage=True)
#: Configurations and periods are numbered apart, a row each, and joined back.
TRIALS = """
WITH ends AS (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {returns} GROUP BY log_id),
kept AS (SELECT r.log_id, r.period_end_ns, r.ret FROM {returns} r JOIN (SELECT max(lo) AS lo, min(hi) AS hi FROM ends) c ON r.period_end_ns >= c.lo AND r.period_end_ns <= c.hi),
configs AS (SELECT log_id, row_number() OVER (ORDER BY log_id) - 1 AS config_idx FROM ends),
periods AS (SELECT period_end_ns, row_number() OVER (ORDER BY period_end_ns) - 1 AS period_idx FROM (SELECT DISTINCT period_end_ns FROM kept) d)
SELECT k.log_id AS config_id, k.period_end_ns, k.ret, c.config_idx, p.period_idx FROM kept k JOIN configs c ON k.log_id = c.log_id JOIN periods p ON k.period_end_ns = p.period_end_ns"""
TRIALS_RANKED = """
SELECT r.log_id AS config_id, r.period_end_ns, r.ret, dense_rank() OVER (ORDER BY r.log_id) - 1 AS config_idx, dense_rank() OVER (ORDER BY r.period_end_ns) - 1 AS period_idx
FROM {returns} r JOIN (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {returns} GROUP BY log_id) w) c ON r.period_end_ns BETWEEN c.lo AND c.hi"""
trials = R("trials", TRIALS, (trial_returns,), other=TRIALS_RANKED, stage=True)
CSCV = tuple(overfit.cscv_values("(SELECT CAST(count(DISTINCT period_idx) AS BIGINT) div 16 FROM {trials})", 16).items())
blocks = R("blocks", overfit.BLOCKS, (trials,), CSCV)
sides = R("sides", overfit.SIDES, (blocks,), CSCV, other=independent.SIDES)
logits = R("logits", overfit.LOGITS, (sides,), other=independent.LOGITS, stage=True)
SPA_N = (("n_obs", "(SELECT count(DISTINCT period_idx) FROM {trials})"),)
_, spa_indices = paths_of(R("returns", "SELECT * FROM {trials}", (trials,)), "spa")
replicates = R("replicates", overfit.REPLICATES, (spa_indices, trials), SPA_N, other=independent.REPLICATES, stage=True)
spa = R("spa", overfit.SPA, (trials, replicates), SPA_N)

REG = tuple(regimes.regime_values().items())
trailing = R("trailing", regimes.TRAILING, (daily,), REG)
weekly_trailing = R("trailing", regimes.TRAILING, (weekly,), REG)
labels = R("labels", "regime labels", (weekly_trailing,), REG, other=independent.LABELS, stage=True, run=lambda trailing: regimes.label_states(trailing, *(dict(REG)[k] for k in ("n_trend", "n_vol", "warmup"))))
attribution = R("attribution", regimes.ATTRIBUTION, (labels,))
moments = R("moments", overfit.MOMENTS, (centred,))
prefs = verdict.Preferences()
outcomes = R("outcomes", "SELECT 'all' AS candidate, terminal AS outcome FROM {terminals} UNION ALL SELECT 'low' AS candidate, terminal - 0.01e0 AS outcome FROM {terminals}", (terminals,))
weighted = R("weighted", verdict.weights_sql(prefs), (outcomes,))
values = R("values_of", verdict.values_sql(prefs), (weighted,))
event_days = R("series", "SELECT event_type AS series_id, CAST(unix_date(CAST(ts AS DATE)) AS BIGINT) AS day, sum(value) AS level FROM {events} GROUP BY event_type, CAST(unix_date(CAST(ts AS DATE)) AS BIGINT)")

# ---- queries --------------------------------------------------------------------------------------------------------

_FOUND: dict[str, Relation] = {}


def query(name: str, sql: str, *inputs: Relation) -> None:
    _FOUND[name] = R("result", even_rounds(sql), inputs)


def _r(expr: str, places: int = 9, name: str | None = None) -> str:
    return f"round({expr}, {places}) AS {name or expr}"


FLAGSHIP = "weekly_performance"
query(
    "weekly_performance",
    "SELECT m.log_id, m.n_periods, " + ", ".join(_r(c) for c in ("active_fraction", "cagr", "volatility_annualised", "sharpe_annualised", "sortino", "max_drawdown", "time_underwater")) + ", max_drawdown_duration, recovered FROM {pm} m JOIN {dd} d ON m.log_id = d.log_id",
    R("pm", metrics.PERIOD_METRICS, (weekly,), FIXED + RFV + PPY, other=independent.PERIOD_METRICS),
    R("dd", metrics.DRAWDOWN, (curve,), CAPV, other=independent.DRAWDOWN),
)
query("trade_log_canonical", "SELECT log_id, trade_id, symbol, side, qty, multiplier, entry_ns, exit_ns, entry_px, round(exit_px, 6) AS exit_px, round(fees, 6) AS fees, round(pnl, 4) AS pnl FROM {trades}", trades)
query("gross_pnl", "SELECT symbol, count(*) AS n, round(sum(gross_pnl), 2) AS gross, round(sum(fees), 4) AS fees FROM {trades} GROUP BY symbol", trades)
query("validation_counts", COUNTS, trades)
query("running_equity", "SELECT log_id, trade_id, trade_idx, round(equity, 2) AS equity FROM {running}", running)
query("trade_returns_fixed", "SELECT log_id, trade_idx, round(ret, 9) AS ret FROM {returns}", trade_ret)
query("trade_returns_current_equity", "SELECT log_id, trade_idx, round(ret, 9) AS ret FROM {returns}", R("returns", grid.TRADE_RETURNS[C.CURRENT_EQUITY], (running,), CAPV))
query("sessions_weekdays", "SELECT session_idx, prev_close_ns, close_ns FROM {sessions}", sessions)
for _p, _rel in (("daily", daily), ("weekly", weekly), ("monthly", monthly)):
    query(f"period_returns_{_p}", "SELECT log_id, period_idx, period_end_ns, n_trades, round(ret, 9) AS ret FROM {returns}", _rel)
query("period_returns_weekly_current_equity", "SELECT log_id, period_idx, period_end_ns, n_trades, round(ret, 9) AS ret FROM {returns}", returns_of(trades, "WEEKLY", C.CURRENT_EQUITY))
query("period_returns_by_symbol", "SELECT log_id, period_idx, period_end_ns, n_trades, round(ret, 9) AS ret FROM {returns}", trial_returns)
_rungs = tuple(R(f"rung_{p.lower()}", grid.DIAGNOSIS, (sums_of(trades, p), trades), (("period", p), ("nominal_ns", f"{float(grid.NOMINAL_NS[p])}e0"))) for p in C.PERIODS)
query("grid_diagnosis", " UNION ALL ".join(f"SELECT log_id, period, n_periods, round(active_fraction, 9) AS active_fraction, round(holding_ratio, 9) AS holding_ratio, feasible FROM {{{r.name}}}" for r in _rungs), *_rungs)
query("select_grid", "SELECT log_id, min_by(period, place) AS chosen FROM (" + " UNION ALL ".join(f"SELECT log_id, period, {k} AS place FROM {{{r.name}}} WHERE feasible" for k, r in enumerate(_rungs)) + ") f GROUP BY log_id", *_rungs)
query("observed_grid_gaps", "SELECT series_id, modal_gap, period, n_obs, round(excess, 9) AS excess FROM {gaps}", R("gaps", grid.GAPS, (event_days,)))
query("trade_metrics", "SELECT log_id, n_trades, n_wins, n_losses, " + ", ".join(_r(c) for c in ("expectancy", "hit_rate", "profit_factor", "win_loss_ratio", "mean_win", "mean_loss", "largest_win", "largest_loss", "skewness", "kurtosis")) + " FROM {tm}", R("tm", metrics.TRADE_METRICS, (trade_ret,)))
PM = "SELECT log_id, n_periods, " + ", ".join(_r(c) for c in ("active_fraction", "years", "cumulative_return", "cagr", "volatility_annualised", "sharpe_per_period", "sharpe_annualised", "sortino")) + ", round(kelly, 6) AS kelly FROM {pm}"
MONTH = FIXED + (("rf", f"CAST({0.045 / 12!r} AS DOUBLE)"), ("ppy", "12e0"))
query("period_metrics", PM, R("pm", metrics.PERIOD_METRICS, (monthly,), MONTH, other=independent.PERIOD_METRICS))
query("period_metrics_compounded", PM, R("pm", metrics.PERIOD_METRICS, (returns_of(trades, "WEEKLY", C.CURRENT_EQUITY),), (("growth", metrics.GROWTH[C.CURRENT_EQUITY]),) + RFV + PPY, other=independent.PERIOD_METRICS.replace("<growth>", "product(1e0 + ret)")))
#: Returns without dispersion, a total loss and losses that never come: a log each, as long as there are regions.
flat = R("returns", "SELECT 'flat' AS log_id, CAST(r_regionkey AS BIGINT) AS period_idx, 0.01e0 AS ret, 1 AS n_trades FROM {region} UNION ALL SELECT 'lost' AS log_id, CAST(r_regionkey AS BIGINT) AS period_idx, CASE WHEN r_regionkey = 2 THEN -1e0 ELSE 0.5e0 END AS ret, 1 AS n_trades FROM {region} UNION ALL SELECT 'idle' AS log_id, CAST(r_regionkey AS BIGINT) AS period_idx, 0e0 AS ret, 0 AS n_trades FROM {region}")
query("period_metrics_degenerate", PM, R("pm", metrics.PERIOD_METRICS, (flat,), (("growth", metrics.GROWTH[C.CURRENT_EQUITY]), ("rf", "0e0"), ("ppy", "12e0")), other=independent.PERIOD_METRICS.replace("<growth>", "product(1e0 + ret)")))
query("equity_curve", "SELECT log_id, period_idx, round(equity, 2) AS equity FROM {curve}", curve)
query("drawdown_profile", "SELECT log_id, round(max_drawdown, 9) AS max_drawdown, max_drawdown_duration, recovered, round(time_underwater, 9) AS time_underwater FROM {dd}", R("dd", metrics.DRAWDOWN, (curve,), CAPV, other=independent.DRAWDOWN))
query("autocovariances", "SELECT log_id, lag, round(gamma * 1e6, 9) AS gamma_e6 FROM {gammas}", gammas)
query("newey_west_bandwidth", "SELECT log_id, n, lags, bandwidth FROM {bandwidths}", bands)
query("hac_variance", "SELECT log_id, bandwidth, round(long_run_variance * 1e6, 9) AS long_run_variance_e6 FROM {lrv}", R("lrv", metrics.LONG_RUN_VARIANCE, (gammas, bands)))
query("bootstrap_indices", "SELECT path_id, step, src_idx FROM {indices}", indices)
query("bootstrap_terminal", "SELECT path_id, round(terminal, 9) AS terminal FROM {terminals}", terminals)
query("bootstrap_max_drawdown", "SELECT path_id, round(max_drawdown, 9) AS max_drawdown FROM {drawdowns}", drawdowns)
query("var_es", "SELECT round(value_at_risk, 9) AS value_at_risk, round(expected_shortfall, 9) AS expected_shortfall, n_paths FROM {tail}", R("tail", risk.TAIL, (terminals,), (("tail", "0.05e0"),), other=independent.TAIL))
query("drawdown_quantiles", "SELECT " + ", ".join(f"round(percentile(max_drawdown, {q}e0), 9) AS q{round(q * 100):02d}" for q in risk.QUANTILES) + ", round(avg(max_drawdown), 9) AS mean FROM {drawdowns}", drawdowns)
query("ruin_first_passage", "SELECT round(probability, 9) AS probability, n_paths, round(never_hit_fraction, 9) AS never_hit_fraction, median_step FROM {summary}", R("summary", risk.PASSAGE_SUMMARY, (passages,)))
query("absorb_at_barrier", "SELECT path_id, step, round(level, 2) AS level FROM {absorbed}", R("absorbed", risk.ABSORBED, (levels,), (("barrier", "CAST(9500000.0 AS DOUBLE)"),)))
query("path_step_returns", "SELECT path_id, step, round(ret, 9) AS ret FROM {steps}", steps)
query("kelly_paths", "SELECT path_id, round(kelly, 4) AS kelly FROM {kelly}", R("kelly", risk.KELLY, (steps,)))
query("trial_matrix_long", "SELECT config_id, config_idx, period_idx, period_end_ns, round(ret, 9) AS ret FROM {trials}", trials)
query("common_window", "SELECT min(period_end_ns) AS lo, max(period_end_ns) AS hi, count(DISTINCT config_id) AS configs, count(DISTINCT period_end_ns) AS periods FROM {trials}", trials)
query("trial_sharpes", "SELECT config_id, round(sharpe, 9) AS sharpe FROM {ts}", R("ts", overfit.TRIAL_SHARPES, (trials,), RFV))
query("trial_sharpe_spread", "SELECT round(var_samp(sharpe), 9) AS trial_variance, round(max(sharpe), 9) AS best, round(percentile(sharpe, 0.5e0), 9) AS median, count(*) AS n FROM {ts}", R("ts", overfit.TRIAL_SHARPES, (trials,), RFV))
query("cscv_ranks", "SELECT mask, place, n_configs FROM {logits}", logits)
query("cscv_pbo", "SELECT round(probability, 9) AS probability, round(median_logit, 9) AS median_logit, n_combinations, n_configs FROM {pbo}", R("pbo", overfit.PBO, (logits,)))
query("spa_pvalues", "SELECT round(p_value_lower, 9) AS p_value_lower, round(p_value_consistent, 9) AS p_value_consistent, round(p_value_upper, 9) AS p_value_upper, round(p_value_reality_check, 9) AS p_value_reality_check, round(statistic, 7) AS statistic FROM {spa}", spa)
_z = R("psr", overfit.PSR_Z, (moments,), (("benchmark", "0.05e0"),))
query("psr", f"SELECT log_id, n_periods, round(sharpe, 9) AS sharpe, round(skewness, 9) AS skewness, round(kurtosis, 9) AS kurtosis, round(z, 7) AS z, round({normal_cdf_sql('z')}, 7) AS probability FROM {{psr}}", _z)
query("min_track_record", "SELECT log_id, sharpe > 0.01e0 AS attainable, CASE WHEN sharpe > 0.01e0 THEN round(1e0 + (1e0 - skewness * sharpe + (kurtosis - 1e0) / 4e0 * sharpe * sharpe) * power(1.6448536269514722e0 / (sharpe - 0.01e0), 2e0), 3) END AS periods FROM {moments}", moments)
query("trailing_estimators", "SELECT log_id, period_idx, round(trend, 9) AS trend, round(volatility, 9) AS volatility FROM {trailing}", trailing)
query("regime_labels", "SELECT log_id, period_idx, trend_state, vol_state, joint FROM {labels}", labels)
query("regime_attribution", "SELECT log_id, joint, n, round(total, 9) AS total, round(mean, 9) AS mean, round(variance * 1e6, 6) AS variance_e6, round(share, 9) AS share FROM {attribution}", attribution)
query("welch_anova_stat", "SELECT log_id, round(statistic, 6) AS statistic, df_between, round(df_within, 5) AS df_within, n_groups FROM {welch}", R("welch", regimes.WELCH, (attribution,)))
query("transition_matrix", "SELECT log_id, src, dst, n, round(p, 9) AS p FROM {transitions}", R("transitions", regimes.TRANSITIONS, (labels,)))
query("cpt_weights", "SELECT candidate, round(x, 9) AS x, round(weight, 8) AS weight, round(value, 8) AS value FROM {weighted}", weighted)
query("certainty_equivalent", "SELECT candidate, round(cpt_value, 8) AS cpt_value, round(certainty_equivalent, 8) AS certainty_equivalent FROM {values_of}", values)
query("events_daily_tumbling", "SELECT series_id, day, round(level, 4) AS level FROM {series}", event_days)
query("events_level_returns", "SELECT series_id, day, round(ret, 9) AS ret FROM (SELECT series_id, day, level / lag(level) OVER (PARTITION BY series_id ORDER BY day) - 1e0 AS ret FROM {series}) x WHERE ret IS NOT NULL", event_days)


def _runner(rel: Relation) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rel.frame(spark, sf_dir)


#: An invented desk for the simulated account.
DESK = DeskRules("desk", 1e7, 3e5, 2e5, FundedRules(0.8, 14, 2e5, 1e3, True), True, 1.5e5, 5, 200, 500.0, True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _runner(rel) for name, rel in _FOUND.items()}
ORACLE_SQL: dict[str, str] = {name: rel.duck() for name, rel in _FOUND.items()}


def shown(*columns: str, **places: int) -> list[str]:
    return [*columns, *(even_rounds(f"round({c}, {n})") + f" AS {c}" for c, n in places.items())]


def oracle(sql: str, *columns: str, **places: int) -> str:
    return f"SELECT {', '.join(shown(*columns, **places))} FROM ({sql}) shown"


def query_of(name: str, sql: str | None, *columns: str, **places: int):
    """Register a function as a query; both sides show the same columns, rounded alike."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).selectExpr(*shown(*columns, **places))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, *columns, **places)
        return f

    return add
