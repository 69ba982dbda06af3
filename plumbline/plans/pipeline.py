"""The whole validation of one log: import, grid, metrics, simulation, risk, search corrections, regimes, verdict."""

from __future__ import annotations

import hashlib
import math
import os
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import EngineError, SchemaError
from ..operators import grid, metrics, overfit, propfirm, regimes, resample, risk, verdict
from ..sources import series as sources_series
from ..sources.symbology import load_symbology
from ..sources.tradelog import load_mapping, read_trade_log
from . import charts
from .report import FAILED, NOT_REQUESTED, RAN, SECTIONS, SUPPRESSED, Evidence, Report, section


@dataclass(frozen=True)
class RunConfig:
    symbology_path: str
    mapping_path: str
    initial_capital: float
    seed: int
    basis: str = C.FIXED_INITIAL
    risk_free_rate: float = 0.0
    n_paths: int = 10_000
    forced_period: str | None = None
    ruin_barrier: float | None = None
    n_trials: int | None = None
    trials_path: str | None = None
    reference_path: str | None = None
    propfirm_rules_path: str | None = None
    confidence_level: float = C.DEFAULT_CONFIDENCE_LEVEL
    verdict_requirements: tuple[str, ...] = C.DEFAULT_RANKING_REQUIREMENTS

    def __post_init__(self) -> None:
        if not self.initial_capital > 0 or self.n_paths < 1 or not 0 < self.confidence_level < 1:
            raise SchemaError("capital and paths must be positive, the confidence between 0 and 1")
        if self.basis not in (C.FIXED_INITIAL, C.CURRENT_EQUITY) or self.forced_period not in (None, *C.PERIODS):
            raise SchemaError(f"no such basis or period: {self.basis}, {self.forced_period}")


def load_config(path: str) -> RunConfig:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    raw = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    try:
        return RunConfig(**raw)
    except TypeError as e:
        raise SchemaError(f"run configuration: {e}") from e


def sha256_of(path: str) -> str:
    """Of the text with line ends as \\n."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read().replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest()


def _number(v: float | None) -> float | None:
    return v if v is not None and math.isfinite(v) else None


def run_validation(spark: SparkSession, log_path: str, config_path: str, executed_at: str) -> Report:
    """From files; paths in the configuration are relative to it."""
    config = load_config(config_path)
    base = os.path.dirname(os.path.abspath(config_path))
    at = lambda p: os.path.join(base, p) if p else None
    got = read_trade_log(spark, log_path, load_mapping(at(config.mapping_path)), load_symbology(at(config.symbology_path)))
    provenance = {"log_sha256": sha256_of(log_path), "config_sha256": sha256_of(config_path), "executed_at": executed_at, "currency": got.currency, "n_rows_read": got.n_rows_read}
    trials = (lambda: sources_series.read_wide_trials(spark, at(config.trials_path))) if config.trials_path else None
    reference = (lambda: sources_series.read_wide_reference(spark, at(config.reference_path))) if config.reference_path else None
    rules = propfirm.load_rules(at(config.propfirm_rules_path)) if config.propfirm_rules_path else None
    return validate(got.trades, config, provenance, trials, reference, rules, got.warnings)


def validate(trades: DataFrame, config: RunConfig, provenance: dict | None = None, trials=None, reference=None, rules: propfirm.DeskRules | None = None, warnings: list[str] | None = None) -> Report:
    """From canonical trades of one log. ``trials`` and ``reference`` are callables that give their frames.

    What several sections read is cached: trades, periods, paths and the matrix; everything is released at the
    end, also when something is refused or fails.
    """
    held: list[DataFrame] = []
    try:
        return _validated(held, trades, config, provenance, trials, reference, rules, warnings)
    finally:
        for df in held:
            df.unpersist()


def _validated(held: list[DataFrame], trades: DataFrame, config: RunConfig, provenance: dict | None, trials, reference, rules: propfirm.DeskRules | None, warnings: list[str] | None) -> Report:
    trades = trades.cache()
    held.append(trades)
    sessions = grid.weekday_sessions(trades)
    choice = grid.select_grid(trades, sessions, config.forced_period)
    returns = grid.period_returns(trades, choice.period, config.basis, config.initial_capital, sessions).cache()
    held.append(returns)
    q, rf = choice.periods_per_year, metrics.de_annualise_rate(config.risk_free_rate, choice.periods_per_year)
    panel: dict[str, Evidence] = {}
    by_trade = grid.trade_returns(trades, config.basis, config.initial_capital)
    panel["trade_metrics"] = section("trade_metrics", lambda: {k: _number(v) if isinstance(v, float) else v for k, v in metrics.trade_metrics(by_trade).first().asDict().items() if k != "log_id"})

    def calendar() -> dict:
        row = metrics.period_metrics(returns, q, config.risk_free_rate, config.basis).first().asDict()
        curve = metrics.equity_curve(returns, config.basis, config.initial_capital)
        down = metrics.drawdown_profile(curve, config.initial_capital).first().asDict()
        sharpe = metrics.sharpe_ratio(returns, q, config.risk_free_rate, config.confidence_level)
        return {k: v for k, v in row.items() if k != "log_id"} | {"sharpe": sharpe, "drawdown": {k: v for k, v in down.items() if k != "log_id"}}, metrics.period_warnings(row)

    panel["calendar_metrics"] = section("calendar_metrics", calendar)
    panel["grid_selection"] = Evidence("grid_selection", RAN, {"chosen": choice.period, "forced": choice.forced, "candidates": [{k: v for k, v in c.items() if k != "log_id"} for c in choice.candidates]}, warnings=tuple(choice.warnings))

    paths: DataFrame | None = None
    block: resample.BlockLength | None = None
    try:
        block = resample.estimate_block_length(returns)
        paths = resample.resample_equity_paths(returns, config.n_paths, config.seed, config.initial_capital, config.basis, block.block_length).cache()
        held.append(paths)
        panel["resampling"] = Evidence("resampling", RAN, asdict(block) | {"n_paths": config.n_paths, "ruined_paths": resample.count_ruined(paths)}, warnings=tuple(block.warnings))
    except EngineError as e:
        panel["resampling"] = Evidence("resampling", FAILED, reason=str(e), observed=getattr(e, "observed", None), threshold=getattr(e, "threshold", None))
    if paths is None:
        for name in ("risk_tail", "drawdown_distribution", "risk_of_ruin", "propfirm"):
            panel[name] = Evidence(name, SUPPRESSED, reason="resampling gave no paths")
    else:
        seed = config.seed
        panel["risk_tail"] = section("risk_tail", lambda: {"value_at_risk": risk.value_at_risk(paths, seed), "expected_shortfall": risk.expected_shortfall(paths, seed)})
        seen = panel["calendar_metrics"].payload["drawdown"]["max_drawdown"] if panel["calendar_metrics"].status == RAN else None
        note = (f"blocks of mean length {block.block_length:.2f} understate the deepest falls of dependent series",) if block.block_length > C.BLOCK_LENGTH_WARNING_THRESHOLD else ()
        panel["drawdown_distribution"] = section("drawdown_distribution", lambda: (risk.drawdown_distribution(paths, seed, seen), note))
        panel["risk_of_ruin"] = section("risk_of_ruin", lambda: risk.first_passage(paths, config.ruin_barrier, seed)) if config.ruin_barrier is not None else Evidence("risk_of_ruin", NOT_REQUESTED, reason="no barrier is declared")
        if rules is None:
            panel["propfirm"] = Evidence("propfirm", NOT_REQUESTED, reason="no desk rules are declared")
        elif choice.period != "DAILY":
            panel["propfirm"] = Evidence("propfirm", SUPPRESSED, reason=f"desk rules need daily paths, the grid is {choice.period}")
        else:
            panel["propfirm"] = section("propfirm", lambda: propfirm.evaluate(paths, rules))

    excess = returns.select((F.col("ret") - F.lit(rf)).alias("ret"))
    panel["track_record"] = section("track_record", lambda: overfit.minimum_track_record_length(excess, q))
    _search(panel, config, returns, excess, rf, trials, held)

    def attribute() -> dict:
        ref = sources_series.align(returns, reference()).select(F.lit("reference").alias("log_id"), "period_end_ns", "ret")
        numbered = ref.join(returns.select("period_end_ns", "period_idx"), "period_end_ns")
        labels = regimes.label_regimes(numbered)
        beside = labels.join(returns.select("period_idx", "period_end_ns"), "period_idx")
        table = regimes.attribute_by_regime(regimes.aligned_labels(returns, beside))
        rows = [r.asDict() for r in table.collect()]  # a row a state
        return {"states": [{k: v for k, v in r.items() if k != "log_id"} for r in rows], "concentration": max(r["share"] for r in rows), "welch": {k: v for k, v in regimes.welch_anova(table).items() if k != "log_id"}, "thin_states": [r["joint"] for r in rows if r["n"] < C.MIN_STATE_OBS]}

    panel["regimes"] = section("regimes", attribute) if reference is not None else Evidence("regimes", NOT_REQUESTED, reason="no reference series is declared")
    missing = [s for s in config.verdict_requirements if panel[s].status != RAN]
    if missing:
        panel["verdict"] = Evidence("verdict", SUPPRESSED, reason="missing: " + ", ".join(missing))
    else:
        n = returns.count()
        outcomes = risk.terminal_returns(paths).select((F.col("terminal") - F.lit(rf * n)).alias("outcome"))
        panel["verdict"] = section("verdict", lambda: verdict.rank([verdict.Candidate("strategy", outcomes, frozenset(k for k, e in panel.items() if e.status == RAN))], requirements=config.verdict_requirements)["ranked"][0])
    info = {"period": choice.period, "periods_per_year": q, "n_periods": returns.count(), "initial_capital": config.initial_capital, "basis": config.basis}
    charts = _charts(returns, config, paths, panel)
    return Report(info, asdict(config), provenance or {}, [panel[s] for s in SECTIONS], list(warnings or []) + list(choice.warnings), charts)


def _charts(returns: DataFrame, config: RunConfig, paths: DataFrame | None, panel: dict[str, Evidence]) -> dict[str, str]:
    """The log's equity, where the simulated paths end and how deep they fall; a section that didn't run has no chart."""
    curve = [r.equity for r in metrics.equity_curve(returns, config.basis, config.initial_capital).orderBy("period_idx").collect()]  # one log's periods
    out = {"calendar_metrics": charts.line_chart([config.initial_capital, *curve], "Equity")}
    for name, title, measured, column in (("risk_tail", "Terminal returns", risk.terminal_returns, "terminal"), ("drawdown_distribution", "Maximum drawdowns", risk.max_drawdowns, "max_drawdown")):
        if paths is not None and panel[name].status == RAN:
            out[name] = charts.histogram_chart(charts.histogram(measured(paths), column), title)
    if panel["regimes"].status == RAN:
        out["regimes"] = charts.bar_chart({str(r["joint"]): r["total"] for r in panel["regimes"].payload["states"]}, "Return by state")
    return out


def _search(panel: dict[str, Evidence], config: RunConfig, returns: DataFrame, excess: DataFrame, rf: float, trials, held: list[DataFrame]) -> None:
    """The three corrections for search, from the matrix of all configurations."""
    names = ("deflated_sharpe", "pbo", "spa")
    if trials is None:
        for s in names:
            panel[s] = Evidence(s, NOT_REQUESTED, reason="no matrix of trials is declared")
        return
    try:
        matrix = sources_series.align(returns, trials()).join(returns.select("period_end_ns", "period_idx"), "period_end_ns")
        ids = {c: k for k, c in enumerate(sorted(r[0] for r in matrix.select("config_id").distinct().collect()))}  # a name a configuration
        number = F.create_map(*[x for c, k in ids.items() for x in (F.lit(c), F.lit(k))])
        matrix = matrix.select("config_id", F.element_at(number, F.col("config_id")).cast("long").alias("config_idx"), F.col("period_idx").cast("long").alias("period_idx"), "ret").cache()
        held.append(matrix)
    except EngineError as e:
        for s in names:
            panel[s] = Evidence(s, FAILED, reason=str(e))
        return
    n_trials = max(config.n_trials or 0, len(ids))
    notes = (f"{config.n_trials} trials are declared, the matrix has {len(ids)}",) if config.n_trials and config.n_trials < len(ids) else ()
    spread = overfit.trial_sharpes(matrix, rf).agg(F.var_samp("sharpe"), F.max("sharpe"), F.expr("percentile(sharpe, 0.5)")).first()
    panel["deflated_sharpe"] = section("deflated_sharpe", lambda: (overfit.deflated_sharpe_ratio(excess, n_trials, spread[0]) | {"best_trial": spread[1], "median_trial": spread[2]}, notes))
    panel["pbo"] = section("pbo", lambda: overfit.probability_of_backtest_overfitting(matrix))
    panel["spa"] = section("spa", lambda: overfit.superior_predictive_ability(matrix, config.seed))
