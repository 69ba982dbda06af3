"""Closed forms, invariances, refusals and recovery."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import constants as C
from plumbline.errors import CalendarCoverageError, GridSparsityError, InsufficientSampleError, LookaheadError, OverfitInputError, RegimeSparsityError, SchemaError, TradeIntegrityError, UnitMismatchError
from plumbline.functions import random as keyed
from plumbline.functions import special
from plumbline.operators import grid, metrics, overfit, probe, propfirm, regimes, resample, risk, validate, verdict

DAY = C.DAY_NS


def trades_of(spark, rows, log="a"):
    """rows: (day, pnl); exits at 14:00 UTC, an hour after entry; prices solved from the profit."""
    data = [(log, f"t{k:05d}", "X", 1, 1.0, 1.0, int(d * DAY + 13 * 3600e9), int(d * DAY + 14 * 3600e9), 100.0, 100.0 + p, 0.0, float(p), float(p)) for k, (d, p) in enumerate(rows)]
    return spark.createDataFrame(data, "log_id string, trade_id string, symbol string, side int, qty double, multiplier double, entry_ns long, exit_ns long, entry_px double, exit_px double, fees double, gross_pnl double, pnl double")


def returns_of(spark, values, log="a"):
    return spark.createDataFrame([(log, k, (19000 + k) * DAY, 1, float(v)) for k, v in enumerate(values)], "log_id string, period_idx long, period_end_ns long, n_trades long, ret double")


def noise(n, seed, mean=0.0, sigma=0.01, rho=0.0):
    r, x, out = random.Random(seed), 0.0, []
    for _ in range(n + 200):
        x = rho * x + r.gauss(0, sigma)
        out.append(x + mean)
    return out[200:]


def weekdays(n, start=19002):
    return [d for d in range(start, start + 2 * n) if (d + 3) % 7 < 5][:n]


def test_normal_and_f():
    for x in (-3.0, -0.4, 0.0, 1.1, 2.7):
        assert math.isclose(special.normal_cdf(x), NormalDist().cdf(x), rel_tol=1e-12)
    assert math.isclose(special.f_survival(3.0, 1, 10), 2 * (1 - _t_cdf(math.sqrt(3.0), 10)), rel_tol=1e-6)
    assert special.f_survival(0, 3, 5) == 1


def _t_cdf(t, df, steps=20000):
    c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
    h = t / steps
    f = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 0.5 + h / 3 * (f(0) + f(t) + 4 * sum(f((2 * k + 1) * h) for k in range(steps // 2)) + 2 * sum(f(2 * k * h) for k in range(1, steps // 2)))


def test_keyed_uniform_ignores_partitions(spark):
    a = spark.range(50).select("id", keyed.uniform(7, "s", "id").alias("u"))
    b = spark.range(50).repartition(7).select("id", keyed.uniform(7, "s", "id").alias("u"))
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.where("id = 3").first().u == keyed.uniform_value(7, "s", 3)


def test_sharpe_at_bandwidth_zero_is_mertens(spark):
    values = noise(400, 1, 0.001)
    r = returns_of(spark, values)
    got = metrics.sharpe_ratio(r, 252.0, bandwidth=0)
    n, sr, skew, kurt = overfit.sample_moments(r.select("ret"))
    assert math.isclose(got["standard_error"], math.sqrt(252 * metrics.mertens_sharpe_variance(sr, skew, kurt, n)), rel_tol=1e-9)


def test_one_active_period(spark):
    got = metrics.sharpe_ratio(returns_of(spark, [0.05] + [0.0] * 251), 252.0, bandwidth=0)
    assert math.isclose(got["annualised_sqrt_q"], C.degenerate_annual_sharpe(1.0), rel_tol=1e-9)


def test_no_dispersion_defines_nothing(spark):
    assert metrics.sharpe_ratio(returns_of(spark, [0.01] * 100), 252.0)["annualised_sqrt_q"] is None


def test_drawdown_closed_form(spark):
    curve = metrics.equity_curve(returns_of(spark, [0.1, -0.2, 0.05, 0.2]), capital=100.0)
    d = metrics.drawdown_profile(curve, 100.0).first()
    assert math.isclose(d.max_drawdown, 20 / 110) and d.recovered and d.max_drawdown_duration == 3 and d.time_underwater == 0.5


def test_compounded_curve(spark):
    curve = metrics.equity_curve(returns_of(spark, [0.1, -0.5, 1.0]), C.CURRENT_EQUITY, 100.0).orderBy("period_idx").collect()
    assert [round(r.equity, 9) for r in curve] == [110.0, 55.0, 110.0]


def test_scale_doesnt_change_a_ratio(spark):
    values = noise(200, 2, 0.001)
    a, b = (metrics.sharpe_ratio(returns_of(spark, [k * v for v in values]), 252.0) for k in (1, 3))
    assert math.isclose(a["annualised_hac"], b["annualised_hac"], rel_tol=1e-9) and a["bandwidth"] == b["bandwidth"]


def test_a_session_holds_its_close(spark):
    close = 19002 * DAY + 75_600_000_000_000
    t = trades_of(spark, [(19002, 1.0), (19003, 2.0)]).withColumn("exit_ns", F.when(F.col("pnl") == 1, F.lit(close)).otherwise(F.lit(close + 1)))
    got = [tuple(r) for r in grid.period_sums(t, "DAILY").select("pnl", "n_trades").orderBy("period_end_ns").collect()]
    assert got == [(1.0, 1), (2.0, 1)]


def test_ladder_takes_the_finest_feasible_rung(spark):
    dense = trades_of(spark, [(d, 1.0) for d in weekdays(80)])
    assert grid.select_grid(dense).period == "DAILY"
    sparse = trades_of(spark, [(19000 + 14 * k, 1.0) for k in range(70)])
    got = grid.select_grid(sparse)
    assert got.period == "WEEKLY" and got.candidates[0]["rejections"]
    with pytest.raises(GridSparsityError, match="DAILY"):
        grid.select_grid(trades_of(spark, [(19000 + 3 * k, 1.0) for k in range(10)]))
    assert grid.select_grid(sparse, forced_period="MONTHLY").warnings


def test_coverage_and_solvency(spark):
    t = trades_of(spark, [(d, -60.0) for d in weekdays(5)])
    with pytest.raises(TradeIntegrityError, match="t00001"):
        grid.trade_returns(t, C.CURRENT_EQUITY, 100.0)
    with pytest.raises(CalendarCoverageError):
        grid.check_coverage(t, grid.weekday_sessions(trades_of(spark, [(18000, 1.0)])))


def test_trials_share_a_grid(spark):
    days = weekdays(120)
    t = trades_of(spark, [(d, 1.0) for d in days], "a").unionByName(trades_of(spark, [(d, 2.0) for d in days[20:]], "b"))
    got, choice, trimmed = grid.build_trials(t)
    assert choice.period == "DAILY" and got.count() == 200 and trimmed == {"a": (20, 0), "b": (0, 0)}
    assert len(grid.wide_trials(got).columns) == 3
    with pytest.raises(InsufficientSampleError):
        grid.build_trials(t.where("log_id = 'a'"))


def test_observed_grid(spark):
    frame = lambda days: spark.createDataFrame([("s", d) for d in days], "series_id string, day long")
    assert grid.observed_grid(frame(range(0, 700, 7)))["period"] == "WEEKLY"
    with pytest.raises(GridSparsityError):
        grid.observed_grid(frame([0, 1, 2, 3, 100]))
    with pytest.raises(InsufficientSampleError):
        grid.observed_grid(frame([0, 1]))


def test_validation_order_and_names(spark):
    t = trades_of(spark, [(d, 1.0) for d in weekdays(4)])
    assert validate.validate_trades(t, {"X": 0.25}).count() == 4
    cases = [
        ("trade_id", F.lit("same"), "repeat"), ("exit_ns", F.col("entry_ns") - 1, "before entries"), ("qty", F.lit(0.0), "not positive"), ("qty", F.lit(float("nan")), "not positive"),
        ("fees", F.lit(-1.0), "negative fees"), ("entry_px", F.lit(float("inf")), "not finite"), ("pnl", F.lit(9.0), "don't match"),
    ]
    for column, value, words in cases:
        with pytest.raises(TradeIntegrityError, match=words) as e:
            validate.validate_trades(t.withColumn(column, value), {"X": 0.25})
        assert e.value.observed is not None
    with pytest.raises(SchemaError, match="tick"):
        validate.validate_trades(t, {})
    with pytest.raises(InsufficientSampleError):
        validate.validate_trades(t.limit(0), {"X": 0.25})


def test_block_length_grows_with_dependence(spark):
    got = [resample.estimate_block_length(returns_of(spark, noise(1500, 3, rho=r))).block_length for r in (0.0, 0.5)]
    assert got[0] < 5 < got[1] < 25
    assert resample.estimate_block_length(returns_of(spark, [0.01] * 50)).block_length == 1.0


def test_bootstrap_blocks_are_circular_runs(spark):
    rows = resample.bootstrap_indices(spark, 10, 20, 30, 5.0, 1).orderBy("path_id", "step").collect()
    runs = sum((b.src_idx - a.src_idx) % 10 == 1 for a, b in zip(rows, rows[1:], strict=False) if a.path_id == b.path_id)
    assert 0.7 < runs / (20 * 29) < 0.95 and {r.src_idx for r in rows} == set(range(10))
    for rng in ("md5", "xxhash64"):
        again = resample.bootstrap_indices(spark.newSession(), 10, 20, 30, 5.0, 1, rng=rng).count()
        assert again == 600


def test_paths_risk_and_ruin(spark):
    paths = resample.resample_equity_paths(returns_of(spark, noise(120, 4, 0.001)), 60, 5, 100.0, block_length=3.0).cache()
    assert paths.where("step = 0 AND level = 100").count() == 60
    var, es = risk.value_at_risk(paths, 1, replicates=50), risk.expected_shortfall(paths, 1, replicates=50)
    assert es["value"] >= var["value"] and var["ci_low"] <= var["ci_high"]
    d = risk.drawdown_distribution(paths, 1, observed=1.0, replicates=50)
    assert d["observed_quantile"] == 1.0 and 0 < d["mean"]["value"] < 1
    ruin = risk.first_passage(paths, 95.0, 1, replicates=50)
    assert 0 <= ruin["ci_low"] <= ruin["probability"] <= ruin["ci_high"] <= 1 and ruin["seed"] == 1
    assert risk.first_steps(paths, 95.0).where("first_step >= 0").count() == round(ruin["probability"] * 60)
    absorbed = risk.absorb_at_barrier(paths, 95.0)
    last = absorbed.where("step = 120 AND level = 95").count()
    assert last == round(ruin["probability"] * 60)
    assert risk.kelly_from_paths(paths)["point"] is not None
    with pytest.raises(InsufficientSampleError):
        risk.first_passage(paths, 100.0, 1)
    with pytest.raises(UnitMismatchError):
        risk.first_passage(paths, 95.0, 1, unit="TRADE")
    with pytest.raises(InsufficientSampleError):
        risk.value_at_risk(paths.where("path_id < 5"), 1)


def test_compounded_paths_agree_with_the_product(spark):
    r = returns_of(spark, [0.1, 0.1, 0.1])
    p = resample.resample_equity_paths(r, 3, 1, 100.0, C.CURRENT_EQUITY, block_length=1.0)
    assert [round(x.level, 6) for x in p.where("path_id = 0").orderBy("step").collect()] == [100.0, 110.0, 121.0, 133.1]


def test_closed_forms_of_a_walk():
    assert math.isclose(risk.brownian_ruin_probability(0.0, 1.0, 10.0, 400, corrected=False), 2 * NormalDist().cdf(-0.5))
    assert risk.expected_max_drawdown(1.0, 100, False) - risk.expected_max_drawdown(1.0, 100) == pytest.approx(2 * C.BARRIER_CONTINUITY_CORRECTION)


def matrix(spark, n, k, seed, edge=0.0):
    r = random.Random(seed)
    return spark.createDataFrame([(f"c{j:02d}", j, i, r.gauss(edge if j == 0 else 0.0, 0.01)) for j in range(k) for i in range(n)], "config_id string, config_idx long, period_idx long, ret double")


def test_search_corrections_tell_noise_from_edge(spark):
    flat, good = matrix(spark, 400, 12, 1), matrix(spark, 400, 12, 1, 0.004)
    a, b = (overfit.probability_of_backtest_overfitting(m, 8) for m in (flat, good))
    assert a["probability"] > 0.2 and b["probability"] < 0.05 and a["n_combinations"] == 70
    a, b = (overfit.superior_predictive_ability(m, 3, 200, block_length=1.0) for m in (flat, good))
    assert a["p_value_consistent"] > 0.05 > b["p_value_consistent"] and b["best_config"] == 0
    assert a["p_value_lower"] <= a["p_value_consistent"] <= a["p_value_upper"]
    one = good.where("config_idx = 0")
    assert overfit.deflated_sharpe_ratio(one, 12, 0.003)["probability"] < overfit.deflated_sharpe_ratio(one, 12, 0.003)["psr_against_zero"]
    assert overfit.minimum_track_record_length(one, 252)["attainable"]
    assert not overfit.minimum_track_record_length(one.withColumn("ret", -F.col("ret")), 252)["attainable"]


def test_search_refusals(spark):
    m = matrix(spark, 40, 2, 1)
    for bad in (lambda: overfit.probability_of_backtest_overfitting(m, 7), lambda: overfit.probability_of_backtest_overfitting(m, 40), lambda: overfit.probability_of_backtest_overfitting(m.where("config_idx = 0"), 4), lambda: overfit.expected_maximum_sharpe(1, 1.0), lambda: overfit.expected_maximum_sharpe(5, 0.0), lambda: overfit.sample_moments(m.limit(2))):
        with pytest.raises(OverfitInputError):
            bad()


def test_labels_know_nothing_of_the_future(spark):
    values = noise(150, 6)
    full = regimes.label_regimes(returns_of(spark, values)).where("period_idx < 120").orderBy("period_idx").collect()
    cut = regimes.label_regimes(returns_of(spark, values[:120])).orderBy("period_idx").collect()
    bent = regimes.label_regimes(returns_of(spark, values[:120] + [9.0] * 30)).where("period_idx < 120").orderBy("period_idx").collect()
    key = lambda rows: [(r.period_idx, r.trend_state, r.vol_state) for r in rows]
    assert key(full) == key(cut) == key(bent)
    assert all(r.joint == -1 for r in full[:60])
    with pytest.raises(InsufficientSampleError):
        regimes.label_regimes(returns_of(spark, values[:50]))


def test_attribution_welch_and_transitions(spark):
    rows = [("a", k, k % 3, 0.01 * (k % 3) + 0.001 * random.Random(k).gauss(0, 1)) for k in range(90)]
    labels = spark.createDataFrame(rows, "log_id string, period_idx long, joint long, ret double")
    table = regimes.attribute_by_regime(labels)
    assert regimes.welch_anova(table)["p_value"] < 1e-6
    t, collapsed = regimes.transition_matrix(labels)
    assert not collapsed and {(r.src, r.dst): r.p for r in t.collect()} == {(0, 1): 1.0, (1, 2): 1.0, (2, 0): 1.0}
    with pytest.raises(RegimeSparsityError):
        regimes.transition_matrix(labels.where("period_idx < 30"))
    paths = regimes.markov_resample(labels, 4, 1, 12)
    assert paths.count() == 48
    with pytest.raises(LookaheadError):
        regimes.aligned_labels(returns_of(spark, [0.1] * 5), labels.withColumn("period_end_ns", F.col("period_idx")))


def desk(**k):
    return propfirm.DeskRules("d", 1000.0, 100.0, 80.0, propfirm.FundedRules(0.5, 2, 50.0, 10.0), **k)


def by_hand(deltas, r):
    """One path, day by day."""
    eq = peak = r.account_size
    state, passed, traded, paid, first, alive, since = propfirm.RUNNING, -1, 0, 0.0, -1, False, -1
    fe = fp = r.account_size
    for day, x in enumerate(deltas):
        was_alive = alive
        if state == propfirm.RUNNING:
            eq += x
            traded += x != 0
            peak = max(peak, eq)
            if r.daily_loss_limit is not None and x < -r.daily_loss_limit:
                state = propfirm.DAILY_LOSS
            elif eq <= (peak if r.trailing else r.account_size) - r.max_loss:
                state = propfirm.MAX_LOSS
            elif eq >= r.account_size + r.profit_target and traded >= r.min_trading_days:
                state, passed, alive, since = propfirm.PASSED, day + 1, True, day
            elif r.max_evaluation_days is not None and day + 1 >= r.max_evaluation_days:
                state = propfirm.TIME_LIMIT
        if was_alive and alive and since < day:
            fe += x
            fp = max(fp, fe)
            if fe <= (fp if r.funded.trailing else r.account_size) - r.funded.max_loss:
                alive = False
            elif (day - since) % r.funded.payout_cycle_days == 0:
                pay = max(fe - r.account_size, 0) * r.funded.profit_split
                if pay >= r.funded.min_payout and pay > 0:
                    paid += pay
                    fe = fp = r.account_size
                    first = day + 1 if first < 0 else first
    return (propfirm.UNFINISHED if state == propfirm.RUNNING else state, passed, first, round(paid, 6))


def test_desk_rules_follow_each_day(spark):
    r = random.Random(9)
    walks = [[r.choice([0, 0, 30, -30, 45, -60, 110]) for _ in range(25)] for _ in range(60)]
    rows = []
    for k, w in enumerate(walks):
        level = 500.0
        rows.append((k, 0, level))
        for i, x in enumerate(w):
            level += x
            rows.append((k, i + 1, level))
    paths = spark.createDataFrame(rows, "path_id long, step long, level double")
    for rules in (desk(), desk(trailing=True), desk(daily_loss_limit=50.0), desk(max_evaluation_days=10, min_trading_days=3)):
        got = {x.path_id: (x.outcome, x.days_to_pass, x.days_to_first_payout, round(x.payouts, 6)) for x in propfirm.path_outcomes(paths, rules).collect()}
        assert got == {k: by_hand(w, rules) for k, w in enumerate(walks)}
    summary = propfirm.evaluate(paths, desk())
    assert sum(summary["outcome_counts"].values()) == 60
    with pytest.raises(SchemaError):
        desk(daily_loss_limit=500.0)


def test_neutral_preferences_give_the_mean(spark):
    rows = spark.createDataFrame([("a", x) for x in (0.1, -0.2, 0.4, 0.0)], "candidate string, outcome double")
    got = verdict.certainty_equivalents(rows, verdict.Preferences(1, 1, 1, 1, 1)).first()
    assert math.isclose(got.certainty_equivalent, 0.075)
    ranked = verdict.rank([verdict.Candidate("b", rows.select("outcome"), frozenset({"resampling", "deflated_sharpe"})), verdict.Candidate("c", rows.select("outcome"))])
    assert [r["name"] for r in ranked["ranked"]] == ["b"] and ranked["unrankable"][0]["blocking_sections"]


def test_probe_reads_a_multiplier(spark):
    r = random.Random(2)
    rows = []
    for k in range(60):
        move = r.choice([-1, 1]) * r.randrange(1, 40) * 0.25
        rows.append((f"t{k}", "ES", 1, 2.0, 100.0, 100.0 + move, 5.0, move * 2 * 50 - 5.0))
    t = spark.createDataFrame(rows, "trade_id string, symbol string, side int, qty double, entry_px double, exit_px double, fees double, pnl double")
    (got,) = probe.probe_symbols(t)
    assert math.isclose(got["implied"], 50.0) and got["convention"] == "NET"
    assert probe.quantum_of(t, "pnl") == 5.0 or probe.quantum_of(t, "pnl") in (1.0, 0.1)
    assert probe.quantum_of(t.limit(0), "pnl") == 0.0


def test_probe_follows_the_log(spark):
    """One quantum for all profits, the median fee decides, only moved trades are typical, symbols in their order."""
    r, rows = random.Random(5), []
    for k in range(40):
        move = r.choice([-1, 1]) * r.randrange(4, 40) * 0.25
        rows.append((k, "Z", 1, 1.0, 100.0, 100.0 + move, 0.0, move * 20))  # no cost
        rows.append((k + 100, "A", 1, 1.0, 100.0, 100.0 + move, 900.0 if k == 0 else 1.0, move * 50))  # one large fee among small ones
        rows.append((k + 200, "A", 1, 1.0, 100.0, 100.0, 1.0, 0.0))  # flat trades are no typical profit
    t = spark.createDataFrame([(*x[:7], round(x[7], -1)) for x in rows], "row_no long, symbol string, side int, qty double, entry_px double, exit_px double, fees double, pnl double")
    z, a = probe.probe_symbols(t)
    assert (z["symbol"], z["detectability"], z["convention"]) == ("Z", "NO_COST", None) and a["symbol"] == "A"
    assert z["pnl_quantum"] == a["pnl_quantum"] == 10.0 and a["detectability"] == "UNDETECTABLE" and a["n_usable"] == 40
    assert a["typical_pnl"] > 0 and abs(a["implied"] / 50 - 1) < 0.1
    coarse = t.withColumn("pnl", F.round(F.col("pnl") / 1000) * 1000)
    assert all(math.isnan(x["implied"]) for x in probe.probe_symbols(coarse))


def test_growth_compounds_on_current_equity(spark):
    r = returns_of(spark, [0.1, 0.5, 0.1, 0.5])
    got = metrics.period_metrics(r, 4.0, basis=C.CURRENT_EQUITY).first()
    assert math.isclose(got.cumulative_return, 1.1 * 1.5 * 1.1 * 1.5 - 1) and math.isclose(got.cagr, got.cumulative_return)
    assert math.isclose(metrics.period_metrics(r, 4.0).first().cumulative_return, 1.2)
    flat = metrics.period_metrics(returns_of(spark, [0.01] * 12), 12.0, 0.02, C.CURRENT_EQUITY).first().asDict()
    assert flat["sharpe_annualised"] is None and flat["kelly"] is None and math.isclose(flat["cumulative_return"], 1.01**12 - 1)
    assert any("dispersion" in w for w in metrics.period_warnings(flat))
    lost = metrics.period_metrics(returns_of(spark, [0.5, -1.0, 0.2]), 12.0, basis=C.CURRENT_EQUITY).first().asDict()
    assert lost["cumulative_return"] == -1 and lost["cagr"] is None and any("used up" in w for w in metrics.period_warnings(lost))


def test_spa_against_a_benchmark(spark):
    rows = [(k, f"c{k}", t, x) for k in range(3) for t, x in enumerate(noise(120, 30 + k, 0.002 * k))]
    trials = spark.createDataFrame(rows, "config_idx long, config_id string, period_idx long, ret double")
    rival = trials.where("config_idx = 2").select("period_idx", "ret")
    free, against = (overfit.superior_predictive_ability(trials, 3, 200, 2.0, benchmark=b) for b in (None, rival))
    assert against["p_value_consistent"] > free["p_value_consistent"] and against["statistic"] < free["statistic"]
    by_hand = overfit.superior_predictive_ability(trials.join(rival.withColumnRenamed("ret", "x"), "period_idx").withColumn("ret", F.col("ret") - F.col("x")).drop("x"), 3, 200, 2.0)
    assert math.isclose(by_hand["statistic"], against["statistic"])
    with pytest.raises(OverfitInputError):
        overfit.superior_predictive_ability(trials, 3, 50, 2.0, benchmark=rival.where("period_idx < 100"))


def test_nothing_to_divide_by(spark):
    labels = spark.createDataFrame([("a", k, 0.0, k % 2) for k in range(8)], "log_id string, period_idx long, ret double, joint long")
    table = regimes.attribute_by_regime(labels)
    assert [r.share for r in table.collect()] == [0.0, 0.0]
    one = regimes.attribute_by_regime(labels.withColumn("joint", F.lit(0)).withColumn("ret", F.col("period_idx").cast("double")))
    with pytest.raises(InsufficientSampleError):
        regimes.welch_anova(one)


def test_counter_draws_are_blocks_of_the_declared_length(spark):
    ids = np.arange(400)
    src = resample.counter_indices(ids, 50, 300, 5.0, 3, "path")
    assert src.min() == 0 and src.max() == 49 and (resample.counter_indices(ids[100:200], 50, 300, 5.0, 3, "path") == src[100:200]).all()
    fresh = (src[:, 1:] != (src[:, :-1] + 1) % 50).mean()
    assert abs(fresh - 0.2 * 49 / 50) < 0.01 and abs(np.bincount(src.ravel(), minlength=50) / src.size - 0.02).max() < 0.003
    assert (resample.counter_indices(ids, 50, 300, 5.0, 4, "path") != src).mean() > 0.9
    rows = resample.bootstrap_indices(spark, 50, 400, 300, 5.0, 3, rng="counter").where("path_id = 7").orderBy("step").collect()
    assert [r.src_idx for r in rows] == src[7].tolist()


def test_all_ways_to_draw_give_the_same_distribution(spark):
    r = returns_of(spark, noise(80, 8, 0.001))
    for basis in (C.FIXED_INITIAL, C.CURRENT_EQUITY):
        ends = [resample.resample_equity_paths(r, 400, 5, 100.0, basis, 4.0, rng=g).where("step = 80").agg(F.avg("level"), F.stddev("level")).first() for g in ("counter", "xxhash64")]
        assert abs(ends[0][0] - ends[1][0]) < 1.5 and abs(ends[0][1] / ends[1][1] - 1) < 0.2


def test_expanding_states_by_hand():
    values = noise(200, 21)
    got = regimes.expanding_states(values, 3, 60)
    for t in range(60, 200):
        assert got[t] == sum(np.quantile(values[:t], k / 3) <= values[t] for k in (1, 2))
    assert got[:60] == [-1] * 60
