"""Desk rules on simulated daily paths: an evaluation, then a funded account. One fold a path, all on the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientSampleError, SchemaError

RUNNING, PASSED, DAILY_LOSS, MAX_LOSS, TIME_LIMIT, UNFINISHED = range(6)


@dataclass(frozen=True)
class FundedRules:
    profit_split: float
    payout_cycle_days: int
    max_loss: float
    min_payout: float = 0.0
    trailing: bool = False
    daily_loss_limit: float | None = None


@dataclass(frozen=True)
class DeskRules:
    rules_id: str
    account_size: float
    profit_target: float
    max_loss: float
    funded: FundedRules
    trailing: bool = False
    daily_loss_limit: float | None = None
    min_trading_days: int = 0
    max_evaluation_days: int | None = None
    evaluation_fee: float = 0.0
    fee_refunded_on_pass: bool = False
    verified_on: date | None = None
    source_url: str = ""

    def __post_init__(self) -> None:
        if self.daily_loss_limit is not None and self.daily_loss_limit > self.max_loss:
            raise SchemaError("the daily loss limit exceeds the maximum loss")
        if self.max_evaluation_days is not None and self.min_trading_days > self.max_evaluation_days:
            raise SchemaError("more trading days are asked for than the evaluation lasts")
        if not 0 < self.funded.profit_split <= 1 or min(self.account_size, self.profit_target, self.max_loss, self.funded.max_loss) <= 0 or self.funded.payout_cycle_days < 1:
            raise SchemaError("sizes, targets and cycles must be positive, the split at most 1")


def load_rules(path: str) -> DeskRules:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    try:
        return DeskRules(**{**raw, "funded": FundedRules(**raw["funded"])})
    except (TypeError, KeyError) as e:
        raise SchemaError(f"desk rules: {e}") from e


def _fold(deltas: Column, rules: DeskRules) -> Column:
    r, f = rules, rules.funded
    lit = lambda v: F.lit(float(v))
    start = F.struct(
        F.lit(0).alias("day"), F.lit(RUNNING).alias("outcome"), lit(r.account_size).alias("equity"), lit(r.account_size).alias("peak"), F.lit(0).alias("traded"), F.lit(-1).alias("pass_day"),
        F.lit(False).alias("alive"), F.lit(-1).alias("since"), lit(r.account_size).alias("f_equity"), lit(r.account_size).alias("f_peak"), lit(0).alias("payouts"), F.lit(-1).alias("first_payout"),
    )

    def step(s: Column, x: Column) -> Column:
        live = s.outcome == RUNNING
        equity = F.when(live, s.equity + x).otherwise(s.equity)
        traded = s.traded + F.when(live & (x != 0), 1).otherwise(0)
        peak = F.greatest(s.peak, equity)
        floor = (peak if r.trailing else lit(r.account_size)) - r.max_loss
        daily = F.lit(False) if r.daily_loss_limit is None else x < -r.daily_loss_limit
        end = F.when(daily, DAILY_LOSS).when(equity <= floor, MAX_LOSS).when((equity >= r.account_size + r.profit_target) & (traded >= r.min_trading_days), PASSED)
        if r.max_evaluation_days is not None:
            end = end.when(s.day + 1 >= r.max_evaluation_days, TIME_LIMIT)
        outcome = F.when(live, end.otherwise(RUNNING)).otherwise(s.outcome)
        now = live & (outcome == PASSED)
        # the funded phase starts the day after the pass
        act = s.alive & (s.since < s.day)
        fe = F.when(act, s.f_equity + x).otherwise(s.f_equity)
        fp = F.when(act, F.greatest(s.f_peak, fe)).otherwise(s.f_peak)
        f_daily = F.lit(False) if f.daily_loss_limit is None else x < -f.daily_loss_limit
        blown = act & (f_daily | (fe <= (fp if f.trailing else lit(r.account_size)) - f.max_loss))
        elapsed = s.day - s.since
        payable = F.greatest(fe - r.account_size, lit(0)) * f.profit_split
        pay = act & ~blown & (elapsed > 0) & (elapsed % f.payout_cycle_days == 0) & (payable >= f.min_payout) & (payable > 0)
        return F.struct(
            (s.day + 1).alias("day"), outcome.alias("outcome"), equity.alias("equity"), peak.alias("peak"), traded.alias("traded"), F.when(now, s.day + 1).otherwise(s.pass_day).alias("pass_day"),
            ((s.alive & ~blown) | now).alias("alive"), F.when(now, s.day).otherwise(s.since).alias("since"),
            F.when(pay, lit(r.account_size)).otherwise(fe).alias("f_equity"), F.when(pay, lit(r.account_size)).otherwise(fp).alias("f_peak"),
            (s.payouts + F.when(pay, payable).otherwise(0.0)).alias("payouts"), F.when(pay & (s.first_payout < 0), s.day + 1).otherwise(s.first_payout).alias("first_payout"),
        )

    return F.aggregate(deltas, start, step)


def path_outcomes(paths: DataFrame, rules: DeskRules) -> DataFrame:
    """(path_id, outcome, days_to_pass, days_to_first_payout, payouts, net_value) from daily levels (path_id, step, level).

    Only a path's daily changes count, whatever its own capital. Days are -1 where they never come.
    """
    packed = paths.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("step", "level"))).alias("l"))
    deltas = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i).level - F.get("l", i - 1).level)
    done = packed.where(F.size("l") > 1).select("path_id", _fold(deltas, rules).alias("s"))
    refund = F.when((F.col("s.pass_day") >= 0) & F.lit(rules.fee_refunded_on_pass), rules.evaluation_fee).otherwise(0.0)
    return done.select(
        "path_id", F.when(F.col("s.outcome") == RUNNING, UNFINISHED).otherwise(F.col("s.outcome")).alias("outcome"), F.col("s.pass_day").alias("days_to_pass"),
        F.col("s.first_payout").alias("days_to_first_payout"), F.col("s.payouts").alias("payouts"), (F.col("s.payouts") - rules.evaluation_fee + refund).alias("net_value"),
    )


def evaluate(paths: DataFrame, rules: DeskRules, percentiles: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> dict:
    out = path_outcomes(paths, rules)
    at = ", ".join(map(str, percentiles))
    row = out.agg(
        F.count("*").alias("n"), F.avg((F.col("days_to_pass") >= 0).cast("double")).alias("p"), F.avg((F.col("days_to_first_payout") >= 0).cast("double")).alias("paid"), F.avg("net_value").alias("value"),
        F.expr(f"percentile(net_value, array({at}))").alias("net"), F.expr(f"percentile(CASE WHEN days_to_pass >= 0 THEN days_to_pass END, array({at}))").alias("days"),
        F.expr(f"percentile(CASE WHEN days_to_first_payout >= 0 THEN days_to_first_payout END, array({at}))").alias("first"),
    ).first()
    if not row.n:
        raise InsufficientSampleError("no path has a day", 0, 1)
    counts = {r[0]: r[1] for r in out.groupBy("outcome").count().collect()}
    named = lambda q: dict(zip(percentiles, q, strict=True)) if q else {}
    return {"rules_id": rules.rules_id, "pass_probability": row.p, "pass_standard_error": math.sqrt(row.p * (1 - row.p) / row.n), "payout_probability": row.paid, "expected_net_value": row.value, "net_value_percentiles": named(row.net), "days_to_pass": named(row.days), "days_to_first_payout": named(row["first"]), "outcome_counts": counts, "n_paths": row.n, "horizon_days": paths.agg(F.max("step")).first()[0]}
