"""Causal regimes: labels from what was known before each period, attribution, equality of means, transitions."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, LookaheadError, RegimeSparsityError
from ..functions.random import uniform
from ..functions.special import f_survival
from .grid import _sql

#: Trailing mean and deviation over the window that ends a period before; zero until a window is full.
TRAILING = """
SELECT log_id, period_idx, ret, CASE WHEN period_idx >= <window> THEN m ELSE 0e0 END AS trend, CASE WHEN period_idx >= <window> THEN s ELSE 0e0 END AS volatility
FROM (SELECT log_id, period_idx, ret, round(avg(ret) OVER w, 12) AS m, round(stddev_samp(ret) OVER w, 12) AS s FROM {returns}
      WINDOW w AS (PARTITION BY log_id ORDER BY period_idx ROWS BETWEEN <window> PRECEDING AND 1 PRECEDING)) t"""

ATTRIBUTION = """
SELECT log_id, joint, count(*) AS n, sum(ret) AS total, avg(ret) AS mean, var_samp(ret) AS variance,
       coalesce(abs(sum(ret)) / nullif(sum(abs(sum(ret))) OVER (PARTITION BY log_id), 0e0), 0e0) AS share FROM {labels} WHERE joint >= 0 GROUP BY log_id, joint"""

WELCH = """
WITH g AS (SELECT log_id, n, mean, variance, n / variance AS w FROM {attribution} WHERE n >= 2 AND variance > 0),
t AS (SELECT log_id, count(*) AS k, sum(w) AS total, sum(w * mean) / sum(w) AS centre FROM g GROUP BY log_id),
s AS (SELECT g.log_id, max(t.k) AS k, sum(g.w * power(g.mean - t.centre, 2e0)) / nullif(max(t.k) - 1e0, 0e0) AS num, sum(power(1e0 - g.w / t.total, 2e0) / (g.n - 1e0)) AS lam FROM g JOIN t ON g.log_id = t.log_id GROUP BY g.log_id)
SELECT log_id, num / (1e0 + 2e0 * (k - 2e0) / nullif(k * k - 1e0, 0e0) * lam) AS statistic, k - 1 AS df_between, (k * k - 1e0) / nullif(3e0 * lam, 0e0) AS df_within, k AS n_groups FROM s"""

TRANSITIONS = """
SELECT log_id, src, dst, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY log_id, src) AS p
FROM (SELECT log_id, joint AS src, lead(joint) OVER (PARTITION BY log_id ORDER BY period_idx) AS dst FROM {labels}) x WHERE src >= 0 AND dst >= 0 GROUP BY log_id, src, dst"""


def regime_values(window: int = C.DEFAULT_REGIME_WINDOW, n_trend: int = C.DEFAULT_STATES_PER_AXIS, n_vol: int = C.DEFAULT_STATES_PER_AXIS) -> dict:
    return {"window": window, "warmup": max(window, max(n_trend, n_vol) * C.MIN_STATE_OBS), "n_trend": n_trend, "n_vol": n_vol}


def _filled(text: str, values: dict) -> str:
    for k, v in values.items():
        text = text.replace(f"<{k}>", str(v))
    return text


def expanding_states(values: list[float], cuts: int, warmup: int) -> list[int]:
    """For each value how many of the ``cuts - 1`` quantiles of all earlier ones lie at or below it; -1 before ``warmup``.

    The earlier values are kept in order, so a period costs an insertion, not a sort.
    """
    known: list[float] = []
    out = []
    for t, x in enumerate(values):
        state = -1
        if t >= warmup:
            state = 0
            for k in range(1, cuts):
                at = (t - 1) * k / cuts
                low = int(at)
                edge = known[low] + (known[min(low + 1, t - 1)] - known[low]) * (at - low)
                state += edge <= x
        out.append(state)
        bisect.insort(known, x)
    return out


def label_states(trailing: DataFrame, n_trend: int, n_vol: int, warmup: int) -> DataFrame:
    """(log_id, period_idx, ret, trend_state, vol_state, joint) of a trailing table, a log at a time: expanding quantiles need its periods in order."""

    def states(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("period_idx")
        trend, vol = (expanding_states(rows.column(c).to_pylist(), n, warmup) for c, n in (("trend", n_trend), ("volatility", n_vol)))
        joint = [-1 if a < 0 or b < 0 else a * n_vol + b for a, b in zip(trend, vol, strict=True)]
        return pa.table({"log_id": rows.column("log_id"), "period_idx": rows.column("period_idx").cast(pa.int64()), "ret": rows.column("ret"), **{k: pa.array(v, pa.int64()) for k, v in (("trend_state", trend), ("vol_state", vol), ("joint", joint))}})

    return trailing.groupBy("log_id").applyInArrow(states, "log_id string, period_idx long, ret double, trend_state long, vol_state long, joint long")


def label_regimes(reference: DataFrame, window: int = C.DEFAULT_REGIME_WINDOW, n_trend: int = C.DEFAULT_STATES_PER_AXIS, n_vol: int = C.DEFAULT_STATES_PER_AXIS) -> DataFrame:
    """(log_id, period_idx, ret, trend_state, vol_state, joint), -1 where undefined. Expanding quantiles are exact."""
    v = regime_values(window, n_trend, n_vol)
    n = reference.groupBy("log_id").count().agg(F.min("count")).first()[0] or 0
    if n <= v["warmup"]:
        raise InsufficientSampleError("the reference is no longer than its warm-up", n, v["warmup"])
    return label_states(_sql(reference, _filled(TRAILING, v), returns=reference), n_trend, n_vol, v["warmup"])


def aligned_labels(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels beside the returns of the same periods; any period without its partner is refused."""
    both = returns.select("log_id", "period_end_ns", F.col("ret").alias("r")).join(labels.select("period_end_ns", "period_idx", "joint"), "period_end_ns", "full_outer")
    if lost := both.where("r IS NULL OR joint IS NULL").count():
        raise LookaheadError(f"{lost} periods have no partner")
    return both.select("log_id", "period_idx", F.col("r").alias("ret"), "joint")


def attribute_by_regime(labels: DataFrame) -> DataFrame:
    return _sql(labels, ATTRIBUTION, labels=labels)


def welch_anova(attribution: DataFrame) -> dict:
    """Welch's test of equal means over the states, for one log."""
    row = _sql(attribution, WELCH, attribution=attribution).first()
    if row is None or row.n_groups < 2:
        raise InsufficientSampleError("equality of means needs two groups", 0 if row is None else row.n_groups, 2)
    return row.asDict() | {"p_value": f_survival(row.statistic, row.df_between, row.df_within)}


def collapse(labels: DataFrame, n_trend: int, n_vol: int) -> DataFrame:
    """Two states an axis."""
    trend, vol = F.floor(F.col("joint") / n_vol), F.col("joint") % n_vol
    two = (trend >= n_trend / 2).cast("long") * 2 + (vol >= n_vol / 2).cast("long")
    return labels.withColumn("joint", F.when(F.col("joint") < 0, -1).otherwise(two))


def transition_matrix(labels: DataFrame, allow_collapse: bool = False, n_trend: int = C.DEFAULT_STATES_PER_AXIS, n_vol: int = C.DEFAULT_STATES_PER_AXIS) -> tuple[DataFrame, bool]:
    """((log_id, src, dst, n, p), whether states were collapsed)."""

    def thinnest(x: DataFrame) -> int:
        return x.where("joint >= 0").groupBy("joint").count().agg(F.min("count")).first()[0] or 0

    done = False
    if (n := thinnest(labels)) < C.MIN_STATE_OBS:
        if not allow_collapse:
            raise RegimeSparsityError("a state is too rare", n, C.MIN_STATE_OBS)
        labels, done = collapse(labels, n_trend, n_vol), True
        if (n := thinnest(labels)) < C.MIN_STATE_OBS:
            raise RegimeSparsityError("a collapsed state is too rare", n, C.MIN_STATE_OBS)
    return _sql(labels, TRANSITIONS, labels=labels), done


def markov_resample(labels: DataFrame, n_paths: int, seed: int, n_steps: int, allow_collapse: bool = False) -> DataFrame:
    """(path_id, step, ret): returns drawn from the pool of a state that follows the transition matrix.

    Paths run in parallel, each a fold over its steps; pools and cumulative rows of one log travel as literals' size.
    """
    matrix, collapsed = transition_matrix(labels, allow_collapse)
    if collapsed:
        labels = collapse(labels, C.DEFAULT_STATES_PER_AXIS, C.DEFAULT_STATES_PER_AXIS)
    pools = {r[0]: r[1] for r in labels.where("joint >= 0").groupBy("joint").agg(F.array_sort(F.collect_list("ret"))).collect()}  # one log's periods
    states = sorted(pools)
    rows: dict[int, dict[int, float]] = {}
    for r in matrix.collect():
        rows.setdefault(r.src, {})[r.dst] = r.p
    n = sum(map(len, pools.values()))
    cumulate = lambda ps: [sum(ps[: k + 1]) for k in range(len(ps))]
    first = cumulate([len(pools[s]) / n for s in states])
    table = [cumulate([rows.get(s, {}).get(d, 1 / len(states) if s not in rows else 0.0) for d in states]) for s in states]
    spark = labels.sparkSession
    held = spark.createDataFrame([(first, table, [list(map(float, pools[s])) for s in states])], "first array<double>, table array<array<double>>, pools array<array<double>>")
    last = len(states) - 1
    pick = lambda cum, u: F.least(F.size(F.filter(cum, lambda c: u > c)), F.lit(last))
    steps = spark.range(n_paths).withColumnRenamed("id", "path_id").join(F.broadcast(held))  # one row
    step_u = lambda name, k: uniform(seed, name, F.col("path_id"), k)
    begin = F.struct(pick(F.col("first"), step_u("state", F.lit(0))).alias("s"), F.array().cast("array<double>").alias("out"))

    def move(acc, k):
        pool = F.get("pools", acc.s)
        drawn = F.get(pool, F.floor(step_u("draw", k) * F.size(pool)).cast("int"))
        return F.struct(pick(F.get("table", acc.s), step_u("state", k + 1)).alias("s"), F.concat(acc.out, F.array(drawn)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(0), F.lit(n_steps - 1)), begin, move)
    return steps.select("path_id", F.posexplode(path.out).alias("step", "ret"))
