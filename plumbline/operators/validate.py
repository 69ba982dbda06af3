"""Coherence of a trade log: every predicate in one aggregate; offenders are fetched only after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError, SchemaError, TradeIntegrityError

COUNTS = """
SELECT count(*) AS n, count(*) - count(DISTINCT trade_id) AS repeated_ids, CAST(sum(CASE WHEN exit_ns < entry_ns THEN 1 ELSE 0 END) AS BIGINT) AS exits_before_entries,
       CAST(sum(CASE WHEN qty > 0 AND multiplier > 0 THEN 0 ELSE 1 END) AS BIGINT) AS bad_sizes, CAST(sum(CASE WHEN fees >= 0 THEN 0 ELSE 1 END) AS BIGINT) AS negative_fees,
       CAST(sum(CASE WHEN abs(pnl - (side * (exit_px - entry_px) * qty * multiplier - fees)) <= greatest(0.01e0 * multiplier * qty, 1e-6 * abs(gross_pnl)) THEN 0 ELSE 1 END) AS BIGINT) AS incoherent
FROM {trades}"""

SHOWN = 5


def offenders(trades: DataFrame, bad) -> str:
    got = [r[0] for r in trades.where(bad).select("trade_id").orderBy("trade_id").limit(SHOWN + 1).collect()]
    return ", ".join(map(str, got[:SHOWN])) + (", ..." if len(got) > SHOWN else "")


def validate_trades(trades: DataFrame, tick_sizes: dict[str, float], rtol: float = C.PNL_RTOL) -> DataFrame:
    """The log itself if it is coherent, else the first refusal in the order of the checks."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    gross = F.col("side") * (F.col("exit_px") - F.col("entry_px")) * F.col("qty") * F.col("multiplier")
    tick = F.create_map(*[x for k, v in sorted(tick_sizes.items()) for x in (F.lit(k), F.lit(float(v)))]) if tick_sizes else None
    of_symbol = F.try_element_at(tick, F.col("symbol")) if tick is not None else F.lit(None).cast("double")
    residual = F.abs(F.col("pnl") - (gross - F.col("fees")))
    slack = F.greatest(of_symbol * F.col("multiplier") * F.col("qty"), F.lit(rtol) * F.abs(gross))
    sizes = (F.col("qty") > 0) & (F.col("multiplier") > 0) & ~F.isnan("qty") & ~F.isnan("multiplier")
    tests = [
        ("exits before entries", F.col("exit_ns") < F.col("entry_ns")),
        ("quantity or multiplier not positive", ~F.coalesce(sizes, F.lit(False))),
        ("negative fees", ~F.coalesce(F.col("fees") >= 0, F.lit(False))),
        ("values not finite", ~(finite("entry_px") & finite("exit_px") & finite("pnl") & finite("fees"))),
    ]
    counts = trades.agg(
        F.count("*").alias("n"), F.count_distinct("trade_id").alias("ids"), *[F.count_if(t).alias(f"t{k}") for k, (_, t) in enumerate(tests)],
        F.collect_set(F.when(of_symbol.isNull(), F.col("symbol"))).alias("no_tick"), F.count_if(residual > slack).alias("off"), F.max_by(F.struct("trade_id", residual.alias("r"), slack.alias("s")), residual - slack).alias("worst"),
    ).first()
    if not counts.n:
        raise InsufficientSampleError("the log is empty", 0, 1)
    if counts.ids < counts.n:
        again = trades.groupBy("trade_id").count().where("count > 1")
        raise TradeIntegrityError(f"trade ids repeat: {offenders(again, F.lit(True))}", counts.n - counts.ids, 0)
    for k, (what, test) in enumerate(tests):
        if counts[f"t{k}"]:
            raise TradeIntegrityError(f"{what}: {offenders(trades, test)}", counts[f"t{k}"], 0)
    if counts.no_tick:
        raise SchemaError(f"no tick size for {', '.join(sorted(counts.no_tick)[:SHOWN])}")
    if bad := [k for k, v in tick_sizes.items() if not v > 0]:
        raise SchemaError(f"tick sizes must be positive: {', '.join(sorted(bad))}")
    if counts.off:
        w = counts.worst
        raise TradeIntegrityError(f"{counts.off} trades don't match their prices; the worst is {w.trade_id}", w.r, w.s)
    return trades
