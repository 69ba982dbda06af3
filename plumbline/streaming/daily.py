"""Streams: closed trades summed by tumbling days behind a watermark, and a running drawdown for each log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_pnl(trades: DataFrame, time_col: str = "exit_time", lateness: str = "1 day", length: str = "1 day") -> DataFrame:
    """(log_id, period_start, period_end, pnl, n_trades); a trade later than the watermark is left out, as its period is closed."""
    sums = trades.withWatermark(time_col, lateness).groupBy("log_id", F.window(time_col, length)).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n_trades"))
    return sums.select("log_id", F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "pnl", "n_trades")


def running_drawdown(periods: DataFrame, capital: float) -> DataFrame:
    """(log_id, equity, peak, max_drawdown) after each batch; equity and peak are the state of a log."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, worst = state.get if state.exists else (capital, capital, 0.0)
        for b in batches:
            for x in b.sort_values("period_end")["pnl"]:
                equity += float(x)
                peak = max(peak, equity)
                worst = max(worst, 1 - equity / peak)
        state.update((equity, peak, worst))
        yield pd.DataFrame({"log_id": [key[0]], "equity": [equity], "peak": [peak], "max_drawdown": [worst]})

    return periods.groupBy("log_id").applyInPandasWithState(step, "log_id string, equity double, peak double, max_drawdown double", "equity double, peak double, worst double", "update", GroupStateTimeout.NoTimeout)
