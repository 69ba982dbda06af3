"""Statistics of a level series: the shape of its grid and the metrics of its returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import InsufficientSampleError
from ..operators import grid, metrics
from ..sources.series import to_period_returns


def describe_series(series: DataFrame, risk_free_rate: float = 0.0) -> dict:
    """Of (series_id, obs_idx, day, value); the rate of a year comes from the rung, for days from the series itself."""
    rung = grid.observed_grid(series.select("series_id", "day"))
    n, lo, hi = series.agg(F.count("*"), F.min("day"), F.max("day")).first()
    if n < 3:
        raise InsufficientSampleError("a series needs three observations", n, 3)
    rate = {"DAILY": (n - 1) / ((hi - lo) / 365.25), "WEEKLY": C.WEEKS_PER_YEAR, "MONTHLY": C.MONTHS_PER_YEAR}[rung["period"]]
    returns = to_period_returns(series)
    row = metrics.period_metrics(returns, rate, risk_free_rate, C.CURRENT_EQUITY).first().asDict()
    curve = metrics.equity_curve(returns, C.CURRENT_EQUITY, 1.0)
    down = metrics.drawdown_profile(curve, 1.0).first().asDict()
    return {"series_id": rung["series_id"], "period": rung["period"], "periods_per_year": rate, "n_observations": n, "gap_excess": rung["excess"], "warnings": metrics.period_warnings(row)} | {k: v for k, v in (row | down).items() if k != "log_id"}
