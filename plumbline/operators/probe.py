"""What a log says about its own conventions: implied multipliers, spread, the quantum of its profits.

Nothing is validated and no contract is known yet: one aggregate over all rows and one a symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .grid import _sql

#: Powers of ten, coarse to fine, that a column may be rounded to.
STEPS = [10.0**k for k in range(6, -9, -1)]
FINEST = STEPS[-1]

#: The largest step that every value is a multiple of, within a part in 1e9 of the largest or 1e-6 of a step.
QUANTUM = (
    "SELECT CASE WHEN n = 0 OR big = 0 THEN 0e0 "
    + " ".join(f"WHEN off{k} <= greatest(1e-9 * greatest(1e0, big / {s!r}D), 1e-6) THEN {s!r}D" for k, s in enumerate(STEPS))
    + f" ELSE {FINEST!r}D END AS quantum FROM (SELECT count(*) AS n, max(abs(value)) AS big, "
    + ", ".join(f"max(abs(value / {s!r}D - rint(value / {s!r}D))) AS off{k}" for k, s in enumerate(STEPS))
    + " FROM {values}) q"
)

PROBE = """
SELECT symbol, min(row_no) AS first_row, count(move) AS n_usable,
       percentile(net, 0.5e0) AS implied_net, percentile(gross, 0.5e0) AS implied_gross,
       CASE WHEN percentile(net, 0.5e0) <> 0 THEN abs((percentile(net, 0.75e0) - percentile(net, 0.25e0)) / nullif(percentile(net, 0.5e0), 0e0)) END AS spread_net,
       CASE WHEN percentile(gross, 0.5e0) <> 0 THEN abs((percentile(gross, 0.75e0) - percentile(gross, 0.25e0)) / nullif(percentile(gross, 0.5e0), 0e0)) END AS spread_gross,
       coalesce(percentile(CASE WHEN move IS NOT NULL THEN abs(pnl) END, 0.5e0), 0e0) AS typical_pnl, percentile(abs(fees), 0.5e0) AS median_fee, max(abs(fees)) AS largest_fee
FROM (SELECT symbol, row_no, pnl, fees, move, (pnl + fees) / move AS net, pnl / move AS gross
      FROM (SELECT symbol, row_no, pnl, fees, nullif(side * (exit_px - entry_px) * qty, 0e0) AS move FROM {trades}) m) p GROUP BY symbol"""

#: Whether the log can tell net from gross profits, and the multiplier that it implies; a spread without a value is infinite.
JUDGED = f"""
SELECT symbol, first_row, n_usable, implied_net, implied_gross, spread_net, spread_gross, typical_pnl, quantum AS pnl_quantum, detectability,
       CASE WHEN n_usable > 0 AND typical_pnl > 0 AND quantum <= {C.MULTIPLIER_QUANTUM_CEILING}e0 * typical_pnl THEN CASE WHEN net_is_tighter THEN implied_net ELSE implied_gross END END AS implied,
       CASE WHEN detectability = 'DECISIVE' THEN CASE WHEN net_is_tighter THEN 'NET' ELSE 'GROSS' END END AS convention
FROM (SELECT p.*, q.quantum, coalesce(spread_net, 1e308) <= coalesce(spread_gross, 1e308) AS net_is_tighter,
             CASE WHEN largest_fee = 0 THEN 'NO_COST' WHEN median_fee < {C.COST_TO_QUANTUM_FLOOR}e0 * q.quantum THEN 'UNDETECTABLE' ELSE 'DECISIVE' END AS detectability
      FROM {{probed}} p JOIN {{quanta}} q ON q.quantum IS NOT NULL) j"""


def quantum_of(values: DataFrame, column: str) -> float:
    """The largest power of ten that divides every value; 0 for no values or only zeros. One aggregate for all steps."""
    return _sql(values, QUANTUM, values=values.select(F.col(column).cast("double").alias("value"))).first().quantum


def judged_symbols(trades: DataFrame) -> DataFrame:
    """``JUDGED`` of trades (symbol, side, qty, entry_px, exit_px, fees, pnl), by the quantum of all profits.

    ``row_no`` orders the rows; without it they are taken as they come.
    """
    rows = trades if "row_no" in trades.columns else trades.withColumn("row_no", F.monotonically_increasing_id())
    quanta = _sql(rows, QUANTUM, values=rows.select(F.col("pnl").alias("value")))
    return _sql(rows, JUDGED, probed=_sql(rows, PROBE, trades=rows), quanta=quanta)


def probe_symbols(trades: DataFrame) -> list[dict]:
    """A dict for each symbol in order of first appearance: implied multipliers by either convention and whether the log can tell them apart.

    A log can tell when the median cost reaches the quantum of its profits; a multiplier can be read when that
    quantum is at most a quarter of a typical profit among trades that moved. Unreadable ones are nan, a spread
    around nothing is infinite.
    """
    out = []
    for r in judged_symbols(trades).orderBy("first_row").collect():  # a row a symbol
        got = r.asDict()
        del got["first_row"]
        got |= {k: math.inf if got[k] is None else got[k] for k in ("spread_net", "spread_gross")}
        out.append(got | {k: math.nan if got[k] is None else got[k] for k in ("implied_net", "implied_gross", "implied")})
    return out
