"""Calendar grid: sessions, attribution of trades to periods, returns by trade and by period, choice of a rung.

Trades are keyed by log_id, so one plan serves one log or many. Times are nanoseconds UTC as BIGINT. Trades are
numbered in two levels, days and then within a day, and summed up through a tree, so no log needs one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import CalendarCoverageError, GridSparsityError, InsufficientSampleError, SchemaError, TradeIntegrityError
from ..functions.staging import staged

SESSIONS = """
WITH days AS (SELECT explode(sequence(lo, hi)) AS day FROM (SELECT CAST(<lo> AS BIGINT) AS lo, CAST(<hi> AS BIGINT) AS hi FROM {bounds}) b),
closes AS (SELECT day * 86400000000000 + <close_ns> AS close_ns FROM days WHERE (day + 3) % 7 < 5)
SELECT row_number() OVER (ORDER BY close_ns) - 1 AS session_idx,
       coalesce(lag(close_ns) OVER (ORDER BY close_ns), close_ns - 86400000000000) AS prev_close_ns, close_ns
FROM closes"""

BOUNDS = "SELECT min(exit_ns) div 86400000000000 AS first_day, max(exit_ns) div 86400000000000 AS last_day FROM {trades}"

#: A session's interval is laid out over the days it touches; the join is an equi-join on the day.
DAILY_KEY = """
WITH spans AS (SELECT session_idx, prev_close_ns, close_ns, explode(sequence((prev_close_ns + 1) div 86400000000000, close_ns div 86400000000000)) AS day FROM {sessions})
SELECT t.log_id, t.trade_id, t.entry_ns, t.exit_ns, t.pnl, s.close_ns AS period_end_ns
FROM {trades} t JOIN spans s ON t.exit_ns div 86400000000000 = s.day AND t.exit_ns > s.prev_close_ns AND t.exit_ns <= s.close_ns"""

WEEKLY_KEY = """
SELECT log_id, trade_id, entry_ns, exit_ns, pnl, (day - (day + 3) % 7 + 7) * 86400000000000 - 1 AS period_end_ns
FROM (SELECT *, exit_ns div 86400000000000 AS day FROM {trades}) t"""

MONTHLY_KEY = """
SELECT log_id, trade_id, entry_ns, exit_ns, pnl,
       unix_date(add_months(trunc(date_from_unix_date(CAST(exit_ns div 86400000000000 AS INT)), 'MM'), 1)) * 86400000000000 - 1 AS period_end_ns
FROM {trades}"""

#: The only pass over the trades of a grid; all that follows reads a row a log and traded period.
TOTALS = "SELECT log_id, period_end_ns, sum(pnl) AS pnl, count(*) AS n_trades FROM {keyed} GROUP BY log_id, period_end_ns"

#: Every period between a log's first and last one, empty ones too. Sessions are met day by day, not by a range.
DAILY_GRID = """
SELECT k.log_id, s.close_ns AS period_end_ns
FROM (SELECT log_id, lo, hi, explode(sequence(lo div 86400000000000, hi div 86400000000000)) AS day
      FROM (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {totals} GROUP BY log_id) t) k
JOIN {sessions} s ON s.close_ns div 86400000000000 = k.day AND s.close_ns >= k.lo AND s.close_ns <= k.hi"""

WEEKLY_GRID = """
SELECT log_id, explode(sequence(lo, hi, 604800000000000)) AS period_end_ns
FROM (SELECT log_id, min(period_end_ns) AS lo, max(period_end_ns) AS hi FROM {totals} GROUP BY log_id) k"""

MONTHLY_GRID = """
SELECT log_id, unix_date(add_months(first, CAST(step AS INT))) * 86400000000000 - 1 AS period_end_ns
FROM (SELECT log_id, first, explode(sequence(0, months)) AS step
      FROM (SELECT log_id, date_from_unix_date(CAST((min(period_end_ns) + 1) div 86400000000000 AS INT)) AS first,
                   CAST(months_between(date_from_unix_date(CAST((max(period_end_ns) + 1) div 86400000000000 AS INT)), date_from_unix_date(CAST((min(period_end_ns) + 1) div 86400000000000 AS INT))) AS INT) AS months
            FROM {totals} GROUP BY log_id) k) m"""

PERIOD_SUMS = """
SELECT g.log_id, row_number() OVER (PARTITION BY g.log_id ORDER BY g.period_end_ns) - 1 AS period_idx, g.period_end_ns,
       coalesce(s.pnl, 0e0) AS pnl, coalesce(s.n_trades, 0) AS n_trades
FROM {grid} g LEFT JOIN {totals} s ON g.log_id = s.log_id AND g.period_end_ns = s.period_end_ns"""

RETURNS = {
    C.FIXED_INITIAL: "SELECT log_id, period_idx, period_end_ns, n_trades, pnl / <capital> AS ret FROM {sums}",
    C.CURRENT_EQUITY: """
SELECT log_id, period_idx, period_end_ns, n_trades,
       pnl / (<capital> + coalesce(sum(pnl) OVER (PARTITION BY log_id ORDER BY period_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) AS ret
FROM {sums}""",
}

#: Running sums go through a tree over the trades' numbers: nodes of 16 trades, of 16 such nodes and so on. A trade's sum
#: is folded from the largest nodes before it down to the trades beside it. Errors then grow with the depth, not with
#: the number of trades, and engines that sum windows through such a tree round the same. A row of a table holds two
#: levels, and no task needs more of a log than a row for each 16 million trades.
FANOUT = 16
SPAN = FANOUT * FANOUT


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` bound to a name, so that it's computed once and not for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(values: str, start: str) -> str:
    """Sum from the left; as in SQL, nothing known gives null."""
    return f"aggregate({values}, {start}, (s, x) -> coalesce(s + x, s, x))"


UNKNOWN = "CAST(NULL AS DOUBLE)"
_NODES = f"transform(sequence(0, CAST((size(vs) - 1) div {FANOUT} AS INT)), m -> {_fold(f'slice(vs, {FANOUT} * m + 1, {FANOUT})', UNKNOWN)})"


def _total(values: str) -> str:
    """Sum of up to SPAN values as their node has it."""
    return _let("vs", values, _fold(_NODES, UNKNOWN))


def _prefixes(values: str, before: str, upto: str | None) -> str:
    """What stands before each value and, at the end, after all. ``upto``: after a full row, if there is a level above."""
    starts = f"transform(sequence(0, CAST(size(vs) div {FANOUT} AS INT)), m -> {_fold('slice(nodes, 1, m)', before)})"
    each = _fold(f"slice(vs, {FANOUT} * CAST(e div {FANOUT} AS INT) + 1, e % {FANOUT})", f"starts[CAST(e div {FANOUT} AS INT)]")
    each = f"CASE WHEN e = {SPAN} THEN {upto} ELSE {each} END" if upto else each
    return _let("vs", values, _let("nodes", _NODES, _let("starts", starts, f"transform(sequence(0, size(vs)), e -> {each})")))


NUMBERED = """
WITH t AS (SELECT log_id, trade_id, exit_ns, pnl, exit_ns div 86400000000000 AS day FROM {trades}),
totals AS (SELECT log_id, day, count(*) AS n FROM t GROUP BY log_id, day),
offsets AS (SELECT log_id, day, coalesce(sum(n) OVER (PARTITION BY log_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before FROM totals)
SELECT t.log_id, t.trade_id, t.exit_ns, t.pnl, CAST(rows_before AS BIGINT) + row_number() OVER (PARTITION BY t.log_id, t.day ORDER BY t.exit_ns, t.trade_id) - 1 AS trade_idx
FROM t JOIN offsets o ON t.log_id = o.log_id AND t.day = o.day"""

SPANS = f"SELECT log_id, trade_idx div {SPAN} AS k, array_sort(collect_list(struct(trade_idx, trade_id, exit_ns, pnl))) AS below FROM {{numbered}} GROUP BY log_id, trade_idx div {SPAN}"
SPAN_TOTALS = f"SELECT log_id, k, {_total('transform(below, c -> c.pnl)')} AS total FROM {{spans}}"
#: A row holds the rows of the level below that it covers; the last one all that are left of a log.
LEVEL = f"SELECT log_id, k div {SPAN} AS k, array_sort(collect_list(struct(k, total))) AS below FROM {{totals}} GROUP BY log_id, k div {SPAN}"
LEVEL_TOTALS = f"SELECT log_id, k, {_total('transform(below, c -> c.total)')} AS total FROM {{level}}"
WHOLE = "SELECT log_id, array_sort(collect_list(struct(k, total))) AS below FROM {totals} GROUP BY log_id"
WHOLE_SUMS = f"SELECT log_id, below, {_prefixes('transform(below, c -> c.total)', UNKNOWN, None)} AS sums FROM {{whole}}"
LEVEL_SUMS = f"SELECT l.log_id, l.below, {_prefixes('transform(l.below, c -> c.total)', 'p.before', 'p.upto')} AS sums FROM {{level}} l JOIN {{places}} p ON l.log_id = p.log_id AND l.k = p.k"
PLACES = "SELECT log_id, below[at].k AS k, sums[at] AS before, sums[at + 1] AS upto FROM (SELECT log_id, below, sums, explode(sequence(0, size(below) - 1)) AS at FROM {sums}) s"
SPAN_SUMS = f"SELECT l.log_id, l.below, {_prefixes('transform(l.below, c -> c.pnl)', 'p.before', 'p.upto')} AS sums FROM {{spans}} l JOIN {{places}} p ON l.log_id = p.log_id AND l.k = p.k"
RUNNING = """
SELECT log_id, r.trade.trade_id AS trade_id, r.trade.exit_ns AS exit_ns, r.trade.pnl AS pnl, r.trade.trade_idx AS trade_idx, <capital> + r.after AS equity
FROM (SELECT log_id, explode(zip_with(below, slice(sums, 2, size(below)), (trade, after) -> struct(trade, after))) AS r FROM {sums}) s"""

TRADE_RETURNS = {
    C.FIXED_INITIAL: "SELECT log_id, trade_id, trade_idx, pnl / <capital> AS ret FROM {running}",
    C.CURRENT_EQUITY: "SELECT log_id, trade_id, trade_idx, pnl / (equity - pnl) AS ret FROM {running}",
}

#: One row a rung: how dense it is, and how long trades are held beside its periods.
DIAGNOSIS = """
SELECT s.log_id, '<period>' AS period, s.n_periods, s.active_fraction, h.median_holding_ns / s.median_period_ns AS holding_ratio,
       s.active_fraction >= 0.15e0 AND s.n_periods >= 60 AND h.median_holding_ns / s.median_period_ns <= 1e0 AS feasible
FROM (SELECT log_id, count(*) AS n_periods, CAST(sum(CASE WHEN n_trades > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS active_fraction,
             coalesce(percentile(gap, 0.5e0), <nominal_ns>) AS median_period_ns
      FROM (SELECT *, CAST(period_end_ns - lag(period_end_ns) OVER (PARTITION BY log_id ORDER BY period_idx) AS DOUBLE) AS gap FROM {sums}) g GROUP BY log_id) s
JOIN (SELECT log_id, percentile(CAST(exit_ns - entry_ns AS DOUBLE), 0.5e0) AS median_holding_ns FROM {trades} GROUP BY log_id) h ON s.log_id = h.log_id"""

NOMINAL_NS = {"DAILY": C.DAY_NS, "WEEKLY": 7 * C.DAY_NS, "MONTHLY": 30 * C.DAY_NS}
RANK = {"DAILY": 0, "WEEKLY": 1, "MONTHLY": 2}


def _sql(df: DataFrame, text: str, **frames: DataFrame) -> DataFrame:
    return df.sparkSession.sql(text, **frames)


def _fill(text: str, **values: object) -> str:
    for k, v in values.items():
        text = text.replace(f"<{k}>", f"{float(v)!r}e0" if isinstance(v, float) and "e" not in repr(float(v)) else str(v))
    return text


def _capital(value: float) -> float:
    if not value > 0:
        raise SchemaError(f"initial capital must be positive, got {value}")
    return float(value)


def weekday_sessions(trades: DataFrame, padding_days: int = C.CALENDAR_PADDING_DAYS, close_ns: int = 75_600_000_000_000) -> DataFrame:
    """Sessions of all weekdays around a log, closing at 21:00 UTC: (session_idx, prev_close_ns, close_ns)."""
    bounds = _sql(trades, BOUNDS, trades=trades)
    return _sql(trades, _fill(SESSIONS, lo=f"first_day - {padding_days}", hi=f"last_day + {padding_days}", close_ns=close_ns), bounds=bounds)


def sessions_per_year(sessions: DataFrame) -> float:
    n, lo, hi = sessions.agg(F.count(F.lit(1)), F.min("close_ns"), F.max("close_ns")).first()
    if n < 2:
        raise CalendarCoverageError("a rate needs two sessions", n, 2)
    return (n - 1) / ((hi - lo) / C.JULIAN_YEAR_NS)


def check_coverage(trades: DataFrame, sessions: DataFrame) -> None:
    """Every exit at or before the last close; no first exit a median gap or more before the first close."""
    lo, hi = trades.agg(F.min("exit_ns"), F.max("exit_ns")).first()
    first, last, gap = sessions.agg(F.min("close_ns"), F.max("close_ns"), F.expr("percentile(CAST(close_ns - prev_close_ns AS DOUBLE), 0.5)")).first()
    if lo is None:
        raise InsufficientSampleError("the log is empty", 0, 1)
    if hi > last:
        raise CalendarCoverageError("the last exit lies after the last session", hi, last)
    if lo <= first - gap:
        raise CalendarCoverageError("the first exit lies before the calendar", lo, first)


def running_equity(trades: DataFrame, capital: float) -> DataFrame:
    """(log_id, trade_id, exit_ns, pnl, trade_idx, equity): equity after each trade.

    Trades are read twice: once for the totals of each 256 of them, a staged table, and once to be placed.
    """
    sql = partial(_sql, trades)
    spans = sql(SPANS, numbered=sql(NUMBERED, trades=trades))
    totals1 = staged(sql(SPAN_TOTALS, spans=spans), "span-totals")
    level2 = sql(LEVEL, totals=totals1)
    level3 = sql(LEVEL, totals=sql(LEVEL_TOTALS, level=level2))
    places = sql(PLACES, sums=sql(WHOLE_SUMS, whole=sql(WHOLE, totals=sql(LEVEL_TOTALS, level=level3))))
    for level in (level3, level2):
        places = sql(PLACES, sums=sql(LEVEL_SUMS, level=level, places=places))
    return sql(_fill(RUNNING, capital=_capital(capital)), sums=sql(SPAN_SUMS, spans=spans, places=places))


def check_solvency(running: DataFrame, basis: str) -> None:
    """With a basis of current equity, equity must stay above zero; the first trade that breaks it is named."""
    if basis != C.CURRENT_EQUITY:
        return
    bad = running.where("equity <= 0").agg(F.min_by("trade_id", "trade_idx"), F.min_by("equity", "trade_idx")).first()
    if bad[0] is not None:
        raise TradeIntegrityError(f"equity is used up at trade {bad[0]}", bad[1], 0)


def trade_returns(trades: DataFrame, basis: str = C.FIXED_INITIAL, capital: float = 1.0) -> DataFrame:
    """Return of each trade on the initial capital, or on the equity before the trade. Has no period: can't be annualised."""
    running = running_equity(trades, capital)
    check_solvency(running, basis)
    return _sql(trades, _fill(TRADE_RETURNS[basis], capital=_capital(capital)), running=running)


def period_sums(trades: DataFrame, period: str, sessions: DataFrame | None = None) -> DataFrame:
    """(log_id, period_idx, period_end_ns, pnl, n_trades) of all periods from the first to the last traded one.

    The trades are read once, into a staged table of traded periods.
    """
    if period not in C.PERIODS:
        raise SchemaError(f"no such period: {period}")
    if period == "DAILY":
        sessions = sessions if sessions is not None else weekday_sessions(trades)
        totals = staged(_sql(trades, TOTALS, keyed=_sql(trades, DAILY_KEY, trades=trades, sessions=sessions)), "daily-totals")
        grid = _sql(trades, DAILY_GRID, totals=totals, sessions=sessions)
    else:
        key, rows = (WEEKLY_KEY, WEEKLY_GRID) if period == "WEEKLY" else (MONTHLY_KEY, MONTHLY_GRID)
        totals = staged(_sql(trades, TOTALS, keyed=_sql(trades, key, trades=trades)), f"{period.lower()}-totals")
        grid = _sql(trades, rows, totals=totals)
    return _sql(trades, PERIOD_SUMS, grid=grid, totals=totals)


def period_returns(trades: DataFrame, period: str, basis: str = C.FIXED_INITIAL, capital: float = 1.0, sessions: DataFrame | None = None) -> DataFrame:
    """(log_id, period_idx, period_end_ns, n_trades, ret)."""
    if basis == C.CURRENT_EQUITY:
        check_solvency(running_equity(trades, capital), basis)
    return _sql(trades, _fill(RETURNS[basis], capital=_capital(capital)), sums=period_sums(trades, period, sessions))


@dataclass(frozen=True)
class GridSelection:
    period: str
    forced: bool
    periods_per_year: float
    candidates: list[dict]
    warnings: list[str]


def diagnose(trades: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """A row for each rung of each log."""
    frames = [_sql(trades, _fill(DIAGNOSIS, period=p, nominal_ns=float(NOMINAL_NS[p])), sums=period_sums(trades, p, sessions), trades=trades) for p in C.PERIODS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def rejections(c: dict) -> list[str]:
    tests = (("active_fraction", c["active_fraction"] >= C.MIN_ACTIVE_FRACTION, C.MIN_ACTIVE_FRACTION), ("n_periods", c["n_periods"] >= C.MIN_PERIODS, C.MIN_PERIODS), ("holding_ratio", c["holding_ratio"] <= C.MAX_HOLDING_TO_PERIOD, C.MAX_HOLDING_TO_PERIOD))
    return [f"{name} {c[name]:.6g} against {limit:g}" for name, ok, limit in tests if not ok]


def select_grid(trades: DataFrame, sessions: DataFrame | None = None, forced_period: str | None = None) -> GridSelection:
    """The finest rung that is dense enough. A forced rung only warns; no rung at all is refused with every reason."""
    sessions = sessions if sessions is not None else weekday_sessions(trades)
    check_coverage(trades, sessions)
    found = {r.period: r.asDict() for r in diagnose(trades, sessions).collect()}  # three rows
    listed = [found[p] | {"rejections": rejections(found[p])} for p in C.PERIODS]
    rate = {"DAILY": sessions_per_year(sessions), "WEEKLY": C.WEEKS_PER_YEAR, "MONTHLY": C.MONTHS_PER_YEAR}
    if forced_period:
        why = next(c["rejections"] for c in listed if c["period"] == forced_period)
        return GridSelection(forced_period, True, rate[forced_period], listed, [f"forced {forced_period}: {x}" for x in why])
    chosen = next((c["period"] for c in listed if c["feasible"]), None)
    if chosen is None:
        raise GridSparsityError("no rung is feasible: " + "; ".join(f"{c['period']}: {', '.join(c['rejections'])}" for c in listed), max(c["active_fraction"] for c in listed), C.MIN_ACTIVE_FRACTION)
    return GridSelection(chosen, False, rate[chosen], listed, [])


GAPS = """
WITH g AS (SELECT series_id, day, day - lag(day) OVER (PARTITION BY series_id ORDER BY day) AS gap FROM {series}),
c AS (SELECT series_id, gap, count(*) AS n, min(day) AS first_seen FROM g WHERE gap IS NOT NULL GROUP BY series_id, gap),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, first_seen) AS place FROM c),
m AS (SELECT series_id, gap AS modal_gap, CASE WHEN gap BETWEEN 1 AND 4 THEN 4 WHEN gap BETWEEN 5 AND 9 THEN 9 WHEN gap BETWEEN 26 AND 35 THEN 35 END AS top,
             CASE WHEN gap BETWEEN 1 AND 4 THEN 'DAILY' WHEN gap BETWEEN 5 AND 9 THEN 'WEEKLY' WHEN gap BETWEEN 26 AND 35 THEN 'MONTHLY' END AS period FROM r WHERE place = 1)
SELECT m.series_id, m.modal_gap, m.period, count(*) + 1 AS n_obs, CAST(sum(greatest(g.gap - m.top, 0)) AS DOUBLE) / sum(g.gap) AS excess
FROM m JOIN g ON m.series_id = g.series_id AND g.gap IS NOT NULL GROUP BY m.series_id, m.modal_gap, m.period"""


def observed_grid(series: DataFrame) -> dict:
    """Rung of a level series (series_id, day) from its modal gap in days; the first seen wins ties."""
    got = _sql(series, GAPS, series=series).first()
    if got is None or got.n_obs < 3:
        raise InsufficientSampleError("a grid needs three observations", 0 if got is None else got.n_obs, 3)
    if got.period is None:
        raise GridSparsityError("the modal gap fits no rung", got.modal_gap, str(C.GAP_BANDS))
    if got.excess > C.MAX_GAP_EXCESS_FRACTION:
        raise GridSparsityError("gaps take too large a share of the span", got.excess, C.MAX_GAP_EXCESS_FRACTION)
    return got.asDict()


def common_window(trials: DataFrame) -> DataFrame:
    """Trials (config_id, period_end_ns, ret) within the window that all configurations cover."""
    ends = trials.groupBy("config_id").agg(F.min("period_end_ns").alias("lo"), F.max("period_end_ns").alias("hi")).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return trials.join(ends, (F.col("period_end_ns") >= F.col("lo")) & (F.col("period_end_ns") <= F.col("hi"))).drop("lo", "hi")


def build_trials(trades: DataFrame, sessions: DataFrame | None = None, first_log: str | None = None, basis: str = C.FIXED_INITIAL, capital: float = 1.0) -> tuple[DataFrame, GridSelection, dict]:
    """The matrix of at least two logs on one grid: chosen on the first log, forced on the rest, cut to the common window.

    Returns (config_id, period_end_ns, ret), the selection and how many periods each log lost at either end.
    """
    logs = sorted(r[0] for r in trades.select("log_id").distinct().collect())  # names of logs, a row each
    if len(logs) < 2:
        raise InsufficientSampleError("a matrix needs two logs", len(logs), 2)
    sessions = sessions if sessions is not None else weekday_sessions(trades)
    lead = first_log or logs[0]
    choice = select_grid(trades.where(F.col("log_id") == lead), sessions)
    returns = period_returns(trades, choice.period, basis, capital, sessions).select(F.col("log_id").alias("config_id"), "period_end_ns", "ret")
    kept = common_window(returns)
    n = kept.groupBy("config_id").count().agg(F.min("count")).first()[0] or 0
    if n < C.MIN_PERIODS:
        raise InsufficientSampleError("the common window is too short", n, C.MIN_PERIODS)
    ends = kept.agg(F.min("period_end_ns"), F.max("period_end_ns")).first()
    trimmed = {r[0]: (r[1], r[2]) for r in returns.groupBy("config_id").agg(F.count_if(F.col("period_end_ns") < ends[0]), F.count_if(F.col("period_end_ns") > ends[1])).collect()}
    return kept, choice, trimmed


def wide_trials(trials: DataFrame) -> DataFrame:
    """The matrix with a column for each configuration."""
    return trials.groupBy("period_end_ns").pivot("config_id").agg(F.first("ret")).orderBy("period_end_ns")
