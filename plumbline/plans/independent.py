"""Oracle texts in DuckDB's words that share no formula with the operators' SQL.

Each stands for a relation of ``registry`` and is written from the definition, mostly over lists or by joining a
series with itself, so that a mistake in an operator's text shows as a difference.
"""

from __future__ import annotations

#: Sums of squares by hand instead of the engines' own deviations; growth as the last level over the first.
PERIOD_METRICS = """
WITH x AS (SELECT *, ret - <rf> AS e FROM {returns}),
s AS (SELECT log_id, count(*) AS n, sum(e) / count(*) AS m, sum(ret) / count(*) AS mr, CAST(sum(CASE WHEN n_trades > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS active,
             <growth> AS grown, min(ret) = max(ret) AS flat FROM x GROUP BY log_id),
v AS (SELECT x.log_id, sum((x.ret - s.mr) * (x.ret - s.mr)) AS ss, sum(CASE WHEN x.e < 0 THEN x.e * x.e ELSE 0 END) AS down FROM x JOIN s ON x.log_id = s.log_id GROUP BY x.log_id)
SELECT s.log_id, n AS n_periods, active AS active_fraction, n / <ppy> AS years, grown - 1 AS cumulative_return, CASE WHEN grown > 0 THEN exp(ln(grown) * <ppy> / n) - 1 END AS cagr,
       CASE WHEN flat THEN 0e0 ELSE sqrt(<ppy> * ss / (n - 1)) END AS volatility_annualised, CASE WHEN NOT flat THEN m / sqrt(ss / (n - 1)) END AS sharpe_per_period,
       CASE WHEN NOT flat THEN m / sqrt(ss / (n - 1) / <ppy>) END AS sharpe_annualised, CASE WHEN down > 0 THEN m * sqrt(<ppy> * n / down) END AS sortino, CASE WHEN NOT flat THEN m * n / ss END AS kelly
FROM s JOIN v ON s.log_id = v.log_id"""

#: Every level beside all levels before it.
DRAWDOWN = """
WITH e AS (SELECT DISTINCT log_id, -1 AS idx, <capital> AS equity FROM {curve} UNION ALL SELECT log_id, period_idx, equity FROM {curve}),
u AS (SELECT b.log_id, b.idx, b.equity, max(a.equity) AS top, 1 - b.equity / max(a.equity) AS fall FROM e a JOIN e b ON a.log_id = b.log_id AND a.idx <= b.idx GROUP BY b.log_id, b.idx, b.equity),
t AS (SELECT log_id, max(fall) AS depth, arg_max(top, (fall, -idx)) AS top, arg_max(idx, (fall, -idx)) AS trough, max(idx) AS last_idx, sum(CASE WHEN fall > 0 THEN 1 ELSE 0 END) / CAST(max(idx) + 1 AS DOUBLE) AS time_underwater FROM u GROUP BY log_id),
w AS (SELECT t.log_id, min(u.idx) FILTER (u.equity = t.top AND u.idx <= t.trough) AS began, min(u.idx) FILTER (u.equity >= t.top AND u.idx > t.trough) AS back FROM t JOIN u ON t.log_id = u.log_id GROUP BY t.log_id)
SELECT t.log_id, depth AS max_drawdown, CASE WHEN depth > 0 THEN coalesce(back, last_idx) - began ELSE 0 END AS max_drawdown_duration, depth = 0 OR back IS NOT NULL AS recovered, time_underwater
FROM t JOIN w ON t.log_id = w.log_id"""

#: Products of a list with itself, moved by each lag.
AUTOCOVARIANCE = """
SELECT log_id, lag, list_sum(list_transform(generate_series(lag + 1, n), lambda i: x[i] * x[i - lag])) / n AS gamma, n
FROM (SELECT log_id, list(c ORDER BY period_idx) AS x, count(*) AS n, unnest(generate_series(0, least(<max_lag>, count(*) - 1))) AS lag FROM {centred} GROUP BY log_id) l"""

#: Quantiles of all earlier rows by joining the series with itself.
LABELS = """
WITH q AS (SELECT b.log_id, b.period_idx, quantile_cont(a.trend, [1 / 3e0, 2 / 3e0]) AS tc, quantile_cont(a.volatility, [1 / 3e0, 2 / 3e0]) AS vc
           FROM {trailing} a JOIN {trailing} b ON a.log_id = b.log_id AND a.period_idx < b.period_idx GROUP BY b.log_id, b.period_idx),
s AS (SELECT t.log_id, t.period_idx, t.ret, CASE WHEN t.period_idx < <warmup> THEN -1 ELSE (tc[1] <= trend)::INT + (tc[2] <= trend)::INT END AS ts,
             CASE WHEN t.period_idx < <warmup> THEN -1 ELSE (vc[1] <= volatility)::INT + (vc[2] <= volatility)::INT END AS vs
      FROM {trailing} t LEFT JOIN q ON t.log_id = q.log_id AND t.period_idx = q.period_idx)
SELECT log_id, period_idx, ret, CAST(ts AS BIGINT) AS trend_state, CAST(vs AS BIGINT) AS vol_state, CASE WHEN ts < 0 THEN -1 ELSE CAST(ts * <n_vol> + vs AS BIGINT) END AS joint FROM s"""

#: The quantile from the two order statistics beside it.
TAIL = """
WITH o AS (SELECT terminal, row_number() OVER (ORDER BY terminal) - 1 AS k, count(*) OVER () AS n FROM {terminals}),
c AS (SELECT max(n) AS n, sum(terminal * greatest(0, 1 - abs(k - <tail> * (n - 1)))) AS cut FROM o)
SELECT -max(cut) AS value_at_risk, -sum(CASE WHEN terminal <= cut THEN terminal END) / sum(CASE WHEN terminal <= cut THEN 1 END) AS expected_shortfall, max(c.n) AS n_paths FROM o, c"""

#: Masks by blocks by configurations, summed.
SIDES = """
WITH m AS (SELECT mask, unnest(range(<splits>)) AS block FROM (SELECT unnest(range(<all>)) AS mask) x WHERE bit_count(mask) = <half>),
g AS (SELECT mask, config_idx, (mask >> CAST(m.block AS INT)) & 1 AS side, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM m JOIN {blocks} t ON m.block = t.block GROUP BY mask, config_idx, side),
v AS (SELECT *, (ss - s * s / n) / (n - 1) AS var FROM g)
SELECT mask, config_idx, max(CASE WHEN side = 1 THEN CASE WHEN var > <eps> THEN s / n / sqrt(var) ELSE 0 END END) AS inside, max(CASE WHEN side = 0 THEN CASE WHEN var > <eps> THEN s / n / sqrt(var) ELSE 0 END END) AS outside
FROM v GROUP BY mask, config_idx"""

LOGITS = """
SELECT r.mask, CAST(sum(CASE WHEN s.outside <= r.best THEN 1 ELSE 0 END) AS BIGINT) AS place, count(*) AS n_configs
FROM (SELECT mask, outside AS best FROM {sides} QUALIFY row_number() OVER (PARTITION BY mask ORDER BY inside DESC, config_idx) = 1) r
JOIN {sides} s ON r.mask = s.mask GROUP BY r.mask"""

#: The drawn returns themselves, one by one.
REPLICATES = """
SELECT i.path_id AS rep, t.config_idx, avg(t.ret) AS mean_star FROM {indices} i JOIN {trials} t ON i.src_idx = t.period_idx GROUP BY i.path_id, t.config_idx"""
