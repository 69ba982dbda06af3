"""The trade log that stands in the star-schema tables: line items as closed trades, part brands as configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Symbols are part brands; a trade closes on the ship date and was opened some hours before. Ids hold every key
#: and amount, so that ties are ordered the same everywhere.
TRADES = """
SELECT <log> AS log_id,
       lpad(CAST(l_orderkey AS STRING), 12, '0') || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100e0) AS BIGINT) AS STRING) || '-' || CAST(CAST(round(l_discount * 100e0) AS BIGINT) AS STRING) || '-' || CAST(CAST(round(l_tax * 100e0) AS BIGINT) AS STRING) AS trade_id,
       symbol, side, qty, multiplier, entry_ns, exit_ns, entry_px, exit_px, fees, side * (exit_px - entry_px) * qty * multiplier AS gross_pnl,
       side * (exit_px - entry_px) * qty * multiplier - fees AS pnl
FROM (SELECT l.*, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS qty, CASE WHEN p_size > 25 THEN 50e0 ELSE 20e0 END AS multiplier,
             unix_date(CAST(l_shipdate AS DATE)) * 86400000000000 - CAST(l_linenumber AS BIGINT) * 3600000000000 AS entry_ns, unix_date(CAST(l_shipdate AS DATE)) * 86400000000000 AS exit_ns,
             p_retailprice AS entry_px, p_retailprice * (1e0 + (l_discount - l_tax - 0.01e0) / 10e0) AS exit_px, l_tax * 10e0 AS fees
      FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) t"""

CAPITAL = 1e7


def trades(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    sql = TRADES.replace("<log>", "symbol" if by_symbol else "'book'")
    return spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
