import os

import pytest

from plumbline.plans.queries import ORACLE_SQL as SQL
from plumbline.plans.queries import QUERIES

from .conftest import SF
from .oracle import assert_same, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_the_oracle(spark, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_grid_choice_of_a_log_that_uses_its_equity_up(spark, tmp_path):
    from pyspark.sql import functions as F

    from plumbline import constants as C
    from plumbline.errors import TradeIntegrityError
    from plumbline.operators import grid
    from plumbline.sources.testdata import CAPITAL, trades

    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    large = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_quantity", F.col("l_quantity") * 10_000)
    large.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(TradeIntegrityError):
        grid.check_solvency(grid.running_equity(trades(spark, str(tmp_path)), CAPITAL), C.CURRENT_EQUITY)
    assert_same(QUERIES["grid_choice"](spark, str(tmp_path)), SQL["grid_choice"], str(tmp_path))


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.1"])
def test_running_equity_rounds_as_its_sql(spark, sf_dir):
    """Returns on current equity near zero show the last bits of the sums."""
    from plumbline.plans import registry

    columns = ["trade_idx", "trade_id", "pnl", "equity"]
    got = registry.running.frame(spark, sf_dir).select(columns).toPandas().sort_values("trade_idx", ignore_index=True)
    want = rows(f"SELECT {', '.join(columns)} FROM ({registry.running.duck()}) r", sf_dir).sort_values("trade_idx", ignore_index=True)
    assert len(got) == len(want) and all((got[c].to_numpy() == want[c].to_numpy()).all() for c in columns)


def test_running_equity_of_several_logs_and_unknown_profits(spark):
    from plumbline.operators import grid

    day = 86_400_000_000_000
    logs = {"empty so far": [None, None, 1.0, None, 2.0], "of one": [5.0], "exact span": [0.1] * 256, "past a span": [0.1 * k for k in range(300)]}
    made = [(log, f"{k:04d}", k // 7 * day, k // 7 * day, p) for log, found in logs.items() for k, p in enumerate(found)]
    got: dict[str, list] = {}
    for r in grid.running_equity(spark.createDataFrame(made, "log_id string, trade_id string, entry_ns long, exit_ns long, pnl double"), 100.0).orderBy("log_id", "trade_idx").collect():
        assert r.trade_idx == len(got.setdefault(r.log_id, [])) == int(r.trade_id)
        got[r.log_id].append(r.equity)
    assert got["empty so far"] == [None, None, 101.0, 101.0, 103.0] and got["of one"] == [105.0]
    for log in ("exact span", "past a span"):
        assert got[log] == pytest.approx([100 + sum(logs[log][: k + 1]) for k in range(len(logs[log]))], rel=1e-14)
