"""Splits of more blocks than a thousand against their SQL twins."""

import duckdb
import pandas as pd
import pytest

from stradale.plans import ORACLE, QUERIES

from .test_queries import normal

NAMES = ["hold_out_blocks", "split_adjacency", "split_digest", "buffered_drop", "split_leakage"]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """1,500 blocks of one to three chips, some within 500 m of the next block's."""
    at = tmp_path_factory.mktemp("wide")
    keys = [40 * j + d for j in range(500) for d in (0, 3, 4, 7, 8, 20)]
    pd.DataFrame({"s_suppkey": keys}).to_parquet(at / "supplier.parquet")
    pd.DataFrame({"o_orderkey": range(900), "o_orderpriority": [f"p{i % 5}" for i in range(900)]}).to_parquet(at / "orders.parquet")
    lines = [(k // 20 if i % 2 else i % 900, k, i % 50 + 1) for i, k in enumerate(keys)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_suppkey", "l_quantity"]).to_parquet(at / "lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_beyond_a_thousand_blocks(spark, wide, name):
    c = duckdb.connect()
    for t in ("supplier", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{wide}/{t}.parquet'")
    a, b = normal(QUERIES[name](spark, wide).toPandas()), normal(c.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=1e-8)


def test_lines_and_orders_are_not_sent_to_the_driver(spark, wide):
    from stradale.plans import views

    assert "Broadcast" not in views.way_nodes(spark, wide)._jdf.queryExecution().executedPlan().toString()


#: Null keys, in the last block and in a held-out one of their own, and keys below zero.
ODD = {
    "null": [*range(0, 4000, 3), *[None] * 5],
    "null_held": [0, 4, 8, 40, 44, 48, 80, 84, 88, None, None, None],
    "below_zero": list(range(-2007, 2000, 3)),
}


@pytest.mark.parametrize("kind", ODD)
@pytest.mark.parametrize("name", ["split_adjacency", "split_digest", "buffered_drop"])
def test_odd_keys(spark, tmp_path, name, kind):
    pd.DataFrame({"s_suppkey": pd.array(ODD[kind], "Int64")}).to_parquet(tmp_path / "supplier.parquet")
    c = duckdb.connect()
    c.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet'")
    a, b = normal(QUERIES[name](spark, str(tmp_path)).toPandas()), normal(c.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(a.fillna("-"), b.fillna("-"), check_dtype=False, atol=1e-8)
