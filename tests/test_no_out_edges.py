"""Queries whose messages divide by the out-degree, where some customers have no out-edge."""

import pytest

from sparkgas.registry.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Customers 1 and 2 order in turn, 3 orders last of all, and 4 never."""
    path = str(tmp_path_factory.mktemp("orders"))
    customers = [(i, 0.0, "BUILDING") for i in (1, 2, 3, 4)]
    spark.createDataFrame(customers, "c_custkey bigint, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    orders = [(k, c, 15000.0) for k, c in enumerate((1, 2, 1, 2, 3))]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return path


def test_iterate_fixed(spark, tables):
    got = {r.id: r.rank for r in QUERIES["iterate_fixed"](spark, tables).collect()}
    one, two, three = 1.0, 1.0, 1.0
    for _ in range(5):  # edges 1-2 twice, 2-1 once, 2-3 once
        one, two, three = 0.15 + 0.85 * two / 2, 0.15 + 0.85 * one, 0.15 + 0.85 * two / 2
    assert got == pytest.approx({1: one, 2: two, 3: three, 4: 0.15}, abs=1e-6)


def test_superstep(spark, tables):
    got = {r.id: (r.rank, r.active) for r in QUERIES["superstep"](spark, tables).collect()}
    assert got == {1: (0.575, False), 2: (1.0, False), 3: (0.575, False), 4: (0.15, False)}
