import os

import pytest
from oracle import connect, rows_of_spark, rows_of_sql

from pulsegrid.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert rows_of_spark(registry.queries()[name](spark, DATA)) == rows_of_sql(con, registry.oracle_sql()[name])


def test_nested_windows(spark):
    rows = registry.queries()["window_signals"](spark, DATA).limit(20).collect()
    for r in rows:
        for s in r["signals"]:
            assert len(s["values"]) == s["expected_count"]
            assert sum(v == v for v in s["values"]) == s["actual_count"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(entry.queries())


def test_whole_tables(spark):
    events, orders = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("events", "orders"))
    grid = registry.queries()["nan_fill_grid"](spark, DATA)
    assert grid.count() == 7 * 24 * events.select("event_type", "user_id").distinct().count()
    used = {r["l_orderkey"] for r in spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_quantity > 45").collect()}
    assert {r["o_orderkey"] for r in registry.queries()["vacuum_anti"](spark, DATA).collect()} == {r["o_orderkey"] for r in orders.collect()} - used
