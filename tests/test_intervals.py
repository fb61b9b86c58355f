import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import intervals as iv
from pulsegrid.operators import joins

SCHEMA = "k long, start_n long, end_n long"
spans = st.lists(st.tuples(st.integers(0, 40), st.integers(1, 8)).map(lambda x: (1, x[0], x[0] + x[1])), max_size=8)
relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def points(rows):
    return {t for _, s, e in rows for t in range(s, e)}


def got(df):
    return sorted((r["k"], r["start_n"], r["end_n"]) for r in df.collect())


def test_coverage_islands(spark):
    for period, times, expected in (
        (1, [0, 1, 2, 3, 4, 7, 8, 10, 12, 13, 14], [(0, 5), (7, 9), (10, 11), (12, 15)]),
        (2, [0, 2, 4, 7, 8, 15], [(0, 6), (7, 10), (15, 17)]),
        (1, [0, 0, 1, 1, 2, 3], [(0, 4)]),
    ):
        df = spark.createDataFrame([(1, t) for t in times], "k long, time_n long")
        assert got(iv.from_samples(df, ["k"], period)) == [(1, *x) for x in expected]
        assert got(iv.from_samples(df, ["k"], period, chunk_ns=3)) == [(1, *x) for x in expected]


def test_difference_fixture(spark):
    a = spark.createDataFrame([(1, 0, 2), (1, 3, 8), (1, 10, 20)], SCHEMA)
    b = spark.createDataFrame([(1, 2, 5), (1, 6, 12), (1, 20, 22)], SCHEMA)
    assert got(iv.difference(a, b, ["k"])) == [(1, 0, 2), (1, 5, 6), (1, 12, 20)]


@relaxed
@given(a=spans, b=spans)
def test_laws(spark, a, b):
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    both, meet, rest = got(iv.union_all([x, y], ["k"])), got(iv.intersection([x, y], ["k"])), got(iv.difference(x, y, ["k"]))
    assert points(both) == points(a) | points(b)
    assert points(meet) == points(a) & points(b)
    assert points(rest) == points(a) - points(b)
    for rows in (both, meet, rest):  # sorted, apart
        assert all(p[2] < q[1] for p, q in zip(rows, rows[1:], strict=False))


@relaxed
@given(a=spans, b=spans, width=st.integers(1, 20))
def test_interval_join_buckets(spark, a, b, width):
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    rows = sorted((r["start_n"], r["end_n"], r["b_start_n"], r["b_end_n"]) for r in joins.interval_join(x, y, ["k"], width).collect())
    assert rows == sorted((p[1], p[2], q[1], q[2]) for p in a for q in b if p[1] < q[2] and q[1] < p[2])


def test_split_shift_gaps_contains(spark):
    df = spark.createDataFrame([(1, 0, 7), (1, 10, 12)], SCHEMA)
    assert got(iv.split(df, 3)) == [(1, 0, 3), (1, 3, 6), (1, 6, 7), (1, 10, 12)]
    assert got(iv.merge_touching(iv.split(df, 3), ["k"])) == [(1, 0, 7), (1, 10, 12)]
    assert got(iv.shift(df, 5)) == [(1, 5, 12), (1, 15, 17)]
    assert got(iv.gaps(df, ["k"])) == [(1, 7, 10)]
    assert iv.contains(df, 7, ["k"]).first()["contains"] is False
    assert iv.contains(df, 6, ["k"]).first()["contains"] is True
    assert iv.duration(df, ["k"]).first()["duration_ns"] == 9


def test_nested_intervals_keep_the_larger_end(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 4), (1, 11, 12)], SCHEMA)
    assert got(iv.union(df, ["k"], 1)) == [(1, 0, 12)]


def test_strategy_errors(spark):
    with pytest.raises(ValueError):
        iv.by_strategy([spark.createDataFrame([], SCHEMA)], ["k"], "xor")


def test_convert_source(spark):
    m = spark.createDataFrame([(1, 10, 0, 5), (1, 10, 5, 10), (1, 11, 10, None), (2, 12, 0, 9)], "device_id long, patient_id long, start_n long, end_n long")
    q = spark.createDataFrame([(1, 1, 9), (1, 9, 11), (2, 0, 10), (3, 0, 1)], "device_id long, q_start long, q_end long")

    def run(policy):
        return {(r["device_id"], r["q_start"]): r["patient_id"] for r in joins.convert_source(m, "device_id", "patient_id", q, policy, 100).collect()}

    assert run("always_none") == {(1, 1): 10, (1, 9): None, (2, 0): None, (3, 0): None}
    assert run("90_percent_overlap") == {(1, 1): 10, (1, 9): None, (2, 0): 12, (3, 0): None}
    with pytest.raises(ValueError):
        run("nearest")


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 5, 1.0, 1), (1, 5, 2.0, 2), (1, 11, 9.0, 3)], "k long, at long, v double, id long")
    out = {(r["k"], r["t"]): r["v"] for r in joins.as_of(left, right, ["k"], "t", "at", ["v"], ["id"]).collect()}
    assert out == {(1, 5): 2.0, (1, 10): 2.0, (2, 1): None}


def test_label_forest(spark):
    sets = spark.createDataFrame([(1, "Animals", None), (2, "Dogs", 1), (3, "Poodle", 2), (4, "Plants", None)], "label_set_id long, name string, parent_id long")
    down = {(r["root_id"], r["label_set_id"], r["depth"]) for r in joins.descendants(sets).collect()}
    assert down == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (4, 4, 0)}
    roots = {r["label_set_id"]: r["requested_id"] for r in joins.requested_roots(sets, sets.where(F.col("label_set_id").isin(1, 2))).collect()}
    assert roots == {1: 1, 2: 2, 3: 2}
