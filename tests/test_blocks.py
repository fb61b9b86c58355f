from pulsegrid.operators import aggregates
from pulsegrid.sources import blocks


def test_blocks(spark):
    rows = [(1, t, float(t)) for t in (*range(0, 70, 10), 95, 1000, 1010)]
    df = spark.createDataFrame(rows, "k long, time_n long, value double")
    b = blocks.time_deltas(blocks.encode(df, ["k"], 3, chunk_ns=500))
    got = [(r["chunk"], r["block"], r["num_vals"], r["regular"]) for r in b.orderBy("start_n").collect()]
    assert got == [(0, 0, 3, True), (0, 1, 5, False), (2, 0, 2, True)]
    assert sorted(tuple(r) for r in blocks.decode(b, ["k"]).collect()) == rows
    groups = blocks.header_groups(b, ["k"], ["regular"]).orderBy("start_n").collect()
    assert [(r["regular"], r["n_blocks"]) for r in groups] == [(True, 1), (False, 1), (True, 1)]


def test_entropy(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 1.0, 2.0, 2.0)], "k long, value double")
    row = aggregates.entropy(df, ["k"]).first()
    assert (row["entropy"], row["n_distinct"]) == (1.0, 2)
