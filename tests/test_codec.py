import numpy as np
import pytest

from pulsegrid.functions import gaps, messages
from pulsegrid.sources import codec

KEY = ["k"]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    cases = [
        (np.arange(100) * 10, np.cumsum(rng.integers(-3, 4, 100))),
        (np.arange(50) * 10 + (np.arange(50) > 20) * 7, rng.normal(size=50)),
        (np.sort(rng.integers(0, 10**15, 30)), rng.integers(-(2**40), 2**40, 30)),
        (np.array([5]), np.array([-0.0])),
        (np.array([5, 15, 25]), np.array([np.nan, 1.0, np.inf])),
    ]
    data = b"".join(codec.encode(t, v, 10) for t, v in cases)
    found = codec.headers(data)
    assert [h["n"] for h in found] == [len(t) for t, _ in cases] and sum(h["size"] for h in found) == len(data)
    for h, (t, v) in zip(found, cases, strict=True):
        times, values = codec.decode(data, h["at"])
        assert (times == t).all() and np.array_equal(values, v.astype(float), equal_nan=True) and h["size"] <= codec.buffer_bound(len(t))
    assert found[0]["time_kind"] == codec.GAPS and found[2]["time_kind"] == codec.TIMES and found[0]["end_n"] == 1000
    many = codec.encode_many(np.arange(95), np.arange(95), 1, 20)
    assert [h["n"] for h in codec.headers(many)] == [20, 20, 20, 20, 15] and (codec.decode_all(many)[1] == np.arange(95)).all()
    assert [h["n"] for h in codec.headers(codec.encode_many(np.arange(45), np.arange(45), 1, 20))] == [20, 25]
    with pytest.raises(ValueError):
        codec.header(b"x" * 200)
    with pytest.raises(ValueError):
        codec.encode([], [], 1)


def test_differences():
    rng = np.random.default_rng(2)
    for order in range(6):
        x = rng.integers(-1000, 1000, 40)
        assert (codec.undelta(codec.delta(x, order), order) == x).all()
    assert codec.best_order(np.arange(50) ** 2) == 3 or codec.best_order(np.arange(50) ** 2) == 2
    assert codec.best_order(np.full(9, 4)) == 0
    assert [codec.width(np.array([v])) for v in (127, -129, 40_000, 2**40)] == [1, 2, 4, 8]
    assert (codec.widen(codec.narrow(np.array([-5, 300]))[1], 2) == [-5, 300]).all()
    assert codec.entropy(np.array([1, 1, 2, 2])) == 1.0


def test_frames(spark):
    rows = [(k, t * 7, float(t % 5)) for k in (1, 2) for t in range(60)]
    df = spark.createDataFrame(rows, "k long, time_n long, value double")
    blocks = codec.encode_frame(df, KEY, 7, 100)
    assert blocks.count() == 10
    assert sorted(map(tuple, codec.decode_frame(blocks, KEY).collect())) == rows
    reads = spark.createDataFrame([("f", 0, 10), ("f", 10, 5), ("f", 20, 5), ("g", 15, 5)], "k string, at long, size long")
    assert sorted(map(tuple, codec.coalesce_reads(reads, KEY).collect())) == [("f", 0, 15), ("f", 20, 5), ("g", 15, 5)]


def test_messages(spark):
    from pyspark.sql import functions as F

    p = F.lit(10)
    m = spark.createDataFrame([(1, 0, 3), (1, 30, 2), (1, 100, 4)], "k long, start_n long, n long")
    assert [tuple(r) for r in messages.variable_gaps(m, KEY, p).collect()] == [(1, 5, 50)]
    starts = spark.createDataFrame([(1, 0, 9)], "k long, start_n long, n long")
    g = messages.variable_gaps(m, KEY, p)
    assert sorted(tuple(r) for r in messages.from_gaps(starts, g, KEY, p).collect()) == [(1, 0, 5), (1, 100, 4)]
    assert sorted(tuple(r) for r in messages.contiguous(m, KEY, p).collect()) == [(1, 0, 5), (1, 100, 4)]
    assert sorted(tuple(r) for r in messages.to_intervals(m, KEY, p).collect()) == [(1, 0, 50), (1, 100, 140)]
    assert sorted(tuple(r) for r in messages.to_intervals(m, KEY, p, 50).collect()) == [(1, 0, 140)]
    spans = spark.createDataFrame([(1, 0, 90), (1, 10, 20), (1, 95, 99)], "k long, start_n long, end_n long")
    assert [tuple(r) for r in messages.close_gaps(spans, KEY, 5).collect()] == [(1, 0, 99)]
    assert sorted(tuple(r) for r in messages.split_at(m, KEY, p, 4).collect()) == [(1, 0, 0, 3), (1, 0, 30, 1), (1, 1, 40, 1), (1, 1, 100, 3), (1, 2, 130, 1)]
    assert sorted(tuple(r) for r in messages.block_starts(starts, g, KEY, p, 4).collect()) == [(1, 0, 0, 0), (1, 1, 40, 0), (1, 2, 130, 50)]
    in_samples = spark.createDataFrame([(1, 5, 5)], "k long, idx long, gap_samples long")
    times = sorted(r["time_n"] for r in messages.decode_in_samples(starts, in_samples, KEY, p).collect())
    assert times == [0, 10, 20, 30, 40, 100, 110, 120, 130]
    v = spark.createDataFrame([(1, 0, 50, [5.0, 6.0]), (1, 1, 0, [1.0])], "k long, pos long, start_n long, values array<double>")
    assert [tuple(r) for r in messages.sort_values(v, KEY).orderBy("no").collect()] == [(1, 0, 0, 1, [1.0]), (1, 1, 50, 2, [5.0, 6.0])]
    s = lambda *x: spark.createDataFrame([(1, t, float(y)) for t, y in x], "k long, time_n long, value double")
    old, new = s((0, 1), (10, 2), (40, 3)), s((10, 9), (20, 8))
    merged, gap = messages.merge_gap_data(old, new, KEY, p)
    assert sorted((r["time_n"], r["value"]) for r in merged.collect()) == [(0, 1), (10, 9), (20, 8), (40, 3)] and [tuple(r) for r in gap.collect()] == [(1, 3, 10)]
    assert sorted(r["value"] for r in messages.merge_samples(old, new, KEY, "old").collect()) == [1, 2, 3, 8]
    a, b = m.where("start_n = 0"), m.where("start_n = 100")
    none = spark.createDataFrame([], "k long, idx long, gap_ns long")
    both, gap = messages.concatenate(a, none, b, none, KEY, p)
    assert tuple(both.first()) == (1, 0, 7) and [tuple(r) for r in gap.collect()] == [(1, 3, 70)]
    w = lambda t, *x: spark.createDataFrame([(1, t, list(map(float, x)))], "k long, start_n long, values array<double>")
    assert sorted((r["time_n"], r["value"]) for r in messages.merge_messages(w(0, 1, 2), w(11, 5), KEY, p, 4).collect()) == [(0, 1), (11, 5)]
    assert sorted(r["time_n"] for r in messages.merge_messages(w(0, 1, 2), w(11, 5), KEY, p).collect()) == [0, 10, 11]
    assert [(r["start_n"], r["values"]) for r in messages.interleave(w(0, 1, 2), w(5, 3), KEY, p).collect()] == [(0, [1]), (5, [3]), (10, [2])]
    for kind, rows in (("times", s((0, 1), (10, 1), (50, 1))), ("messages", spark.createDataFrame([(1, 0, 2), (1, 50, 1)], "k long, start_n long, n long")), ("runs", spark.createDataFrame([(1, 0, 20), (1, 50, 60)], "k long, start_n long, end_n long"))):
        assert sorted(tuple(r) for r in messages.written_intervals(rows, KEY, p, kind).collect()) == [(1, 0, 20), (1, 50, 60)]
    assert gaps.end_time(starts, g, KEY, p).first()["end_n"] == 140
