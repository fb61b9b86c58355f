import duckdb
import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from pulsegrid.functions import units
from pulsegrid.operators import joins, labels
from pulsegrid.plans import registry
from pulsegrid.sources import codec


def test_fanout_by_blocks(spark):
    """Encounters meet arrays of devices, so the joined rows grow with the blocks and not with the devices."""
    e = spark.createDataFrame([(i, i + 100, i % 3, i * 10, None if i % 4 else i * 10 + 5) for i in range(20)], "id long, patient_id long, bed_id long, start_n long, end_n long")
    d = spark.createDataFrame([(k - 5, "static" if k % 2 else "dynamic", k % 4) for k in range(40)], "device_id long, type string, bed_id long")
    out = joins.encounter_fanout(e, d, block=4, spread=3)
    wanted = [(r["device_id"], x["patient_id"], x["id"], x["start_n"], x["end_n"]) for x in e.collect() for r in d.collect() if r["type"] == "static" and r["bed_id"] == x["bed_id"]]
    assert out.columns == ["device_id", "patient_id", "encounter_id", "start_n", "end_n"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, wanted)) and wanted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(__d") < plan.index("Join Inner")


def _views(folder, users):
    """Tables of view events, one a user, in the folder; the driver's names and types."""
    folder.mkdir()
    duckdb.sql(f"copy (select i as event_id, '2024-01-03'::timestamp + (i % 1000) * interval 1 second as ts, i as user_id, 'view' as event_type, i::double as value, '' as props from range({users}) r(i)) to '{folder}/events.parquet'")
    return str(folder)


def test_partition_totals_beyond_bigint(spark, tmp_path):
    """12 h of 400,000 users are 1.7e19 ns, 1.2e19 of them in part 0."""
    cell = 12 * 3_600_000_000_000
    small, large = _views(tmp_path / "small", 40), _views(tmp_path / "large", 400_000)
    got = {f: registry.queries()["partition_durations"](spark, f) for f in (small, large)}
    assert sorted(map(tuple, got[large].collect())) == [(k, n * cell, n) for k, n in enumerate((280_000, 80_000, 40_000))]
    assert got[small].dtypes == [("part", "int"), ("duration_ns", "bigint"), ("n_sources", "bigint")]
    assert rows_of_spark(got[small]) == rows_of_sql(connect(small), registry.oracle_sql()["partition_durations"])


def test_partition_error_beyond_bigint(spark, tmp_path):
    large = _views(tmp_path / "large", 400_000)
    assert rows_of_spark(registry.queries()["partition_error"](spark, large)) == rows_of_sql(connect(large), registry.oracle_sql()["partition_error"])


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Order lines of equal order, number, flag and day whose quantities go up and down."""
    d = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"copy (select c::bigint as c_custkey, (c % 25)::int as c_nationkey, 'X' as c_mktsegment from range(40) r(c)) to '{d}/customer.parquet'")
    duckdb.sql(f"copy (select o::bigint as o_orderkey, (o % 40)::bigint as o_custkey, 'F' as o_orderstatus, '1996-01-01'::timestamp + o * interval 1 day as o_orderdate from range(80) r(o)) to '{d}/orders.parquet'")
    duckdb.sql(f"copy (select (i % 80)::bigint as l_orderkey, 1 as l_linenumber, case when i % 2 = 0 then 'N' else 'R' end as l_returnflag, (i * 37 % 101)::double as l_quantity, '1995-01-01'::timestamp as l_shipdate from range(800) r(i)) to '{d}/lineitem.parquet'")
    return str(d)


def _same(spark, folder, name):
    assert rows_of_spark(registry.queries()[name](spark, folder)) == rows_of_sql(connect(folder), registry.oracle_sql()[name])


def test_asof_history_ties(spark, tied):
    """Of rows of equal time and id the first of the stored table counts."""
    _same(spark, tied, "asof_history")


def test_latest_history_ties(spark, tied):
    _same(spark, tied, "latest_history")


def test_latest_history_of_several_files(spark, tied, tmp_path):
    """The order of files, then of rows in them."""
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(4):
        duckdb.sql(f"copy (from '{tied}/lineitem.parquet' limit 200 offset {200 * k}) to '{tmp_path}/lineitem.parquet/part-{k}.parquet'")
    for t in ("orders", "customer"):
        duckdb.sql(f"copy (from '{tied}/{t}.parquet') to '{tmp_path}/{t}.parquet'")
    got = rows_of_spark(registry.queries()["latest_history"](spark, str(tmp_path)))
    assert got == rows_of_spark(registry.queries()["latest_history"](spark, tied))


def test_window_patient_asof_ties(spark, tied):
    _same(spark, tied, "window_patient_asof")


def test_codec_many_stretches_at_a_time():
    """Runs that cross batches stay whole, and many of them come in one table."""
    rng = np.random.default_rng(3)
    k = np.sort(rng.integers(0, 200, 1000))
    j = np.where(k % 7 == 0, 1, 0)
    table = pa.table({"k": pa.array(k, mask=k == 199), "j": pa.array(j), "v": pa.array(np.arange(1000))})
    for size in (1, 3, 64, 1000):
        out = list(codec.runs(iter(table.to_batches(max_chunksize=size)), ["k", "j"]))
        assert pa.concat_tables(t for t, _ in out).equals(table)
        firsts = [t.column("v")[int(i)].as_py() for t, starts in out for i in starts]
        assert firsts == np.unique(k, return_index=True)[1].tolist()
    assert len(out) == 2 and len(out[0][1]) == len(firsts) - 1
    assert list(codec.runs(iter([]), ["k"])) == []


def test_codec_frames_of_few_batches(spark):
    """A call to Python takes thousands of stretches; odd values and long signals come back."""
    rows = [(s, t * 5, [0.5, float("nan"), -0.0, 7.0][(s + t) % 4]) for s in range(300) for t in range(1 + s % 4)] + [(None, t * 5, float(t)) for t in range(25_000)]
    df = spark.createDataFrame(rows, "k long, time_n long, value double")
    blocks = codec.encode_frame(df, ["k"], 5, 10**9)
    assert blocks.count() == 301 and blocks.where("k is null").first()["n"] == 25_000
    assert sorted(map(str, map(tuple, codec.decode_frame(blocks, ["k"], 100).collect()))) == sorted(map(str, rows))
    assert "FlatMapGroupsInArrow" not in blocks._jdf.queryExecution().optimizedPlan().toString()


def test_raster_of_regular_grid(spark):
    """As raster() on the unfolded grid, which is neither exchanged nor held."""
    rng = np.random.default_rng(4)
    marks = [(int(d), int(s), int(s + w)) for d, s, w in zip(rng.integers(0, 6, 40), rng.integers(-30, 120, 40), rng.integers(-3, 25, 40), strict=True)]
    sources = spark.createDataFrame([(d,) for d in range(8)], "device_id long")
    lab = spark.createDataFrame([*marks, (7, -50, 500)], "device_id long, start_n long, end_n long")
    for start, end, period in ((0, 100, 7), (3, 3 + 70, 10)):
        grid = [(d, t) for d in range(8) for t in range(start, end, period)]
        wanted = sorted((d, t, int(any(x == d and s <= t <= e for x, s, e in [*marks, (7, -50, 500)]))) for d, t in grid)
        out = labels.raster_of(sources, lab, ["device_id"], start, end, period)
        assert sorted(map(tuple, out.collect())) == wanted and out.dtypes[-1] == ("on", "int")
        one = spark.createDataFrame(grid, "device_id long, time_n long")
        assert sorted(map(tuple, labels.raster(one, lab, ["device_id"], 13).collect())) == wanted
    plan = registry.queries()["label_raster"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Join") and plan.count("posexplode") == 1


def test_threshold_of_regular_grid(spark):
    """As threshold() of the raster, the last window shorter; nothing is grouped after the grid is laid out."""
    sources = spark.createDataFrame([(d,) for d in range(5)], "device_id long")
    lab = spark.createDataFrame([(1, 0, 25), (1, 61, 70), (2, 30, 30), (4, -5, 500)], "device_id long, start_n long, end_n long")
    win = units.floor_div(F.col("time_n") - 5, 30)
    wanted = labels.threshold(labels.raster_of(sources, lab, ["device_id"], 5, 105, 10).withColumn("win", win), ["device_id", "win"], 0.3)
    out = labels.threshold_of(sources, lab, ["device_id"], 5, 105, 10, 3, 0.3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, wanted.collect())) and out.count() == 20
    assert out.dtypes == wanted.dtypes
    plan = registry.queries()["label_threshold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Aggregate")
