import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import gaps, units, values
from pulsegrid.operators import labels, scan, windows
from pulsegrid.plans import splits
from pulsegrid.plans.definition import Definition, resolve
from pulsegrid.sources import files
from pulsegrid.sources.dataset import Dataset
from pulsegrid.streaming import ingest

S = 1_000_000_000
SAMPLES = "measure_id long, device_id long, time_n long, value double, write_seq long"


def samples(spark, pairs, device=1):
    return spark.createDataFrame([(1, device, t, float(v), i) for i, (t, v) in enumerate(pairs)], SAMPLES)


def test_fill(spark):
    df = samples(spark, zip([1 * S, 3 * S, 4 * S, 5 * S, 8 * S, 9 * S], range(1, 7), strict=True))
    rows = scan.fill(df, ["device_id"], 1 * S, 10 * S, S).orderBy("slot").collect()
    assert [r["value"] for r in rows] == [1, None, 2, 3, 4, None, None, 5, 6]


def test_gap_arrays(spark):
    period = 2 * S
    starts = spark.createDataFrame([(1, 420 * S, 100)], "k long, start_n long, n long")
    g = spark.createDataFrame([(1, 3, 40 * S), (1, 12, 100 * S), (1, 98, 20 * S)], "k long, idx long, gap_ns long")
    runs = gaps.to_intervals(starts, g, ["k"], F.lit(period)).orderBy("start_n").collect()
    assert [r["n"] for r in runs] == [3, 9, 86, 2]
    times = gaps.decode(starts, g, ["k"], F.lit(period))
    assert times.count() == 100
    back = {(r["idx"], r["gap_ns"]) for r in gaps.encode(times, ["k"], F.lit(period)).collect()}
    assert back == {(3, 40 * S), (12, 100 * S), (98, 20 * S)}
    again = gaps.from_intervals(gaps.to_intervals(starts, g, ["k"], F.lit(period)), ["k"], F.lit(period))
    assert {(r["idx"], r["gap_ns"]) for r in again.collect()} == back
    assert gaps.end_time(starts, g, ["k"], F.lit(period)).first()["end_n"] == 420 * S + 100 * period + 160 * S
    assert gaps.is_ordered(g, period)


def test_units(spark):
    row = spark.range(1).select(units.to_ns(F.lit(1.5), "us").alias("a"), units.floor_div(F.lit(-7), 2).alias("b"), units.ceil_div(F.lit(-7), 2).alias("c"), units.period_of(F.lit(500 * 10**9)).alias("d"), units.floor_div(F.lit(1_704_380_769_439_823_999), 1000).alias("e")).first()
    assert tuple(row) == (1500, -4, -3, 2_000_000, 1_704_380_769_439_823)
    with pytest.raises(ValueError):
        units.scalar_ns(1, "weeks")


def test_values(spark):
    row = spark.range(1).select(values.analog(F.lit(4), F.lit(0.0), F.lit(1.0)).alias("a"), values.bytes_per_value(F.lit(-129), F.lit(3)).alias("b")).first()
    assert tuple(row) == (5.0, 2)
    signal = values.indices_to_binary(5, spark.createDataFrame([(1,), (3,)], "idx long"))
    assert [r["signal"] for r in signal.orderBy("idx").collect()] == [0, 1, 0, 1, 0]
    assert {r["idx"] for r in values.binary_to_indices(signal).collect()} == {1, 3}


def test_detect_period(spark):
    df = samples(spark, [(t, 0) for t in (0, 2, 4, 7, 9, 20)])
    assert gaps.detect_period(df, ["device_id"]).first()["period_ns"] == 2
    assert gaps.detect_period(df.limit(1), ["device_id"]).first()["period_ns"] == S


def test_row_windows(spark):
    df = samples(spark, [(t, t) for t in range(7)])
    full = scan.row_windows(df, ["device_id"], 3, 2, keep_last=False).orderBy("window_no").collect()
    assert [r["values"] for r in full] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]


def test_threshold_is_strict(spark):
    grid = spark.createDataFrame([(1, 0), (1, 10)], "device_id long, time_n long")
    marks = spark.createDataFrame([(1, 10, 20)], "device_id long, start_n long, end_n long")
    r = labels.raster(grid, marks, ["device_id"])
    assert labels.threshold(r, ["device_id"], 0.5).first()["label"] == 0
    assert labels.threshold(r, ["device_id"], 0.4).first()["label"] == 1


def test_windows(spark):
    ranges = spark.createDataFrame([(1, 0, 10)], "device_id long, start_n long, end_n long")
    w = windows.enumerate_windows(ranges, 4, 3)
    assert [r["window_start_n"] for r in w.orderBy("window_no").collect()] == [0, 3, 6, 9]
    assert [r["window_start_n"] for r in windows.enumerate_windows(ranges, 4, 3, full_only=True).orderBy("window_no").collect()] == [0, 3, 6]
    m = windows.matrix(w, samples(spark, [(0, 1), (4, 2), (9, 3)]), ["device_id"], 4, 1).orderBy("window_start_n").collect()
    assert [r["actual_count"] for r in m] == [1, 1, 1, 1]
    assert m[0]["values"][0] == 1 and math.isnan(m[0]["values"][1])
    index = windows.light_index(ranges, ["device_id"], 4, 3)
    assert windows.window_at(index, -1, 4, 3).first()["window_start_n"] == 9


def test_dataset(spark, tmp_path):
    d = Dataset(spark, f"file://{tmp_path}/set").create()
    m = d.insert_measure("ecg", period_ns=S, unit="mV")
    assert d.insert_measure("ecg", period_ns=S, unit="mV") == m
    dev = d.insert_device("bed-1")
    d.write_pairs(m, dev, list(range(1, 9)), [t * t for t in range(1, 9)], "s")
    d.write_pairs(m, dev, [3, 4, 5], [8, 9, 10], "s", on_conflict="last")
    rows = {r["time_n"] // S: r["value"] for r in d.read(measure_id=m, start_n=2 * S, end_n=7 * S, device_id=dev).collect()}
    assert rows == {2: 4, 3: 8, 4: 9, 5: 10, 6: 36}
    d.write_pairs(m, dev, [3], [0], "s", on_conflict="first")
    assert d.read(measure_id=m, start_n=3 * S, end_n=4 * S).first()["value"] == 8
    with pytest.raises(ValueError):
        d.write_pairs(m, dev, [3], [0], "s", on_conflict="error")
    d.compact()
    assert [(r["start_n"], r["end_n"]) for r in d.rebuild_intervals().collect()] == [(S, 9 * S)]
    p = d.insert_patient("17")
    d.insert_history(p, "height", 188, 10)
    d.insert_history(p, "height", 189, 20)
    assert d.patient_info(p, 15)["height"] == 188 and d.patient_info(p)["height"] == 189 and d.patient_info(99) == {}
    label = d.insert_label("Running", dev, 0, 5, source="nurse")
    assert d.table("labels").count() == 1
    with pytest.raises(ValueError):
        d.delete_labels([])
    d.delete_labels([label])
    assert d.table("labels").count() == 0
    assert d.find("devices", {"tag": "bed"}, type="static").count() == 1
    assert d.unreferenced("label_sets", "label_set_id", "labels").count() == 1
    seg = spark.createDataFrame([(m, 2, 0, S, [1.0, 2.0, 3.0])], "measure_id long, device_id long, start_n long, period_ns long, values array<double>")
    d.write_segments(seg)
    assert d.read(device_id=2).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = samples(spark, [(t * S, t) for t in (1, 2, 2, 3)])
    rows.drop("write_seq").write.parquet(f"{tmp_path}/in")
    d = Dataset(spark, f"file://{tmp_path}/set").create()
    stream = spark.readStream.schema("measure_id long, device_id long, time_n long, value double").parquet(f"{tmp_path}/in")
    ingest.ingest(stream, d, f"{tmp_path}/ck").awaitTermination(60)
    assert d.table("samples").count() == 3


def test_export_import(spark, tmp_path):
    df = samples(spark, [(1 * S, 1), (2 * S, 2)])
    files.export(df, f"{tmp_path}/out", "csv", time="s")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("time,value\n1,5\n2,6\n")
    (tmp_path / "in" / "b.csv").write_text("time,value\n1,7\n")
    (tmp_path / "side.json").write_text('{"a": {"measure_id": 1, "device_id": 9}}')
    side = files.read_sidecar(spark, f"{tmp_path}/side.json")
    got = files.import_folder(spark, f"{tmp_path}/in", side, "csv", "s").orderBy("time_n").collect()
    assert [(r["device_id"], r["time_n"], r["value"]) for r in got] == [(9, S, 5.0), (9, 2 * S, 6.0)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2


def test_deidentified(spark):
    p = spark.createDataFrame([(i, str(i), 100 * i) for i in range(20)], "patient_id long, mrn string, dob long")
    rows = files.deidentified(p, ["dob"], seed=3, shift_ns=-5).collect()
    assert sorted(r["new_patient_id"] for r in rows) == list(range(1, 21))
    assert all(r["dob"] == 100 * r["patient_id"] - 5 for r in rows)


@pytest.mark.parametrize(
    "doc",
    [
        {"patient_id": {1: "all"}},
        {"patient_ids": {"x": "all"}},
        {"device_ids": {"y": "all"}},
        {"device_ids": {1: [{"en": 5}]}},
        {"device_ids": {1: [{"start": 5, "end": 5}]}},
        {"device_ids": {1: [{"time0": 5, "pre": -1}]}},
        {"device_ids": {1: [{"pre": 1, "post": 2}]}},
        {"device_ids": {1: {"start": 1}}},
        {"measures": ["a", "a"]},
    ],
)
def test_definition_errors(doc):
    with pytest.raises(ValueError):
        Definition.from_dict(doc)


def test_definition(spark, tmp_path):
    d = Definition.from_dict({"measures": ["a"], "device_ids": {1: "all", 2: [{"time0": 10, "pre": 2, "post": 3}]}})
    e = d.combine(Definition().add_region("device_ids", 2).add_measure("b"))
    assert e.device_ids[2] == "all" and e.measures == ["a", "b"] and d.key() != e.key()
    cover = spark.createDataFrame([(1, 0, 5), (2, 0, 11)], "device_id long, start_n long, end_n long")
    rows = {(r["device_id"], r["start_n"], r["end_n"]) for r in resolve(d.specs(spark, "device_ids"), cover, "device_id", 0, 12).collect()}
    assert rows == {(1, 0, 5), (2, 8, 12)}
    with pytest.raises(ValueError):
        e.add_label("x").add_label("x")
    e.save(str(tmp_path / "d.yaml"))


def test_splits(spark):
    items = [(i, (1.0 + i % 3, float(i % 2))) for i in range(60)]
    parts, error = splits.partition(items, [0.7, 0.2, 0.1])
    assert len(parts) == 60 and error < 0.05
    assert len(list(splits.fold_combinations(5))) == splits.n_combinations(5) == 20
    with pytest.raises(ValueError):
        splits.stratify(items, [1, 0])
    s = spark.range(100).withColumnRenamed("id", "k")
    assert splits.hash_split(s, "k", [7, 2, 1]).where("part is null").count() == 0
