import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import iterator, splits


def test_windows(spark):
    ranges = spark.createDataFrame([(1, 7, 0, 40), (1, 7, 45, 60), (2, 8, 0, 20)], "device_id long, patient_id long, start_n long, end_n long")
    samples = spark.createDataFrame([(m, 1, t, float(t + m)) for m, step in ((1, 10), (2, 5)) for t in range(0, 60, step) if t != 20], "measure_id long, device_id long, time_n long, value double")
    measures = spark.createDataFrame([(1, "a", 10, "u"), (2, "b", 5, "v")], "measure_id long, tag string, period_ns long, unit string")
    labels = spark.createDataFrame([(5, 1, 0, 15), (6, 1, 0, 2)], "label_set_id long, device_id long, start_n long, end_n long")
    history = spark.createDataFrame([(1, 7, "w", 3.0, -5), (2, 7, "w", 4.0, 20)], "id long, patient_id long, field string, value double, time_n long")
    how = dict(gap_tolerance_ns=5, labels=labels, label_period_ns=5, history=history, fields=("w",))
    rows = {(r["device_id"], r["window_start_n"]): r for r in iterator.windows_of(ranges, samples, measures, 20, 20, **how).collect()}
    assert sorted(rows) == [(1, 0), (1, 20), (1, 40), (2, 0)]
    a, b = rows[1, 0]["signals"]
    assert (a["tag"], a["expected_count"], a["actual_count"], a["values"]) == ("a", 2, 2, [1.0, 11.0]) and b["values"] == [2.0, 7.0, 12.0, 17.0]
    assert rows[1, 20]["signals"][0]["actual_count"] == 1 and rows[2, 0]["signals"][1]["actual_count"] == 0
    assert rows[1, 0]["labels"] == {5: 1, 6: 0} and rows[1, 40]["labels"] == {}
    assert rows[1, 0]["w"] == 3.0 and rows[1, 20]["w"] == 4.0 and rows[2, 0]["w"] is None
    full = iterator.windows_of(ranges, samples, measures, 20, 20, full_only=True, keep=F.col("device_id") == 1, seed=3)
    order = [r["window_start_n"] for r in full.collect()]
    assert sorted(order) == [0, 20] and order == [r["window_start_n"] for r in full.collect()]
    parts = list(iterator.batches(full, 1))
    assert [p.num_rows for p in parts] == [1, 1] and len(parts[0].column("signals")[0].as_py()) == 2
    assert list(iterator.batches(full, 5, lambda p: p.num_rows)) == [2]


def test_partitions_of_a_definition(spark):
    ranges = spark.createDataFrame([(k, k, 0, 10 * (k + 1)) for k in range(9)], "device_id long, patient_id long, start_n long, end_n long")
    parts = splits.hash_split(ranges.select("device_id"), "device_id", [2, 1])
    dealt = iterator.parts_to_ranges(ranges, parts, "device_id")
    assert sum(d.count() for d in dealt.values()) == 9 and all(d.columns == ["device_id", "patient_id", "start_n", "end_n"] for d in dealt.values())
    labels = spark.createDataFrame([(k, 3, 5, 100) for k in range(9)], "device_id long, label_set_id long, start_n long, end_n long")
    report = iterator.part_report(ranges, parts, "device_id", labels).collect()
    assert sum(r["n_sources"] for r in report) == 9 and sum(r["duration_ns"] for r in report) == 450 and sum(r["label_ns"][3] for r in report) == 405
    sets = spark.createDataFrame([(3, "x")], "label_set_id long, name string")
    assert iterator.label_priorities(["x", 4], sets, [3, 4]) == [3, 4]
    with pytest.raises(ValueError):
        iterator.label_priorities(["y"], sets, [3])
    both = iterator.combine_validated(ranges.where("device_id = 0"), ranges.where("device_id = 0").withColumn("start_n", F.lit(5).cast("long")).withColumn("end_n", F.lit(30).cast("long")))
    assert [tuple(r) for r in both.collect()] == [(0, 0, 0, 30)]
