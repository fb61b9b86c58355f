import pytest

from pulsegrid.sources.dataset import Dataset


@pytest.fixture
def ds(spark, tmp_path):
    return Dataset(spark, f"file://{tmp_path}/d").create()


def test_look_ups(ds):
    i = ds.insert_institution("I")
    u = ds.insert_unit(i, "U", "icu")
    b = ds.insert_bed(u, "7")
    s = ds.insert_source("monitor", "bedside")
    m = ds.insert_measure("ecg", period_ns=2)
    d = ds.insert_device("dev", bed_id=b)
    assert ds.bed_info(b) == {"bed_id": b, "unit_id": u, "name": "7", "unit": "U", "institution": "I"} and ds.bed_info(99) == {}
    assert ds.bed_id("7") == b == ds.bed_id("7", u) and ds.bed_id("8") is None
    assert ds.source_id("monitor") == s and ds.source_info(s)["description"] == "bedside"
    assert ds.measure_info(m)["tag"] == "ecg" and ds.device_info(d)["bed"] == "7"
    assert ds.measure_ids("ecg") == [m] == ds.measure_ids(m) == ds.measure_ids({"tag": "ecg"}, "best") == ds.measure_ids(("ecg", None, None)) and ds.measure_ids("x") == []
    assert [r["measure_id"] for r in ds.measures().collect()] == [m] and ds.devices().count() == 1
    assert ds.rows_in("measures", [m, 50]).count() == 1 and ds.rows_in("measures", []).count() == 0
    ds.set_setting("a", 1)
    ds.set_setting("a", 2)
    assert ds.settings() == {"a": "2"}


def test_patients_and_encounters(ds):
    b = ds.insert_bed(1, "b")
    d = ds.insert_device("static", bed_id=b)
    ds.insert_device("moving", bed_id=b, type="dynamic")
    p, q = ds.insert_patient("11"), ds.insert_patient("12")
    assert ds.patient_id(12) == q and ds.mrn(p) == "11" and ds.mrn(99) is None
    assert {r["mrn"]: r["patient_id"] for r in ds.mrn_to_patient([11, 13]).collect()} == {"11": p}
    assert {r["patient_id"]: r["mrn"] for r in ds.patient_to_mrn().collect()} == {p: "11", q: "12"}
    assert ds.patients(1, 1).collect()[0]["patient_id"] == q and ds.patients_in([p], [12]).count() == 2
    for t, v in ((5, 1.0), (9, 2.0)):
        ds.insert_history(p, "weight", v, t)
    ds.insert_history(p, "height", 3.0, 7)
    assert ds.history_fields() == ["height", "weight"]
    assert [r["value"] for r in ds.history(p, "weight", 5, 8).collect()] == [1.0] and ds.history(p).count() == 3
    e = ds.insert_encounter(p, b, 100)
    assert ds.insert_encounter(p, b, 100) == e
    other = ds.insert_encounter(q, b, 500, 600)
    rows = lambda: sorted((r["device_id"], r["patient_id"], r["start_n"], r["end_n"]) for r in ds.table("device_patient").collect())
    assert rows() == [(d, p, 100, None), (d, q, 500, 600)]
    ds.end_encounter(e, 400)
    assert rows()[0] == (d, p, 100, 400) and ds.info("encounters", e)["end_n"] == 400
    ds.delete_encounter(other)
    assert len(rows()) == 1 and ds.table("device_encounter").count() == 1 and ds.info("encounters", other) == {}
    with pytest.raises(ValueError):
        ds.delete_encounter(other)


def test_label_sets_and_sources(ds):
    a = ds.insert_label_set("arrest", "event")
    top = ds.label_set_id("event")
    assert ds.label_set_info(a)["parent"] == "event" and ds.label_set_parent(a)["label_set_id"] == top and ds.label_set_parent(top) == {}
    assert [r["label_set_id"] for r in ds.label_set_children(top).collect()] == [a]
    s = ds.insert_label_source("doctor", "by hand")
    assert ds.label_source_id("doctor") == s and ds.label_source_info(s)["description"] == "by hand" and ds.label_source_id("x") is None
    ids = ds.insert_labels([dict(name="arrest", device_id=1, start_n=1, end_n=4, source="doctor"), dict(name="new", device_id=1, start_n=2, end_n=3)])
    assert len(set(ids)) == 2 and ds.table("label_sets").count() == 3
    assert [r["name"] for r in ds.label_sets(2, 1).collect()] == ["arrest", "new"] and ds.label_sources().count() == 1
    with pytest.raises(ValueError):
        ds.insert_labels([dict(name="a", device_id=1, start_n=3, end_n=2)])


def test_writes_keep_the_coverage(ds, spark):
    m = ds.insert_measure("x", period_ns=10)
    rows = lambda times, v=1.0: spark.createDataFrame([(m, 1, t, v) for t in times], "measure_id long, device_id long, time_n long, value double")
    cover = lambda: sorted((r["start_n"], r["end_n"]) for r in ds.table("intervals").collect())
    ds.write(rows([0, 10, 20]))
    assert cover() == [(0, 30)] and ds.interval_exists(m, 1) and not ds.interval_exists(m, 2)
    ds.write(rows([30, 100]), "last")
    assert cover() == [(0, 40), (100, 110)]
    ds.write(rows([10], 7.0), "last")
    ds.write(rows([20], 7.0), "first")
    assert {r["time_n"]: r["value"] for r in ds.table("samples").collect()} == {0: 1.0, 10: 7.0, 20: 1.0, 30: 1.0, 100: 1.0}
    ds.insert_intervals(spark.createDataFrame([(m, 1, 200, 210)], "measure_id long, device_id long, start_n long, end_n long"))
    assert cover()[-1] == (200, 210)
    ds.replace_intervals(m, 1, spark.createDataFrame([(m, 1, 5, 6)], "measure_id long, device_id long, start_n long, end_n long"))
    assert cover() == [(5, 6)]


def test_transfer(ds, spark, tmp_path):
    to = Dataset(spark, f"file://{tmp_path}/t").create()
    to.insert_measure("other", period_ns=5)
    m, d, p = ds.insert_measure("x", period_ns=10), ds.insert_device("dev"), ds.insert_patient("11", first_name="A", dob=1000)
    ds.insert_device_patient([dict(device_id=d, patient_id=p, start_n=100, end_n=None)])
    ds.insert_history(p, "weight", 3.0, 150)
    ds.insert_label_set("leaf", "root")
    ds.insert_labels([dict(name="leaf", device_id=d, start_n=110, end_n=120, measure_id=m, source="s")])
    ds.write_pairs(m, d, [100, 110, 900], [1, 2, 3])
    ds.transfer(to, start_n=100, end_n=500, shift_n=50, hide={"first_name": None, "mrn": "anon"})
    new = to.find("measures", tag="x").first()["measure_id"]
    assert new != m and sorted((r["measure_id"], r["time_n"], r["value"]) for r in to.table("samples").collect()) == [(new, 50, 1.0), (new, 60, 2.0)]
    patient = to.table("patients").first()
    assert (patient["mrn"], patient["first_name"], patient["dob"]) == ("anon", None, 950)
    assert to.table("device_patient").first()["start_n"] == 50 and to.table("patient_history").first()["time_n"] == 100
    label = to.table("labels").first()
    assert (label["start_n"], label["measure_id"]) == (60, new) and to.label_set_info(label["label_set_id"])["parent"] == "root"
