"""Named look-ups and inserts of the dimension tables, over what Dataset offers generically.

Look-ups by key return a dict (empty when there is none) or an id (None), listings a DataFrame;
nothing here touches samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IDENTITY, KEYS


class Metadata:
    """Mixed into Dataset; needs ``table``, ``find``, ``insert`` and ``replace``."""

    # -- by key or identity --------------------------------------------------
    def info(self, name: str, key: int) -> dict:
        """The row of a dimension with this id."""
        row = self.find(name, **{KEYS[name]: key}).first()
        return row.asDict() if row else {}

    def id_of(self, name: str, *identity) -> int | None:
        """The id of the row with this identity (its leading columns suffice)."""
        columns = IDENTITY[name][: len(identity)]
        row = self.find(name, **dict(zip(columns, identity, strict=True))).orderBy(KEYS[name]).first()
        return row[KEYS[name]] if row else None

    def rows_in(self, name: str, keys: list, column: str | None = None) -> DataFrame:
        """Rows whose id (or ``column``) is in the list; an empty list finds none."""
        return self.table(name).where(F.col(column or KEYS[name]).isin(list(keys)))

    def page(self, name: str, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows in the order of their ids; ``limit`` and ``offset`` cut a page."""
        rows = self.table(name).orderBy(KEYS[name]).offset(offset)
        return rows if limit is None else rows.limit(limit)

    # -- measures, devices ---------------------------------------------------
    def measure_info(self, measure_id: int) -> dict:
        return self.info("measures", measure_id)

    def measures(self) -> DataFrame:
        return self.page("measures")

    def measure_ids(self, measure, rule: str = "all") -> list[int]:
        """Ids of an id, a tag, a (tag, freq_nhz, unit) tuple or a dict of columns, best covered first.

        ``rule`` ``best`` takes the one with most covered time, ties the least id; ``all`` takes all.
        """
        if isinstance(measure, int):
            return [measure] if self.info("measures", measure) else []
        if isinstance(measure, str):
            measure = {"tag": measure}
        elif not isinstance(measure, dict):
            measure = {c: v for c, v in zip(IDENTITY["measures"], measure, strict=False) if v is not None}
        if rule not in ("all", "best"):
            raise ValueError(f"unknown rule {rule!r}")
        cover = self.table("intervals").groupBy("measure_id").agg(F.sum(F.col("end_n") - F.col("start_n")).alias("ns"))
        rows = self.find("measures", **measure).join(cover, "measure_id", "left")
        found = [r["measure_id"] for r in rows.orderBy(F.coalesce("ns", F.lit(0)).desc(), "measure_id").collect()]
        return found[:1] if rule == "best" else found

    def device_info(self, device_id: int) -> dict:
        """The device with the names of its bed, unit and institution."""
        out = self.info("devices", device_id)
        if out.get("bed_id") is not None:
            out["bed"] = self.bed_info(out["bed_id"]).get("name")
        return out

    def devices(self) -> DataFrame:
        return self.page("devices")

    def interval_exists(self, measure_id: int, device_id: int) -> bool:
        return not self.find("intervals", measure_id=measure_id, device_id=device_id).isEmpty()

    # -- patients ------------------------------------------------------------
    def patients(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self.page("patients", limit, offset)

    def patient_id(self, mrn) -> int | None:
        return self.id_of("patients", str(mrn))

    def mrn(self, patient_id: int) -> str | None:
        return self.info("patients", patient_id).get("mrn")

    def mrn_to_patient(self, mrns: list | None = None) -> DataFrame:
        """mrn, patient_id of the given (else all) medical record numbers."""
        rows = self.table("patients") if mrns is None else self.rows_in("patients", [str(m) for m in mrns], "mrn")
        return rows.where("mrn is not null").select("mrn", "patient_id")

    def patient_to_mrn(self, patient_ids: list | None = None) -> DataFrame:
        rows = self.table("patients") if patient_ids is None else self.rows_in("patients", patient_ids)
        return rows.where("mrn is not null").select("patient_id", "mrn")

    def patients_in(self, patient_ids: list = (), mrns: list = ()) -> DataFrame:
        return self.table("patients").where(F.col("patient_id").isin(list(patient_ids)) | F.col("mrn").isin([str(m) for m in mrns]))

    def history(self, patient_id: int, field: str | None = None, start_n: int | None = None, end_n: int | None = None) -> DataFrame:
        """History rows in time order, of one field or all, within [start_n, end_n]."""
        rows = self.find("patient_history", patient_id=patient_id)
        rows = rows if field is None else rows.where(F.col("field") == field)
        rows = rows if start_n is None else rows.where(F.col("time_n") >= start_n)
        rows = rows if end_n is None else rows.where(F.col("time_n") <= end_n)
        return rows.orderBy("time_n", "id")

    def history_fields(self) -> list[str]:
        return [r["field"] for r in self.table("patient_history").select("field").distinct().orderBy("field").collect()]

    def insert_device_patient(self, rows: list[dict]) -> list[int]:
        return self.insert("device_patient", rows)

    # -- encounters: the mapping of a bed's static devices follows them ---------
    def insert_encounter(self, patient_id: int, bed_id: int, start_n: int, end_n: int | None = None, **more) -> int:
        """Insert once (equal patient, bed and start are one) and map the bed's static devices."""
        old = self.find("encounters", patient_id=patient_id, bed_id=bed_id, start_n=start_n).first()
        if old:
            return old["id"]
        number = self.insert("encounters", [dict(patient_id=patient_id, bed_id=bed_id, start_n=start_n, end_n=end_n, **more)])[0]
        devices = [r["device_id"] for r in self.find("devices", bed_id=bed_id, type="static").collect()]  # the devices of one bed
        if devices:
            self.insert("device_patient", [dict(device_id=d, patient_id=patient_id, start_n=start_n, end_n=end_n) for d in devices])
            self.insert("device_encounter", [dict(device_id=d, encounter_id=number, start_n=start_n, end_n=end_n) for d in devices])
        return number

    def _of_encounter(self, number: int) -> tuple[dict, F.Column]:
        e = self.info("encounters", number)
        if not e:
            raise ValueError(f"no encounter {number}")
        devices = [r["device_id"] for r in self.find("device_encounter", encounter_id=number).collect()]
        return e, F.col("device_id").isin(devices) & (F.col("patient_id") == e["patient_id"]) & (F.col("start_n") == e["start_n"])

    def end_encounter(self, number: int, end_n: int) -> None:
        """Close an encounter and the mappings that it opened and that are still open."""
        _, mine = self._of_encounter(number)
        for name, which in (("device_patient", mine & F.col("end_n").isNull()), ("device_encounter", (F.col("encounter_id") == number) & F.col("end_n").isNull()), ("encounters", F.col("id") == number)):
            self.replace(name, self.table(name).withColumn("end_n", F.when(which, F.lit(end_n)).otherwise(F.col("end_n"))))

    def delete_encounter(self, number: int) -> None:
        """Delete an encounter and the mappings that it made."""
        _, mine = self._of_encounter(number)
        for name, which in (("device_patient", mine), ("device_encounter", F.col("encounter_id") == number), ("encounters", F.col("id") == number)):
            self.replace(name, self.table(name).where(~F.coalesce(which, F.lit(False))))

    # -- places and sources --------------------------------------------------
    def insert_source(self, name: str, description: str | None = None) -> int:
        return self.insert("sources", [dict(name=name, description=description)])[0]

    def insert_institution(self, name: str) -> int:
        return self.insert("institutions", [dict(name=name)])[0]

    def insert_unit(self, institution_id: int, name: str, kind: str | None = None) -> int:
        return self.insert("units", [dict(institution_id=institution_id, name=name, type=kind)])[0]

    def insert_bed(self, unit_id: int, name: str) -> int:
        return self.insert("beds", [dict(unit_id=unit_id, name=name)])[0]

    def source_id(self, name: str) -> int | None:
        return self.id_of("sources", name)

    def source_info(self, source_id: int) -> dict:
        return self.info("sources", source_id)

    def bed_id(self, name: str, unit_id: int | None = None) -> int | None:
        row = self.find("beds", name=name, **({} if unit_id is None else {"unit_id": unit_id})).orderBy("bed_id").first()
        return row["bed_id"] if row else None

    def bed_info(self, bed_id: int) -> dict:
        """The bed with the names of its unit and institution."""
        b = self.info("beds", bed_id)
        u = self.info("units", b["unit_id"]) if b.get("unit_id") is not None else {}
        i = self.info("institutions", u["institution_id"]) if u.get("institution_id") is not None else {}
        return {**b, "unit": u.get("name"), "institution": i.get("name")} if b else {}

    # -- settings ------------------------------------------------------------
    def settings(self) -> dict[str, str]:
        return {r["name"]: r["value"] for r in self.table("settings").collect()}

    def set_setting(self, name: str, value) -> None:
        one = self.spark.createDataFrame([(name, str(value))], "name string, value string")
        self.replace("settings", self.table("settings").where(F.col("name") != name).unionByName(one))

    # -- labels --------------------------------------------------------------
    def insert_label_set(self, name: str, parent: str | None = None) -> int:
        """The id of a label name, made if need be; ``parent`` is set when it is made."""
        above = None if parent is None else self.insert_label_set(parent)
        return self.insert("label_sets", [dict(name=name, parent_id=above)])[0]

    def insert_label_source(self, name: str, description: str | None = None) -> int:
        return self.insert("label_sources", [dict(name=name, description=description)])[0]

    def insert_labels(self, rows: list[dict]) -> list[int]:
        """Many labels at once: name, device_id, start_n, end_n, and optionally measure_id and source."""
        sets = dict(zip(names := sorted({r["name"] for r in rows}), self.insert("label_sets", [dict(name=n) for n in names]), strict=True))
        made = sorted({r["source"] for r in rows if r.get("source")})
        sources = dict(zip(made, self.insert("label_sources", [dict(name=n) for n in made]), strict=True))
        for r in rows:
            if r["start_n"] > r["end_n"]:
                raise ValueError("a label ends before it starts")
        return self.insert("labels", [dict(label_set_id=sets[r["name"]], label_source_id=sources.get(r.get("source")), device_id=r["device_id"], measure_id=r.get("measure_id"), start_n=r["start_n"], end_n=r["end_n"]) for r in rows])

    def label_set_id(self, name: str) -> int | None:
        return self.id_of("label_sets", name)

    def label_set_info(self, label_set_id: int) -> dict:
        """The label name with its parent's."""
        out = self.info("label_sets", label_set_id)
        if out:
            out["parent"] = self.info("label_sets", out["parent_id"]).get("name") if out["parent_id"] is not None else None
        return out

    def label_sets(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self.page("label_sets", limit, offset)

    def label_set_children(self, label_set_id: int) -> DataFrame:
        return self.find("label_sets", parent_id=label_set_id).orderBy("label_set_id")

    def label_set_parent(self, label_set_id: int) -> dict:
        above = self.info("label_sets", label_set_id).get("parent_id")
        return self.info("label_sets", above) if above is not None else {}

    def label_source_id(self, name: str) -> int | None:
        return self.id_of("label_sources", name)

    def label_source_info(self, label_source_id: int) -> dict:
        return self.info("label_sources", label_source_id)

    def label_sources(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self.page("label_sources", limit, offset)
