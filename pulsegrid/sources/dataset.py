"""A dataset: a folder of Parquet tables with the canonical schemas.

``samples`` is partitioned by measure and day and sorted by device and time inside
its files, so that row-group statistics prune scans. Every write lands in new files or
replaces whole (measure, day) partitions through a staging copy, never in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gaps, units
from ..operators import intervals as iv
from ..operators import scan
from ..schema import IDENTITY, KEYS, TABLES
from .metadata import Metadata

DAY_NS = iv.DAY_NS


class Dataset(Metadata):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files ---------------------------------------------------------------
    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._at(name)))

    def create(self) -> Dataset:
        """Write the empty dimension tables (what exists stays)."""
        for name, schema in TABLES.items():
            if name != "samples" and not self.exists(name):
                self.spark.createDataFrame([], schema).write.parquet(self._at(name))
        return self

    def table(self, name: str) -> DataFrame:
        if name == "samples":
            schema = TABLES["samples"] + ", day long"
            return self.spark.read.schema(schema).parquet(self._at(name)) if self.exists(name) else self.spark.createDataFrame([], schema)
        return self.spark.read.schema(TABLES[name]).parquet(self._at(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Swap a table for ``rows``, which may read the old one: stage, move the old away, rename."""
        fs, path = self._fs()
        mark = uuid.uuid4().hex
        stage, old = self._at(f"_stage-{mark}"), self._at(f"_old-{mark}")
        rows.write.parquet(stage)
        if self.exists(name):
            fs.rename(path(self._at(name)), path(old))  # after a crash here the rows are in _old and _stage
        fs.rename(path(stage), path(self._at(name)))
        fs.delete(path(old), True)

    # -- dimensions ----------------------------------------------------------
    def insert(self, name: str, rows: list[dict]) -> list[int]:
        """Append rows; one whose identity is known already is ignored. Returns the ids."""
        old = self.table(name)
        key, identity = KEYS.get(name), IDENTITY.get(name)
        fields = [c.split()[0] for c in TABLES[name].split(", ")]
        known = {}
        if identity and rows:  # only rows that may be the given ones come to the driver
            like = old.where(F.col(identity[0]).isin(list({r.get(identity[0]) for r in rows} - {None})))
            known = {tuple(r[c] for c in identity): r[key] if key else None for r in like.select(*identity, *([key] if key else [])).collect()}
        following = (old.agg(F.max(key)).first()[0] or 0) + 1 if key else 0
        fresh, ids = [], []
        for row in rows:
            if unknown := set(row) - set(fields):
                raise ValueError(f"{name} has no column {sorted(unknown)}")
            same = tuple(row.get(c) for c in identity) if identity else None
            if identity and same in known and None not in same[:1]:
                ids.append(known[same])
                continue
            row = dict(row)
            if key and row.get(key) is None:
                row[key] = following
            if key:
                following = max(following, row[key] + 1)
            if identity:
                known[same] = row.get(key)
            fresh.append(tuple(row.get(c) for c in fields))
            ids.append(row.get(key))
        if fresh:
            self.spark.createDataFrame(fresh, TABLES[name]).coalesce(1).write.mode("append").parquet(self._at(name))
        return ids

    def insert_measure(self, tag: str, freq_nhz: int | None = None, period_ns: int | None = None, unit: str | None = None, **more) -> int:
        if (freq_nhz is None) == (period_ns is None):
            raise ValueError("give either a frequency or a period")
        freq_nhz = freq_nhz if freq_nhz is not None else 10**18 // period_ns
        return self.insert("measures", [dict(tag=tag, freq_nhz=freq_nhz, period_ns=period_ns or 10**18 // freq_nhz, unit=unit, **more)])[0]

    def insert_device(self, tag: str, **more) -> int:
        return self.insert("devices", [dict(tag=tag, type=more.pop("type", "static"), **more)])[0]

    def insert_patient(self, mrn: str | None = None, **more) -> int:
        return self.insert("patients", [dict(mrn=None if mrn is None else str(mrn), **more)])[0]

    def insert_history(self, patient_id: int, field: str, value: float, time_n: int, unit: str | None = None) -> int:
        """Append a history row; the newest height and weight show in patient_info()."""
        return self.insert("patient_history", [dict(patient_id=patient_id, field=field, value=float(value), units=unit, time_n=time_n)])[0]

    def insert_label(self, name: str, device_id: int, start_n: int, end_n: int, measure_id: int | None = None, source: str | None = None) -> int:
        set_id = self.insert("label_sets", [dict(name=name)])[0]
        source_id = self.insert("label_sources", [dict(name=source)])[0] if source else None
        return self.insert("labels", [dict(label_set_id=set_id, device_id=device_id, measure_id=measure_id, label_source_id=source_id, start_n=start_n, end_n=end_n)])[0]

    def delete_labels(self, ids: list[int] | None = None, everything: bool = False) -> None:
        if not ids and not everything:
            raise ValueError("an empty filter deletes nothing; say everything=True")
        rows = self.table("labels")
        self.replace("labels", rows.limit(0) if everything else rows.where(~F.col("label_id").isin(ids)))

    def patient_info(self, patient_id: int, time_n: int | None = None) -> dict:
        """Demographics with the newest height and weight (at or before ``time_n``)."""
        row = self.table("patients").where(F.col("patient_id") == patient_id).first()
        if row is None:
            return {}
        out = row.asDict()
        past = self.table("patient_history").where(F.col("patient_id") == patient_id)
        past = past if time_n is None else past.where(F.col("time_n") <= time_n)
        for r in past.groupBy("field").agg(F.max_by("value", F.struct("time_n", "id")).alias("value")).collect():
            out[r["field"]] = r["value"]
        return out

    def find(self, name: str, /, like: dict[str, str] | None = None, **equal) -> DataFrame:
        """Rows of a dimension by substrings (``like``), equal values, or lists of values."""
        out = self.table(name)
        for c, v in (like or {}).items():
            out = out.where(F.col(c).contains(v))
        for c, v in equal.items():
            out = out.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
        return out

    # -- samples -------------------------------------------------------------
    def write(self, samples: DataFrame, on_conflict: str = "append") -> None:
        """samples(measure_id, device_id, time_n, value[, write_seq]); ``write_seq`` orders
        the rows of this write, all of which come after what is stored.

        ``append`` keeps all samples (scans can dedup), ``last`` and ``first`` rewrite the
        (measure, day) partitions they touch so that one sample of each time stays, and
        ``error`` refuses samples inside covered time.
        """
        if "write_seq" not in samples.columns:
            samples = samples.withColumn("write_seq", F.lit(None).cast("long"))
        # writes are numbered in the settings; a row's number inside of its write takes the lower bits
        batch = int(self.settings().get("writes", 0)) + 1
        self.set_setting("writes", batch)
        number = F.coalesce("write_seq", F.lit(0)) + (batch << 40)
        fresh = samples.select("measure_id", "device_id", "time_n", F.col("value").cast("double").alias("value"), number.alias("write_seq"), units.floor_div(F.col("time_n"), DAY_NS).alias("day"))
        if on_conflict == "append":
            self._save(fresh, "append")
        else:
            span = fresh.agg(F.min("day"), F.max("day"), F.collect_set("measure_id")).first()  # a partition filter
            if span[0] is None:
                return
            touched = fresh.select("measure_id", "day").distinct()
            old = self.table("samples").where(F.col("day").between(span[0], span[1]) & F.col("measure_id").isin(span[2]))
            old = old.join(touched, ["measure_id", "day"], "left_semi")
            if on_conflict == "error":
                if not old.join(fresh, ["measure_id", "device_id", "time_n"], "left_semi").isEmpty():
                    raise ValueError("the dataset has samples at these times")
                self._save(fresh, "append")
            elif on_conflict in ("last", "first"):
                self._rewrite(scan.dedup(old.unionByName(fresh), ["measure_id", "device_id"], on_conflict))
            else:
                raise ValueError(f"unknown policy {on_conflict!r}")
        self.merge_intervals(self._cover(fresh))

    def _cover(self, samples: DataFrame) -> DataFrame:
        """Coverage of samples of measures whose period is known."""
        periods = self.table("measures").where("period_ns is not null").select("measure_id", "period_ns")
        return iv.from_samples(samples.join(periods, "measure_id"), ["measure_id", "device_id"], F.col("period_ns"), 0).select("measure_id", "device_id", "start_n", "end_n")

    def insert_intervals(self, rows: DataFrame) -> None:
        """Append coverage rows as they are."""
        rows.select("measure_id", "device_id", "start_n", "end_n").write.mode("append").parquet(self._at("intervals"))

    def replace_intervals(self, measure_id: int, device_id: int, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all coverage of one signal."""
        mine = (F.col("measure_id") == measure_id) & (F.col("device_id") == device_id)
        self.replace("intervals", self.table("intervals").where(~mine).unionByName(rows.select("measure_id", "device_id", "start_n", "end_n")))

    def merge_intervals(self, rows: DataFrame, tolerance: int = 0) -> None:
        """Union ``rows`` with the stored coverage of their signals; other signals stay as they are."""
        keys = ["measure_id", "device_id"]
        stored, signals = self.table("intervals"), rows.select(*keys).distinct()
        merged = iv.union(stored.join(signals, keys, "left_semi").unionByName(rows), keys, tolerance)
        self.replace("intervals", stored.join(signals, keys, "left_anti").unionByName(merged.select(*keys, "start_n", "end_n")))

    def _save(self, rows: DataFrame, mode: str) -> None:
        # by range, so that a day with many devices is many files and each file's statistics are narrow
        order = ["measure_id", "day", "device_id", "time_n"]
        out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("measure_id", "day").parquet(self._at("samples"))

    def _rewrite(self, rows: DataFrame) -> None:
        stage = self._at(f"_stage-{uuid.uuid4().hex}")
        rows.write.parquet(stage)
        self._save(self.spark.read.schema(rows.schema).parquet(stage), "overwrite")
        fs, path = self._fs()
        fs.delete(path(stage), True)

    def write_segments(self, segments: DataFrame, on_conflict: str = "append") -> None:
        """segments(measure_id, device_id, start_n, period_ns, values) of equally spaced samples."""
        self.write(gaps.messages_to_samples(segments, ["measure_id", "device_id"], F.col("period_ns")) if "period_ns" not in segments.columns else segments.select("measure_id", "device_id", "start_n", "period_ns", F.posexplode("values").alias("pos", "value")).select("measure_id", "device_id", (F.col("start_n") + F.col("pos") * F.col("period_ns")).alias("time_n"), "value"), on_conflict)

    def write_pairs(self, measure_id: int, device_id: int, times: list, values: list, unit: str = "ns", on_conflict: str = "first") -> None:
        if len(times) != len(values):
            raise ValueError("times and values differ in length")
        rows = [(measure_id, device_id, units.scalar_ns(t, unit), float(v), k) for k, (t, v) in enumerate(zip(times, values, strict=True))]
        self.write(self.spark.createDataFrame(rows, TABLES["samples"]), on_conflict)

    def compact(self, measure_id: int | None = None, keep: str | None = "last") -> None:
        """Rewrite partitions into sorted files (and dedup, if ``keep`` is given)."""
        rows = self.table("samples")
        rows = rows if measure_id is None else rows.where(F.col("measure_id") == measure_id)
        self._rewrite(scan.dedup(rows, ["measure_id", "device_id"], keep) if keep else rows)

    def rebuild_intervals(self, tolerance: int = 0) -> DataFrame:
        """Derive the coverage table from the samples, with each measure's own period."""
        periods = self.table("measures").select("measure_id", "period_ns")
        cells = self.table("samples").join(periods, "measure_id")
        rows = iv.from_samples(cells, ["measure_id", "device_id"], F.col("period_ns"), tolerance).select("measure_id", "device_id", "start_n", "end_n")
        self.replace("intervals", rows)
        return self.table("intervals")

    def transfer(self, to: Dataset, device_ids: list[int] | None = None, measure_ids: list[int] | None = None, start_n: int | None = None, end_n: int | None = None, shift_n: int = 0, hide: dict[str, object] | None = None, labels: bool = True) -> None:
        """Copy samples, measures, devices, patients, mappings and labels, with ids of ``to``'s own.

        ``shift_n`` moves all times back; ``hide`` gives columns of patients fixed values (None: left out).
        Dimensions are small and go through ``insert``, which knows rows that are there already.
        """
        only = lambda name, column, values: self.table(name) if values is None else self.table(name).where(F.col(column).isin(list(values)))
        inside = lambda rows, a, b: rows.where(F.lit(True) if end_n is None else F.col(a) < end_n).where(F.lit(True) if start_n is None else F.coalesce(F.col(b) >= start_n, F.lit(True)))
        moved = lambda v: None if v is None else v - shift_n

        def copy(name: str, rows: DataFrame, change=lambda d: d) -> dict[int, int]:
            key = KEYS[name]
            found = [r.asDict() for r in rows.orderBy(key).collect()]
            ids = to.insert(name, [change({c: v for c, v in d.items() if c != key}) for d in found])
            return dict(zip([d[key] for d in found], ids, strict=True))

        m = copy("measures", only("measures", "measure_id", measure_ids))
        d = copy("devices", only("devices", "device_id", device_ids))
        mapping = inside(only("device_patient", "device_id", device_ids), "start_n", "end_n")
        chosen = self.table("patients").join(mapping.select("patient_id").distinct(), "patient_id", "left_semi")
        p = copy("patients", chosen, lambda x: {**x, **(hide or {}), "dob": moved(x["dob"]) if "dob" not in (hide or {}) else hide["dob"]})
        copy("device_patient", mapping, lambda x: dict(device_id=d[x["device_id"]], patient_id=p[x["patient_id"]], start_n=moved(x["start_n"]), end_n=moved(x["end_n"])))
        copy("patient_history", self.table("patient_history").where(F.col("patient_id").isin(list(p))), lambda x: {**x, "patient_id": p[x["patient_id"]], "time_n": moved(x["time_n"])})
        if labels:
            s = {None: None}
            rest = {r["label_set_id"]: r.asDict() for r in self.table("label_sets").collect()}
            while ready := [k for k, r in rest.items() if r["parent_id"] in s or r["parent_id"] not in rest]:  # parents first
                for k, i in zip(ready, to.insert("label_sets", [dict(name=rest[k]["name"], parent_id=s.get(rest[k]["parent_id"])) for k in ready]), strict=True):
                    s[k] = i
                    del rest[k]
            o = {None: None} | copy("label_sources", self.table("label_sources"))
            copy("labels", inside(only("labels", "device_id", device_ids), "start_n", "end_n"), lambda x: dict(label_set_id=s[x["label_set_id"]], device_id=d[x["device_id"]], measure_id=m.get(x["measure_id"]), label_source_id=o[x["label_source_id"]], start_n=moved(x["start_n"]), end_n=moved(x["end_n"])))
        rows = self.table("samples").where(F.col("measure_id").isin(list(m)) & F.col("device_id").isin(list(d)))
        rows = rows if start_n is None else rows.where(F.col("time_n") >= start_n)
        rows = rows if end_n is None else rows.where(F.col("time_n") < end_n)
        number = lambda ids, c: F.element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.col(c)).alias(c)
        if m and d:
            to.write(rows.select(number(m, "measure_id"), number(d, "device_id"), (F.col("time_n") - shift_n).alias("time_n"), "value"))

    def unreferenced(self, name: str, key: str, by: str) -> DataFrame:
        return self.table(name).join(self.table(by).select(key).where(F.col(key).isNotNull()), key, "left_anti")

    def read(self, **how) -> DataFrame:
        return scan.range_scan(self.table("samples"), mapping=self.table("device_patient"), **how)
