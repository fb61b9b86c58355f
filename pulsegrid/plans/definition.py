"""Declarative cohort definitions: measures, labels, and sources with time specs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import joins

SOURCES = ("device_ids", "patient_ids", "device_tags", "mrns")
SPEC_KEYS = frozenset(["start", "end", "time0", "pre", "post", "files"])
KEYS = frozenset(["measures", "labels", *SOURCES])


def check_spec(spec) -> None:
    """``all``, or a list of {start?, end?} and {time0, pre, post}."""
    if spec == "all":
        return
    if not isinstance(spec, list):
        raise ValueError("a time spec is 'all' or a list")
    for s in spec:
        if not isinstance(s, dict) or set(s) - SPEC_KEYS:
            raise ValueError(f"unknown keys in time spec {s!r}")
        if ("pre" in s or "post" in s) and "time0" not in s:
            raise ValueError("pre and post need time0")
        if s.get("pre", 0) < 0 or s.get("post", 0) < 0:
            raise ValueError("pre and post are not negative")
        if "start" in s and "end" in s and s["start"] >= s["end"]:
            raise ValueError("start must be before end")


@dataclass
class Definition:
    measures: list = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    device_ids: dict = field(default_factory=dict)
    patient_ids: dict = field(default_factory=dict)
    device_tags: dict = field(default_factory=dict)
    mrns: dict = field(default_factory=dict)

    @staticmethod
    def from_dict(doc: dict) -> Definition:
        if unknown := set(doc) - KEYS:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        out = Definition(list(doc.get("measures") or []), list(doc.get("labels") or []), **{s: dict(doc.get(s) or {}) for s in SOURCES})
        out.check()
        return out

    @staticmethod
    def from_yaml(path: str) -> Definition:
        import yaml

        with open(path) as f:
            return Definition.from_dict(yaml.safe_load(f) or {})

    def to_dict(self) -> dict:
        return {"measures": self.measures, "labels": self.labels} | {s: getattr(self, s) for s in SOURCES if getattr(self, s)}

    def save(self, path: str) -> None:
        """YAML where the library is present, else JSON (which YAML reads)."""
        try:
            import yaml

            text = yaml.safe_dump(self.to_dict(), sort_keys=False)
        except ImportError:
            text = json.dumps(self.to_dict(), indent=1)
        with open(path, "w") as f:
            f.write(text)

    def key(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, default=str).encode()).hexdigest()

    def check(self) -> None:
        seen = set()
        for m in self.measures:
            if not isinstance(m, (str, list, tuple, dict)):
                raise ValueError(f"a measure is a tag, a triple or a mapping, not {m!r}")
            key = json.dumps(m, sort_keys=True)
            if key in seen:
                raise ValueError(f"measure {m!r} twice")
            seen.add(key)
        if len(set(self.labels)) != len(self.labels):
            raise ValueError("a label twice")
        for s in SOURCES:
            for key, spec in getattr(self, s).items():
                if s in ("device_ids", "patient_ids") and not isinstance(key, int):
                    raise ValueError(f"{s} are integers, not {key!r}")
                check_spec(spec)

    def add_measure(self, measure) -> Definition:
        if measure not in self.measures:
            self.measures.append(measure)
        return self

    def add_label(self, label: str) -> Definition:
        if label in self.labels:
            raise ValueError(f"label {label!r} twice")
        self.labels.append(label)
        return self

    def add_region(self, source: str, key, **spec) -> Definition:
        """start/end or time0/pre/post; no keyword means ``all``, which wins over ranges."""
        held = getattr(self, source)
        if not spec or held.get(key) == "all":
            held[key] = "all"
        else:
            check_spec([spec])
            held.setdefault(key, []).append(spec)
        return self

    def combine(self, other: Definition) -> Definition:
        out = Definition([*self.measures, *[m for m in other.measures if m not in self.measures]], [*self.labels, *[x for x in other.labels if x not in self.labels]])
        for s in SOURCES:
            merged = {k: v if v == "all" else list(v) for k, v in getattr(self, s).items()}
            for k, v in getattr(other, s).items():
                merged[k] = "all" if v == "all" or merged.get(k) == "all" else [*merged.get(k, []), *v]
            setattr(out, s, merged)
        return out

    def specs(self, spark: SparkSession, source: str) -> DataFrame:
        """source_key, is_all, start_n, end_n: event regions already resolved; null ends are open."""
        rows = []
        for k, spec in getattr(self, source).items():
            for s in [{}] if spec == "all" else spec:
                if "time0" in s:
                    rows.append((str(k), False, s["time0"] - s.get("pre", 0), s["time0"] + s.get("post", 0)))
                else:
                    rows.append((str(k), spec == "all", s.get("start"), s.get("end")))
        return spark.createDataFrame(rows, "source_key string, is_all boolean, start_n long, end_n long")


def resolve(specs: DataFrame, coverage: DataFrame, key: str, start_n: int | None = None, end_n: int | None = None) -> DataFrame:
    """Ranges of each source: specs with open ends filled from its coverage, clipped, merged.

    ``all`` is the coverage itself. Sources without coverage are dropped, with what
    global bounds leave empty.
    """
    known = coverage.withColumn("source_key", F.col(key).cast("string"))
    ends = known.groupBy("source_key", key).agg(F.min("start_n").alias("c_start"), F.max("end_n").alias("c_end"))
    picked = specs.where("not is_all").join(ends, "source_key").select(key, F.coalesce("start_n", "c_start").alias("start_n"), F.coalesce("end_n", "c_end").alias("end_n"))
    whole = known.join(specs.where("is_all").select("source_key").distinct(), "source_key", "left_semi").select(key, "start_n", "end_n")
    return iv.union(iv.clip(picked.unionByName(whole), start_n, end_n), [key])


def validate(definition: Definition, spark: SparkSession, coverage: DataFrame, mapping: DataFrame, now_n: int, devices: DataFrame | None = None, patients: DataFrame | None = None) -> DataFrame:
    """device_id, patient_id, start_n, end_n of a definition over device coverage.

    Tags and mrns are looked up; unknown ones are dropped. Devices are mapped to
    patients; a patient's ranges are those of its mapped devices.
    """
    by_device = definition.specs(spark, "device_ids")
    if definition.device_tags and devices is not None:
        tagged = definition.specs(spark, "device_tags").join(devices.select(F.col("tag").alias("source_key"), F.col("device_id").cast("string").alias("__d")), "source_key")
        by_device = by_device.unionByName(tagged.drop("source_key").withColumnRenamed("__d", "source_key"))
    out = joins.map_sources(resolve(by_device, coverage, "device_id"), mapping, now_n)
    by_patient = definition.specs(spark, "patient_ids")
    if definition.mrns and patients is not None:
        named = definition.specs(spark, "mrns").join(patients.select(F.col("mrn").alias("source_key"), F.col("patient_id").cast("string").alias("__p")), "source_key")
        by_patient = by_patient.unionByName(named.drop("source_key").withColumnRenamed("__p", "source_key"))
    owned = joins.map_sources(coverage, mapping, now_n).where("patient_id is not null")
    wanted = resolve(by_patient, owned, "patient_id")
    hit = joins.interval_join(owned.select("patient_id", "device_id", "start_n", "end_n"), wanted, ["patient_id"])
    hit = hit.select("device_id", "patient_id", F.greatest("start_n", "b_start_n").alias("start_n"), F.least("end_n", "b_end_n").alias("end_n"))
    both = out.unionByName(hit)
    return iv.union(both, ["device_id", "patient_id"])
