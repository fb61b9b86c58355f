"""Import and export of plain files: CSV and Parquet with side-car metadata, definitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units


def read_pairs(spark: SparkSession, path: str, kind: str = "csv", unit: str = "ns", header: bool = True) -> DataFrame:
    """file, time_n, value of every file of a kind below ``path``; columns 0 and 1 are time and value."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}")
    raw = reader.option("header", header).option("inferSchema", "true").csv(path) if kind == "csv" else reader.parquet(path)
    time, value = raw.columns[:2]
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1)
    return raw.select(name.alias("file"), units.to_ns(F.col(time), unit).alias("time_n"), F.col(value).cast("double").alias("value"))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """file, measure_id, device_id from a JSON object of objects by file name."""
    text = spark.read.option("wholetext", "true").text(path).first()["value"]
    rows = [(k, int(v["measure_id"]), int(v["device_id"])) for k, v in json.loads(text).items()]
    return spark.createDataFrame(rows, "file string, measure_id long, device_id long")


def import_folder(spark: SparkSession, path: str, sidecar: DataFrame, kind: str = "csv", unit: str = "ns") -> DataFrame:
    """Samples of the files that the side-car names."""
    return read_pairs(spark, path, kind, unit).join(F.broadcast(sidecar) if sidecar.count() <= 100_000 else sidecar, "file").select("measure_id", "device_id", "time_n", "value")


def export(samples: DataFrame, path: str, kind: str = "parquet", chunk_ns: int = 86_400_000_000_000, time: str = "ns", zone: str = "Etc/GMT") -> None:
    """One folder per measure, device and time chunk; times in a unit or as ISO text (``iso``)."""
    rows = samples.withColumn("chunk", units.floor_div(F.col("time_n"), chunk_ns))
    shown = units.iso_string(F.col("time_n"), zone) if time == "iso" else F.col("time_n") if time == "ns" else units.from_ns(F.col("time_n"), time)
    rows = rows.repartition("measure_id", "device_id", "chunk").sortWithinPartitions("measure_id", "device_id", "chunk", "time_n")
    rows = rows.select(shown.alias("time"), "value", "measure_id", "device_id", "chunk")
    rows.write.partitionBy("measure_id", "device_id", "chunk").format(kind).option("header", "true").save(path)


def transfer(samples: DataFrame, ranges: DataFrame, device_map: DataFrame | None = None, shift_ns: int = 0) -> DataFrame:
    """Samples inside ``ranges(device_id, start_n, end_n)``, with new device ids and shifted times."""
    from ..operators import joins

    out = joins.point_join(samples, ranges.select("device_id", "start_n", "end_n"), ["device_id"]).drop("start_n", "end_n")
    if device_map is not None:
        out = out.join(device_map, "device_id").drop("device_id").withColumnRenamed("new_device_id", "device_id")
    return out.withColumn("time_n", F.col("time_n") + shift_ns)


def deidentified(patients: DataFrame, columns: list[str], seed: int = 0, shift_ns: int = 0) -> DataFrame:
    """Patients with new ids (1.. in a seeded hash order), the named columns, and shifted times.

    Numbering is by count of smaller hashes inside hash ranges, not one global window.
    """
    from pyspark.sql.window import Window as W

    h = F.xxhash64(F.lit(seed), "patient_id")
    rows = patients.withColumn("__h", h).withColumn("__b", F.shiftright("__h", 52))
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    base = rows.groupBy("__b").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    numbered = rows.join(base, "__b").withColumn("new_patient_id", F.col("__base") + F.row_number().over(W.partitionBy("__b").orderBy("__h", "patient_id")))
    shown = [(F.col(c) + shift_ns).alias(c) if c in ("dob", "first_seen", "last_updated") else F.col(c) for c in columns]
    return numbered.select("patient_id", "new_patient_id", *shown)
