"""The canonical tables as views over the driver tables (events, orders, lineitem, ...)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.units import floor_div

HOUR_NS = 3_600_000_000_000
WEEK_NS = 168 * HOUR_NS
EPOCH_N = 1_704_067_200_000_000_000
NOW_N = 1_706_659_200_000_000_000
MEASURES = ("click", "error", "purchase", "signup", "view")


def _ns(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


class Canonical:
    """Views over one folder of driver tables; nothing is read until used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def samples(self) -> DataFrame:
        return self._samples(self.table("events"))

    def samples_of(self, measure_id: int, start_n: int, end_n: int) -> DataFrame:
        """Samples of a measure in [start_n, end_n); the bounds are also put on the stored columns, for the scan to use."""
        e = self.table("events")
        at = lambda n: F.timestamp_micros(F.lit(-(-n // 1000))).cast(e.schema["ts"].dataType)
        stored = e.where((F.col("event_type") == MEASURES[measure_id - 1]) & (F.col("ts") >= at(start_n)) & (F.col("ts") < at(end_n)))
        return self._samples(stored)

    def _samples(self, e: DataFrame) -> DataFrame:
        number = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MEASURES) for x in (m, i + 1)]), F.col("event_type")).cast("long")
        return e.select(number.alias("measure_id"), F.col("user_id").alias("device_id"), _ns("ts").alias("time_n"), "value", F.col("event_id").alias("write_seq"), F.col("event_type").alias("tag"))

    @property
    def samples_raw(self) -> DataFrame:
        return self.samples.withColumn("value_raw", F.round(F.col("value") * 100).cast("long")).withColumn("scale_m", F.lit(0.01)).withColumn("scale_b", F.lit(0.0)).drop("value")

    @property
    def measures(self) -> DataFrame:
        rows = [(i + 1, m, m, 277777, HOUR_NS, "unit") for i, m in enumerate(MEASURES)]
        return self.spark.createDataFrame(rows, "measure_id long, tag string, name string, freq_nhz long, period_ns long, unit string")

    @property
    def mapping(self) -> DataFrame:
        week = floor_div(F.col("time_n") - EPOCH_N, WEEK_NS)
        rows = self.samples.select("device_id", week.alias("w")).distinct()
        last = F.max("w").over(Window.partitionBy("device_id"))
        start = F.lit(EPOCH_N) + F.col("w") * WEEK_NS
        rows = rows.withColumn("last", last)
        return rows.select((F.col("device_id") * 100 + F.col("w")).alias("id"), "device_id", (F.col("device_id") * 100 + F.col("w")).alias("patient_id"), start.alias("start_n"), F.when(F.col("w") < F.col("last"), start + WEEK_NS).alias("end_n"))

    @property
    def encounters(self) -> DataFrame:
        o = self.table("orders").join(self.table("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("bed_id")), F.col("o_custkey") == F.col("c_custkey"))
        start = _ns("o_orderdate")
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), "bed_id", start.alias("start_n"), F.when(F.col("o_orderstatus") != "O", start + (F.col("o_orderkey") % 30 + 1) * 24 * HOUR_NS).alias("end_n"))

    @property
    def devices(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(F.col("s_suppkey").alias("device_id"), F.col("s_name").alias("tag"), F.when(F.col("s_suppkey") % 2 == 0, "static").otherwise("dynamic").alias("type"), F.col("s_nationkey").cast("long").alias("bed_id"))

    @property
    def label_sets(self) -> DataFrame:
        r = self.table("region").select((F.col("r_regionkey") + 1).cast("long").alias("label_set_id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"))
        n = self.table("nation").select((F.col("n_nationkey") + 101).cast("long").alias("label_set_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
        c = self.table("customer").select("c_nationkey", "c_mktsegment").distinct()
        code = F.ascii(F.substring("c_mktsegment", 1, 1)).cast("long")
        c = c.select((F.lit(1000) + F.col("c_nationkey") * 100 + code).cast("long").alias("label_set_id"), F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("name"), (F.col("c_nationkey") + 101).cast("long").alias("parent_id"))
        return r.unionByName(n).unionByName(c)

    @property
    def labels(self) -> DataFrame:
        e = self.samples.where("tag = 'error'")
        return e.select(F.col("write_seq").alias("label_id"), (F.lit(101) + F.pmod(F.col("write_seq"), F.lit(25))).cast("long").alias("label_set_id"), "device_id", F.lit(2).cast("long").alias("measure_id"), F.lit(1).cast("long").alias("label_source_id"), F.col("time_n").alias("start_n"), (F.col("time_n") + 2 * HOUR_NS).alias("end_n"))

    @property
    def history(self) -> DataFrame:
        return self._history(self.table("lineitem"))

    @property
    def placed_history(self) -> DataFrame:
        """History with ``earlier``: the greater, the nearer to the start of the stored table. Rows of equal time and id need it to be told apart."""
        l = self.table("lineitem")
        files = sorted(l.inputFiles())
        row = F.col("_metadata.row_index")
        if len(files) > 1:
            names = [re.sub(r"^\w+:/*", "", f) for f in files]  # the two spell the root in different ways
            number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(names) for x in (f, i)]), F.regexp_replace("_metadata.file_path", r"^\w+:/*", ""))
            row = row + number.cast("long") * 2**40
        return self._history(l.withColumn("__row", row), (-F.col("__row")).alias("earlier"))

    def _history(self, lineitem: DataFrame, *more) -> DataFrame:
        l = lineitem.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id"), F.col("o_custkey").alias("patient_id"), F.col("l_returnflag").alias("field"), F.col("l_quantity").alias("value"), _ns("l_shipdate").alias("time_n"), *more)
