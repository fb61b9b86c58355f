"""Value expressions: analog scaling, binary signals, bytes per value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def analog(raw: Column, scale_m: Column, scale_b: Column) -> Column:
    """raw * m + b; a slope of 0 (or null) means 1, a null offset 0."""
    m = F.when(F.coalesce(scale_m, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(scale_m)
    return raw.cast("double") * m + F.coalesce(scale_b, F.lit(0.0))


def bytes_per_value(low: Column, high: Column) -> Column:
    """The least of 1, 2, 4 or 8 bytes that hold both bounds as signed integers."""
    fits = lambda bits: (low >= -(2 ** (bits - 1))) & (high <= 2 ** (bits - 1) - 1)
    return F.when(fits(8), 1).when(fits(16), 2).when(fits(32), 4).otherwise(8)


def indices_to_binary(n: int, events: DataFrame) -> DataFrame:
    """(idx, signal): 1 at the indices of ``events(idx)``, else 0, for 0 <= idx < n."""
    spine = events.sparkSession.range(n).withColumnRenamed("id", "idx")
    marked = events.select(F.col("idx").cast("long").alias("idx")).distinct().withColumn("signal", F.lit(1))
    return spine.join(marked, "idx", "left").select("idx", F.coalesce("signal", F.lit(0)).alias("signal"))


def binary_to_indices(signal: DataFrame) -> DataFrame:
    return signal.where("signal = 1").select("idx")
