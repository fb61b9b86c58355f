"""Block form of samples: runs of values with a header, as rows of a table.

A block holds ``size`` values of one signal, the last of a chunk up to twice as many
less one. Blocks never cross a time chunk, so numbering them is a window over one
chunk, whatever a signal's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.units import floor_div
from ..operators.intervals import DAY_NS


def encode(samples: DataFrame, keys: list[str], size: int = 131_072, chunk_ns: int = 30 * DAY_NS) -> DataFrame:
    """keys, chunk, block, start_n, end_n, num_vals, v_min, v_max, times, values."""
    parted = [*keys, "chunk"]
    rows = samples.withColumn("chunk", floor_div(F.col("time_n"), chunk_ns))
    w = W.partitionBy(*parted)
    rows = rows.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy("time_n")) - 1)
    last = F.greatest(F.lit(1), floor_div(F.col("__n"), size)) - 1
    rows = rows.withColumn("block", F.least(floor_div(F.col("__r").cast("long"), size), last))
    out = rows.groupBy(*parted, "block").agg(F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.sort_array(F.collect_list(F.struct("time_n", "value"))).alias("v"))
    times, values = F.col("v.time_n"), F.col("v.value")
    return out.select(*parted, "block", F.array_min(times).alias("start_n"), F.array_max(times).alias("end_n"), F.size("v").cast("long").alias("num_vals"), "v_min", "v_max", times.alias("times"), values.alias("values"))


def decode(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, time_n, value."""
    pairs = F.explode(F.arrays_zip("times", "values")).alias("p")
    return blocks.select(*keys, pairs).select(*keys, F.col("p.times").alias("time_n"), F.col("p.values").alias("value"))


def time_deltas(blocks: DataFrame) -> DataFrame:
    """Blocks with ``times`` as a start and steps, and whether all steps are equal."""
    steps = F.transform(F.sequence(F.lit(1), F.size("times") - 1), lambda i: F.get("times", i) - F.get("times", i - 1))
    out = blocks.withColumn("steps", F.when(F.size("times") > 1, steps).otherwise(F.expr("cast(array() as array<bigint>)")))
    return out.withColumn("regular", F.size(F.array_distinct("steps")) <= 1)


def header_groups(headers: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Consecutive headers with equal ``same`` columns: keys, same, start_n, end_n, n_blocks."""
    w = W.partitionBy(*keys).orderBy("start_n", "end_n")
    change = F.lit(False)
    for c in same:
        change = change | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    rows = headers.withColumn("__o", F.when(change | (F.row_number().over(w) == 1), 1).otherwise(0))
    rows = rows.withColumn("__g", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, *same, "__g").agg(F.min("start_n").alias("start_n"), F.max("end_n").alias("end_n"), F.count("*").alias("n_blocks")).drop("__g")
