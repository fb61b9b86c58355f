"""Gap arrays: runs of equally spaced samples as (index, extra nanoseconds) pairs.

Encoders work on rows ``key.., idx, time_n``; decoders turn the pairs back. The running
sums are windows over one signal, whose gaps are few even where its samples are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .units import floor_div


def encode(samples: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, idx, gap_ns: where the step to the sample at ``idx`` is not one period."""
    w = W.partitionBy(*keys).orderBy("time_n")
    rows = samples.withColumn("idx", F.row_number().over(w) - 1).withColumn("gap_ns", F.col("time_n") - F.lag("time_n").over(w) - period_ns)
    return rows.where("gap_ns <> 0").select(*keys, F.col("idx").cast("long").alias("idx"), "gap_ns")


def encode_in_samples(samples: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, idx, gap_samples: the gaps in whole periods (rounded down)."""
    return encode(samples, keys, period_ns).withColumn("gap_samples", floor_div(F.col("gap_ns"), period_ns)).drop("gap_ns")


def decode(starts: DataFrame, gaps: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """starts(keys, start_n, n) and gaps(keys, idx, gap_ns) -> keys, idx, time_n."""
    w = W.partitionBy(*keys).orderBy("idx")
    bounds = gaps.select(*keys, "idx", F.sum("gap_ns").over(w).alias("shift"), F.lead("idx").over(w).alias("until"))
    first = starts.select(*keys, F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("shift"))
    ends = starts.select(*keys, "start_n", "n")
    least = gaps.groupBy(*keys).agg(F.min("idx").alias("until"))
    head = first.join(least, keys, "left")
    runs = head.unionByName(bounds).join(ends, keys).withColumn("until", F.coalesce("until", "n")).where("until > idx")
    rows = runs.withColumn("i", F.explode(F.sequence(F.col("idx"), F.col("until") - 1)))
    return rows.select(*keys, F.col("i").alias("idx"), (F.col("start_n") + F.col("i") * period_ns + F.col("shift")).alias("time_n"))


def to_intervals(starts: DataFrame, gaps: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, start_n, end_n, n: the runs between gaps; an end is one period after the last sample."""
    w = W.partitionBy(*keys).orderBy("idx")
    runs = gaps.select(*keys, "idx", "gap_ns").unionByName(starts.select(*keys, F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("gap_ns")))
    runs = runs.groupBy(*keys, "idx").agg(F.sum("gap_ns").alias("gap_ns"))
    runs = runs.withColumn("shift", F.sum("gap_ns").over(w)).withColumn("until", F.lead("idx").over(w)).join(starts.select(*keys, "start_n", F.col("n").alias("total")), keys)
    until = F.coalesce("until", "total")
    start = F.col("start_n") + F.col("idx") * period_ns + F.col("shift")
    return runs.select(*keys, start.alias("start_n"), (start + (until - F.col("idx")) * period_ns).alias("end_n"), (until - F.col("idx")).alias("n"))


def from_intervals(intervals: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """Inverse of to_intervals: keys, idx, gap_ns from rows keys, start_n, end_n, n."""
    w = W.partitionBy(*keys).orderBy("start_n")
    rows = intervals.withColumn("gap_ns", F.col("start_n") - F.lag("end_n").over(w)).withColumn("idx", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)))
    return rows.where("gap_ns is not null and gap_ns <> 0").select(*keys, "idx", "gap_ns")


def from_messages(messages: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """messages(keys, start_n, n) of equally spaced samples -> keys, idx, gap_ns."""
    return from_intervals(messages.withColumn("end_n", F.col("start_n") + F.col("n") * period_ns), keys, period_ns)


def messages_to_samples(messages: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """messages(keys, start_n, values) -> keys, time_n, value."""
    rows = messages.select(*keys, "start_n", F.posexplode("values").alias("pos", "value"))
    return rows.select(*keys, (F.col("start_n") + F.col("pos") * period_ns).alias("time_n"), "value")


def truncate_messages(samples: DataFrame, start_n: int, end_n: int) -> DataFrame:
    return samples.where((F.col("time_n") >= start_n) & (F.col("time_n") < end_n))


def is_ordered(gaps: DataFrame, period_ns: int) -> bool:
    """Whether no step goes back: all gaps are at least minus one period."""
    low = gaps.agg(F.min("gap_ns").alias("m")).first()["m"]
    return low is None or low >= -period_ns


def end_time(starts: DataFrame, gaps: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, end_n: start + n periods + all gaps."""
    total = gaps.groupBy(*keys).agg(F.sum("gap_ns").alias("g"))
    return starts.join(total, keys, "left").select(*keys, (F.col("start_n") + F.col("n") * period_ns + F.coalesce("g", F.lit(0))).alias("end_n"))


def detect_period(samples: DataFrame, keys: list[str], default_ns: int = 1_000_000_000) -> DataFrame:
    """keys, period_ns: the most frequent positive step, the least on ties; ``default_ns`` below two times."""
    w = W.partitionBy(*keys).orderBy("time_n")
    steps = samples.select(*keys, (F.col("time_n") - F.lag("time_n").over(w)).alias("step"))
    counts = steps.where("step > 0").groupBy(*keys, "step").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("period_ns"))
    every = samples.select(*keys).distinct()
    return every.join(best, keys, "left").select(*keys, F.coalesce("period_ns", F.lit(default_ns)).cast("long").alias("period_ns"))
