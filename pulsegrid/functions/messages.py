"""Messages: rows (keys, start_n, n[, values]) of equally spaced samples, and gap arrays between them.

All functions are DataFrame plans over messages or runs, of which a signal has few beside its
samples; only functions that return samples make one row per sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import gaps
from .units import floor_div


def decode_in_samples(starts: DataFrame, gap_samples: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, idx, time_n from gaps that are counted in whole periods."""
    in_ns = gap_samples.select(*keys, "idx", (F.col("gap_samples") * period_ns).alias("gap_ns"))
    return gaps.decode(starts, in_ns, keys, period_ns)


def variable_gaps(messages: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, idx, gap_ns between messages of any sizes, in order of start."""
    w = W.partitionBy(*keys).orderBy("start_n")
    ends = F.col("start_n") + F.col("n") * period_ns
    rows = messages.withColumn("gap_ns", F.col("start_n") - F.lag(ends).over(w))
    rows = rows.withColumn("idx", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)))
    return rows.where("gap_ns <> 0").select(*keys, "idx", "gap_ns")


def from_gaps(starts: DataFrame, gap_rows: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, start_n, n: the messages that a gap array stands for; with the block among ``keys``
    each block's array is its own."""
    return gaps.to_intervals(starts, gap_rows, keys, period_ns).select(*keys, "start_n", "n")


def sort_values(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, no, start_n, n, values in order of start; equal starts keep the order of ``pos``."""
    no = F.row_number().over(W.partitionBy(*keys).orderBy("start_n", "pos")) - 1
    return messages.select(*keys, no.cast("long").alias("no"), "start_n", F.size("values").cast("long").alias("n"), "values")


def contiguous(messages: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, start_n, n: messages joined where one starts exactly where the one before ends."""
    w = W.partitionBy(*keys).orderBy("start_n")
    ends = F.col("start_n") + F.col("n") * period_ns
    rows = messages.withColumn("fresh", F.coalesce((F.col("start_n") != F.lag(ends).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("fresh").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("start_n").alias("start_n"), F.sum("n").alias("n")).drop("run")


def to_intervals(messages: DataFrame, keys: list[str], period_ns: Column, tolerance: int = 0) -> DataFrame:
    """keys, start_n, end_n: messages merged where one starts at or before the latest end so far plus the tolerance."""
    w = W.partitionBy(*keys).orderBy("start_n", "end_n")
    rows = messages.withColumn("end_n", F.col("start_n") + F.col("n") * period_ns)
    before = F.max("end_n").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce((F.col("start_n") > before + tolerance).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("fresh").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("start_n").alias("start_n"), F.max("end_n").alias("end_n")).drop("run")


def close_gaps(intervals: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """keys, start_n, end_n: intervals joined over gaps of at most ``tolerance``; the latest end counts."""
    return to_intervals(intervals.select(*keys, "start_n", (F.col("end_n") - F.col("start_n")).alias("n")), keys, F.lit(1), tolerance)


def merge_samples(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "new") -> DataFrame:
    """keys, time_n, value of two sample tables; where both have a time, ``keep`` (``old`` or ``new``) says which stays."""
    if keep not in ("old", "new"):
        raise ValueError(f"unknown side {keep!r}")
    side = lambda df, n: df.select(*keys, "time_n", "value", F.lit(n).alias("side"))
    both = side(old, 0).unionByName(side(new, 1))
    pick = F.max_by if keep == "new" else F.min_by
    return both.groupBy(*keys, "time_n").agg(pick("value", "side").alias("value"))


def merge_gap_data(old: DataFrame, new: DataFrame, keys: list[str], period_ns: Column, keep: str = "new") -> tuple[DataFrame, DataFrame]:
    """(samples, gaps) of two sample tables on one time line: merged samples and the gap array of all of them."""
    merged = merge_samples(old, new, keys, keep)
    return merged, gaps.encode(merged, keys, period_ns)


def concatenate(first: DataFrame, first_gaps: DataFrame, second: DataFrame, second_gaps: DataFrame, keys: list[str], period_ns: Column) -> tuple[DataFrame, DataFrame]:
    """(starts, gaps) of two disjoint stretches, one after the other: starts(keys, start_n, n) each with its gap array."""
    a = gaps.end_time(first, first_gaps, keys, period_ns).join(first.select(*keys, F.col("n").alias("n1"), F.col("start_n").alias("s1")), keys)
    both = a.join(second.select(*keys, F.col("n").alias("n2"), F.col("start_n").alias("s2")), keys)
    seam = both.where("s2 <> end_n").select(*keys, F.col("n1").alias("idx"), (F.col("s2") - F.col("end_n")).alias("gap_ns"))
    moved = second_gaps.join(both.select(*keys, "n1"), keys).select(*keys, (F.col("idx") + F.col("n1")).alias("idx"), "gap_ns")
    return both.select(*keys, F.col("s1").alias("start_n"), (F.col("n1") + F.col("n2")).alias("n")), first_gaps.select(*keys, "idx", "gap_ns").unionByName(seam).unionByName(moved)


def merge_messages(old: DataFrame, new: DataFrame, keys: list[str], period_ns: Column, slack_ns: int = 0) -> DataFrame:
    """keys, time_n, value: samples of two message tables (keys, start_n, values); of samples of
    which the times round to one slot of ``slack_ns`` (else are equal) the new one stays."""
    times = lambda df: gaps.messages_to_samples(df, keys, period_ns)
    if not slack_ns:
        return merge_samples(times(old), times(new), keys)
    slot = floor_div(F.col("time_n") + slack_ns // 2, slack_ns)
    both = times(old).withColumn("side", F.lit(0)).unionByName(times(new).withColumn("side", F.lit(1)))
    best = both.groupBy(*keys, slot.alias("slot")).agg(F.max_by(F.struct("time_n", "value"), F.struct("side", "time_n")).alias("x"))
    return best.select(*keys, "x.time_n", "x.value")


def interleave(first: DataFrame, second: DataFrame, keys: list[str], period_ns: Column) -> DataFrame:
    """keys, start_n, values: single-sample messages of two out-of-phase messages, in order of time."""
    rows = gaps.messages_to_samples(first, keys, period_ns).unionByName(gaps.messages_to_samples(second, keys, period_ns))
    return rows.select(*keys, F.col("time_n").alias("start_n"), F.array("value").alias("values")).orderBy(*keys, "start_n")


def written_intervals(rows: DataFrame, keys: list[str], period_ns: Column, kind: str) -> DataFrame:
    """Coverage of a raw write. ``kind``: ``times`` (time_n rows), ``messages`` (start_n, n) or
    ``runs`` (start_n, end_n)."""
    if kind == "times":
        rows = rows.select(*keys, F.col("time_n").alias("start_n"), F.lit(1).cast("long").alias("n"))
    elif kind == "runs":
        return close_gaps(rows, keys, 0)
    elif kind != "messages":
        raise ValueError(f"unknown kind {kind!r}")
    return to_intervals(rows, keys, period_ns)


def split_at(messages: DataFrame, keys: list[str], period_ns: Column, values_per_block: int) -> DataFrame:
    """keys, block, start_n, n: messages cut where the signal's running count fills a block."""
    w = W.partitionBy(*keys).orderBy("start_n").rowsBetween(W.unboundedPreceding, -1)
    rows = messages.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 0")
    last = floor_div(F.col("before") + F.col("n") - 1, values_per_block)
    rows = rows.withColumn("block", F.explode(F.sequence(floor_div(F.col("before"), values_per_block), last)))
    low = F.greatest(F.col("block") * values_per_block, F.col("before"))
    high = F.least((F.col("block") + 1) * values_per_block, F.col("before") + F.col("n"))
    return rows.select(*keys, "block", (F.col("start_n") + (low - F.col("before")) * period_ns).alias("start_n"), (high - low).alias("n"))


def block_starts(starts: DataFrame, gap_rows: DataFrame, keys: list[str], period_ns: Column, values_per_block: int) -> DataFrame:
    """keys, block, start_n, gap_ns: where each block of a gap-coded signal starts, and the gaps up to there."""
    blocks = starts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), floor_div(F.col("n") - 1, values_per_block))))
    blocks = blocks.withColumn("at", F.col("block") * values_per_block)
    # one running sum over gaps and block marks: a mark sees the gaps at or before its index
    marks = blocks.select(*keys, F.col("at").alias("idx"), F.lit(0).cast("long").alias("gap_ns"), "block", "start_n")
    both = gap_rows.select(*keys, "idx", "gap_ns", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("start_n")).unionByName(marks)
    upto = F.sum("gap_ns").over(W.partitionBy(*keys).orderBy("idx"))
    both = both.withColumn("total", upto).where("block is not null")
    return both.select(*keys, "block", (F.col("start_n") + F.col("idx") * period_ns + F.col("total")).alias("start_n"), F.col("total").alias("gap_ns"))
