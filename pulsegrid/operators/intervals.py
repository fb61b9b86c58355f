"""Interval algebra on long tables ``keys.., start_n, end_n`` (half-open).

Merging is gaps-and-islands. Tables that may hold many rows for one key are first
merged inside (key, time chunk) groups, so that the second pass over a whole key
sees islands, not rows. Set operations sweep +1/-1 boundary events with running
sums; nothing compares pairs of intervals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.units import floor_div

DAY_NS = 86_400_000_000_000


def _merge(df: DataFrame, keys: list[str], tolerance: int | Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("start_n", "end_n")
    reach = F.max("end_n").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start_n") > reach + tolerance), 1).otherwise(0)
    numbered = df.select(*keys, "start_n", "end_n", opens.alias("__o")).withColumn("__g", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__g").agg(F.min("start_n").alias("start_n"), F.max("end_n").alias("end_n")).drop("__g")


def union(df: DataFrame, keys: list[str], tolerance: int = 0, chunk_ns: int | None = None) -> DataFrame:
    """Merge what overlaps, touches, or lies within ``tolerance``; empty intervals are dropped."""
    df = df.where("start_n < end_n").select(*keys, "start_n", "end_n")
    if chunk_ns:
        local = df.withColumn("__c", floor_div(F.col("start_n"), chunk_ns))
        df = _merge(local, [*keys, "__c"], tolerance).drop("__c")
    return _merge(df, keys, tolerance)


def union_all(tables: list[DataFrame], keys: list[str], tolerance: int = 0) -> DataFrame:
    return union(reduce(DataFrame.unionByName, [t.select(*keys, "start_n", "end_n") for t in tables]), keys, tolerance)


def _sweep(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """keys, start_n, end_n and one depth column d0, d1.. per table, between all boundaries."""
    n = len(tables)
    events = []
    for k, t in enumerate(tables):
        depth = [F.lit(1 if j == k else 0).alias(f"d{j}") for j in range(n)]
        minus = [F.lit(-1 if j == k else 0).alias(f"d{j}") for j in range(n)]
        rows = t.where("start_n < end_n")
        events += [rows.select(*keys, F.col("start_n").alias("at"), *depth), rows.select(*keys, F.col("end_n").alias("at"), *minus)]
    sums = reduce(DataFrame.unionByName, events).groupBy(*keys, "at").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(n)])
    w = W.partitionBy(*keys).orderBy("at")
    running = [F.sum(f"d{j}").over(w.rowsBetween(W.unboundedPreceding, 0)).alias(f"d{j}") for j in range(n)]
    return sums.select(*keys, F.col("at").alias("start_n"), F.lead("at").over(w).alias("end_n"), *running).where("end_n is not null")


def intersection(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Where all tables have an interval; touching results merge."""
    pieces = _sweep(tables, keys).where(" and ".join(f"d{j} > 0" for j in range(len(tables))))
    return _merge(pieces, keys, 0)


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _merge(_sweep([a, b], keys).where("d0 > 0 and d1 <= 0"), keys, 0)


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Between adjacent rows in order of start (zero-width where they touch)."""
    w = W.partitionBy(*keys).orderBy("start_n", "end_n")
    return df.select(*keys, F.col("end_n").alias("start_n"), F.lead("start_n").over(w).alias("end_n")).where("end_n is not null")


def duration(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("end_n") - F.col("start_n")).alias("duration_ns"), F.count("*").alias("n_intervals"))


def contains(df: DataFrame, time_n: int, keys: list[str]) -> DataFrame:
    hit = (F.col("start_n") <= time_n) & (F.col("end_n") > time_n)
    return df.groupBy(*keys).agg(F.max(hit).alias("contains"))


def any_overlap(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, overlaps: whether two intervals of a key share more than a boundary."""
    w = W.partitionBy(*keys).orderBy("start_n", "end_n").rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__r", F.max("end_n").over(w)).groupBy(*keys).agg(F.coalesce(F.max(F.col("start_n") < F.col("__r")), F.lit(False)).alias("overlaps"))


def clip(df: DataFrame, start_n: int | None, end_n: int | None) -> DataFrame:
    """Cut to [start_n, end_n); what is left empty is dropped."""
    s = F.col("start_n") if start_n is None else F.greatest("start_n", F.lit(start_n))
    e = F.col("end_n") if end_n is None else F.least("end_n", F.lit(end_n))
    return df.withColumn("__s", s).withColumn("__e", e).where("__s < __e").drop("start_n", "end_n").withColumnsRenamed({"__s": "start_n", "__e": "end_n"})


def shift(df: DataFrame, by_ns: int) -> DataFrame:
    return df.withColumn("start_n", F.col("start_n") + by_ns).withColumn("end_n", F.col("end_n") + by_ns)


def split(df: DataFrame, max_ns: int) -> DataFrame:
    """Cut into pieces of at most ``max_ns`` from each interval's start."""
    rows = df.where("start_n < end_n").withColumn("__s", F.explode(F.sequence(F.col("start_n"), F.col("end_n") - 1, F.lit(max_ns))))
    return rows.withColumn("end_n", F.least("end_n", F.col("__s") + max_ns)).withColumn("start_n", F.col("__s")).drop("__s")


def merge_touching(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge only rows whose start is exactly the end before it."""
    w = W.partitionBy(*keys).orderBy("start_n", "end_n")
    opens = F.when(F.lag("end_n").over(w) == F.col("start_n"), 0).otherwise(1)
    g = df.select(*keys, "start_n", "end_n", opens.alias("__o")).withColumn("__g", F.sum("__o").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy(*keys, "__g").agg(F.min("start_n").alias("start_n"), F.max("end_n").alias("end_n")).drop("__g")


def from_samples(samples: DataFrame, keys: list[str], period_ns: int | Column, tolerance: int = 0, chunk_ns: int = DAY_NS) -> DataFrame:
    """Coverage of timestamps: a new interval where the step exceeds one period (plus tolerance)."""
    cells = samples.select(*keys, F.col("time_n").alias("start_n"), (F.col("time_n") + period_ns).alias("end_n"))
    return union(cells, keys, tolerance, chunk_ns)


def coverage(samples: DataFrame, keys: list[str], period_ns: int, tolerance: int = 0, start_n: int | None = None, end_n: int | None = None) -> DataFrame:
    """Coverage clipped to the range, then merged within ``tolerance``."""
    return _merge(clip(from_samples(samples, keys, period_ns), start_n, end_n), keys, tolerance)


def by_strategy(tables: list[DataFrame], keys: list[str], strategy: str, tolerance: int = 0) -> DataFrame:
    """Cohort intervals of several measures or labels: their union or their intersection."""
    if strategy == "union":
        return union_all(tables, keys, tolerance)
    if strategy != "intersection":
        raise ValueError("strategy is union or intersection")
    return _merge(intersection([union(t, keys) for t in tables], keys), keys, tolerance)


def to_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_n", "end_n"))).alias("intervals"))
