"""Sliding windows over source ranges, with slots, labels and as-of patient values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.units import ceil_div, floor_div
from . import joins


def enumerate_windows(ranges: DataFrame, duration_ns: int, slide_ns: int, full_only: bool = False) -> DataFrame:
    """ranges(keys.., start_n, end_n) -> plus window_start_n, window_end_n, window_no in the range.

    Starts are start + k * slide below the end; the last windows may be partial
    unless ``full_only``.
    """
    last = F.col("end_n") - duration_ns if full_only else F.col("end_n") - 1
    starts = F.when(last >= F.col("start_n"), F.sequence(F.col("start_n"), F.greatest(F.col("start_n"), last), F.lit(slide_ns)))
    rows = ranges.select("*", F.posexplode(starts).alias("window_no", "window_start_n"))
    return rows.withColumn("window_end_n", F.col("window_start_n") + duration_ns)


def count_windows(duration_ns: int, slide_ns: int, full_only: bool = False) -> Column:
    """Closed form of the number of windows of a range."""
    if full_only:
        return F.when(F.col("end_n") - F.col("start_n") >= duration_ns, floor_div(F.col("end_n") - F.col("start_n") - duration_ns, slide_ns) + 1).otherwise(0).cast("long")
    return F.when(F.col("end_n") > F.col("start_n"), floor_div(F.col("end_n") - 1 - F.col("start_n"), slide_ns) + 1).otherwise(0).cast("long")


def light_index(ranges: DataFrame, keys: list[str], duration_ns: int, slide_ns: int, full_only: bool = False) -> DataFrame:
    """Ranges with first_idx, n_windows: global window numbers in order of keys and start.

    A running sum over ranges (not windows): one row per source range.
    """
    counted = ranges.withColumn("n_windows", count_windows(duration_ns, slide_ns, full_only))
    w = W.orderBy(*keys, "start_n").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("first_idx", F.coalesce(F.sum("n_windows").over(w), F.lit(0)))


def window_at(index: DataFrame, idx: int, duration_ns: int, slide_ns: int) -> DataFrame:
    """The window of a global number (negative counts from the end)."""
    if idx < 0:
        idx += index.agg(F.sum("n_windows")).first()[0] or 0
    row = index.where((F.col("first_idx") <= idx) & (F.col("first_idx") + F.col("n_windows") > idx))
    start = F.col("start_n") + (idx - F.col("first_idx")) * slide_ns
    return row.withColumn("window_idx", F.lit(idx)).withColumn("window_start_n", start).withColumn("window_end_n", F.least(start + duration_ns, F.col("end_n")))


def slots(windows: DataFrame, samples: DataFrame, keys: list[str], period_ns: int, width_ns: int | None = None) -> DataFrame:
    """keys, window_start_n, slot, value: samples on each window's grid; later samples win.

    Only slots with a sample have rows; a window covers [start, min(end, range end)).
    """
    spans = windows.select(*keys, F.col("window_start_n").alias("start_n"), F.least("window_end_n", "end_n").alias("end_n"), F.col("window_start_n"), F.col("window_end_n"))
    hit = joins.point_join(samples, spans, keys, width_ns or joins.DAY_NS)
    slot = F.bround((F.col("time_n") - F.col("window_start_n")).cast("decimal(38,6)") / F.lit(period_ns), 0).cast("long")
    n = floor_div(F.col("window_end_n") - F.col("window_start_n"), period_ns)
    return hit.withColumn("slot", slot).where(F.col("slot") < n).groupBy(*keys, "window_start_n", "slot").agg(F.max_by("value", "time_n").alias("value"))


def matrix(windows: DataFrame, samples: DataFrame, keys: list[str], duration_ns: int, period_ns: int) -> DataFrame:
    """keys, window_start_n, expected_count, actual_count, values (NaN where no sample)."""
    n = duration_ns // period_ns
    held = slots(windows, samples, keys, period_ns).groupBy(*keys, "window_start_n").agg(F.count(F.when(~F.isnan("value"), 1)).alias("actual_count"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    out = windows.select(*keys, "window_start_n").join(held, [*keys, "window_start_n"], "left")
    values = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(float("nan"))))
    return out.select(*keys, "window_start_n", F.lit(n).cast("long").alias("expected_count"), F.coalesce("actual_count", F.lit(0)).cast("long").alias("actual_count"), values.alias("values"))


def signals(windows: DataFrame, samples: DataFrame, measures: DataFrame, duration_ns: int) -> DataFrame:
    """device_id, window_start_n, signals: one struct per measure, each on its own period."""
    periods = [(r["measure_id"], r["tag"], r["period_ns"], r["unit"]) for r in measures.orderBy("measure_id").select("measure_id", "tag", "period_ns", "unit").collect()]
    out = windows.select("device_id", "window_start_n").distinct()
    columns = []
    for mid, tag, period, unit in periods:
        one = matrix(windows, samples.where(F.col("measure_id") == mid), ["device_id"], duration_ns, period)
        name = f"__m{mid}"
        packed = F.struct(F.lit(mid).alias("measure_id"), F.lit(tag).alias("tag"), F.lit(period).alias("period_ns"), F.lit(unit).alias("unit"), "expected_count", "actual_count", "values")
        out = out.join(one.select("device_id", "window_start_n", packed.alias(name)), ["device_id", "window_start_n"], "left")
        columns.append(F.col(name))
    return out.select("device_id", "window_start_n", F.array(*columns).alias("signals"))


def label_windows(windows: DataFrame, labels: DataFrame, keys: list[str], duration_ns: int, period_ns: int, limit: float = 0.5) -> DataFrame:
    """keys, window_start_n, label_set_id, share, label: raster share above the limit.

    Shares come from counts of grid points inside each label's intervals, which are
    found by arithmetic; the grid itself is never built.
    """
    from . import intervals as iv

    n = duration_ns // period_ns
    marks = iv.union(labels.select(*keys, "label_set_id", "start_n", (F.col("end_n") + 1).alias("end_n")), [*keys, "label_set_id"])
    spans = windows.select(*keys, F.col("window_start_n"), F.col("window_start_n").alias("start_n"), (F.col("window_start_n") + n * period_ns).alias("end_n"))
    hit = joins.interval_join(spans, marks, keys)
    first = ceil_div(F.greatest(F.lit(0), F.col("b_start_n") - F.col("window_start_n")), period_ns)
    last = floor_div(F.least(F.col("end_n"), F.col("b_end_n")) - 1 - F.col("window_start_n"), period_ns)
    points = hit.withColumn("__n", F.greatest(F.lit(0), last - first + 1)).groupBy(*keys, "window_start_n", "label_set_id").agg((F.sum("__n") / n).alias("share"))
    return points.withColumn("label", F.when(F.col("share") > limit, 1).otherwise(0))


def with_patient_values(windows: DataFrame, history: DataFrame, field: str, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """The newest value of ``field`` at each window's start; of several the one with the greatest ``ties``."""
    rows = history.where(F.col("field") == field).select("patient_id", F.col("time_n").alias("__at"), F.col("value").alias(field), *[F.col(t).alias(f"__{t}") for t in ties])
    return joins.as_of(windows, rows, ["patient_id"], "window_start_n", "__at", [field], [f"__{t}" for t in ties])


def shuffled(windows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A seeded order: by a hash of the seed and the window, the same on every run."""
    return windows.orderBy(F.xxhash64(F.lit(seed), *keys, "window_start_n"), *keys, "window_start_n")


def accepted_ranges(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows that a filter left, merged to ranges."""
    from . import intervals as iv

    return iv.union(windows.select(*keys, F.col("window_start_n").alias("start_n"), F.least("window_end_n", "end_n").alias("end_n")), keys)
