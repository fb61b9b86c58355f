"""Interval labels: queries, rasters on sample grids, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import ceil_div, floor_div
from . import intervals as iv
from . import joins


def find(
    labels: DataFrame,
    label_sets: DataFrame,
    names: list[str] | None = None,
    devices: list[int] | None = None,
    start_n: int | None = None,
    end_n: int | None = None,
    measure_id: int | None = None,
    label_source_id: int | None = None,
    include_descendants: bool = True,
    mapping: DataFrame | None = None,
    patients: list[int] | None = None,
    now_n: int = 2**62,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Labels by name (and the names below), devices or patients, and time (inclusive at both ends).

    By patient, a label counts where it overlaps the patient's mapping, and is cut to
    it. ``requested_id`` is the requested name that a label stands for. Order: start,
    end, id; limit and offset apply after it.
    """
    sets = label_sets.select("label_set_id", F.col("name").alias("label_name"))
    if names is None:
        out = labels.join(sets, "label_set_id").withColumn("requested_id", F.col("label_set_id"))
    else:
        wanted = label_sets.where(F.col("name").isin(names)).select("label_set_id")
        roots = joins.requested_roots(label_sets, wanted) if include_descendants else wanted.withColumn("requested_id", F.col("label_set_id"))
        out = labels.join(roots, "label_set_id").join(sets, "label_set_id")
    if devices is not None:
        out = out.where(F.col("device_id").isin(devices))
    if start_n is not None:
        out = out.where(F.col("end_n") >= start_n)
    if end_n is not None:
        out = out.where(F.col("start_n") <= end_n)
    if measure_id is not None:
        out = out.where(F.col("measure_id") == measure_id)
    if label_source_id is not None:
        out = out.where(F.col("label_source_id") == label_source_id)
    if patients is not None:
        spans = mapping.where(F.col("patient_id").isin(patients)).withColumn("end_n", joins.closed_end(F.col("end_n"), now_n))
        spans = iv.union(spans, ["device_id", "patient_id"])
        hit = joins.interval_join(out, spans, ["device_id"])
        out = hit.withColumn("start_n", F.greatest("start_n", "b_start_n")).withColumn("end_n", F.least("end_n", "b_end_n")).drop("b_start_n", "b_end_n")
    out = out.orderBy("start_n", "end_n", "label_id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def with_patient(labels: DataFrame, mapping: DataFrame, now_n: int) -> DataFrame:
    """Each label with the patient whose mapping contains it (null if none; least id if several)."""
    spans = mapping.select("device_id", "patient_id", "start_n", joins.closed_end(F.col("end_n"), now_n).alias("end_n"))
    wide = labels.withColumn("end_n", F.greatest("end_n", F.col("start_n") + 1))
    hit = joins.interval_join(wide.select("label_id", "device_id", "start_n", "end_n"), spans, ["device_id"]).where("start_n >= b_start_n and end_n <= b_end_n")
    one = hit.groupBy("label_id").agg(F.min("patient_id").alias("patient_id"))
    return labels.join(one, "label_id", "left")


def raster(grid: DataFrame, labels: DataFrame, keys: list[str], width_ns: int = iv.DAY_NS) -> DataFrame:
    """grid(keys, time_n) -> plus on: 1 where a label holds the time, both ends inclusive."""
    wide = labels.select(*keys, "start_n", (F.col("end_n") + 1).alias("end_n"))
    return joins.point_held(grid, iv.union(wide, keys), keys, width_ns).withColumn("on", F.col("__held").cast("int")).drop("__held")


def _flags(sources: DataFrame, labels: DataFrame, keys: list[str], start_n: int, end_n: int, period_ns: int) -> DataFrame:
    """keys, __f: a row a source with its raster on the regular grid in [start_n, end_n) as an array of 0 and 1.

    The grid points that a label holds come from arithmetic on its ends; each source's are an array of the
    grid's length at most.
    """
    n = ceil_div(F.lit(end_n) - start_n, period_ns)
    first = F.greatest(F.lit(0).cast("long"), ceil_div(F.col("start_n") - start_n, period_ns))
    last = F.least(n - 1, floor_div(F.col("end_n") - start_n, period_ns))
    marks = labels.where("start_n <= end_n").select(*keys, first.alias("__a"), last.alias("__b")).where("__a <= __b").distinct()
    points = marks.select(*keys, F.explode(F.sequence("__a", "__b")).alias("__p"))
    held = points.groupBy(*keys).agg(F.collect_set("__p").alias("__on"))
    rows = sources.join(held, keys, "left").withColumn("__on", F.sort_array("__on"))
    flags = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda p: F.coalesce(F.array_contains("__on", p), F.lit(False)).cast("int"))
    return rows.select(*keys, flags.alias("__f"))


def raster_of(sources: DataFrame, labels: DataFrame, keys: list[str], start_n: int, end_n: int, period_ns: int) -> DataFrame:
    """raster() of a regular grid in [start_n, end_n), the same for each of ``sources(keys)``: keys, time_n, on.

    The grid is unfolded last and is neither sorted nor exchanged.
    """
    rows = _flags(sources, labels, keys, start_n, end_n, period_ns)
    return rows.select(*keys, F.posexplode("__f").alias("__p", "on")).select(*keys, (F.lit(start_n) + F.col("__p").cast("long") * period_ns).alias("time_n"), "on")


def threshold_of(sources: DataFrame, labels: DataFrame, keys: list[str], start_n: int, end_n: int, period_ns: int, points: int, limit: float = 0.5) -> DataFrame:
    """threshold() of raster_of() in windows of so many grid points: keys, win, share, label, without unfolding the grid."""
    rows = _flags(sources, labels, keys, start_n, end_n, period_ns)
    n = F.call_function("div", F.size("__f") + (points - 1), F.lit(points)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.slice("__f", w * points + 1, points))
    rows = rows.select(*keys, F.posexplode(parts).alias("win", "__w"))
    share = F.aggregate("__w", F.lit(0), lambda a, x: a + x) / F.size("__w")
    return rows.select(*keys, F.col("win").cast("long").alias("win"), share.alias("share")).withColumn("label", F.when(F.col("share") > limit, 1).otherwise(0))


def threshold(rasters: DataFrame, keys: list[str], limit: float = 0.5) -> DataFrame:
    """keys, share, label: 1 where the mean of ``on`` is above the limit (strictly)."""
    return rasters.groupBy(*keys).agg(F.avg("on").alias("share")).withColumn("label", F.when(F.col("share") > limit, 1).otherwise(0))


def label_intervals(labels: DataFrame, tolerance: int = 0) -> DataFrame:
    return iv.union(labels, ["device_id", "label_set_id"], tolerance)


def label_durations(labels: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Time of each label name inside the ranges of each key, cut to the ranges."""
    hit = joins.interval_join(labels.select(*keys, "label_set_id", "start_n", "end_n"), ranges.select(*keys, "start_n", "end_n"), keys)
    shared = F.least("end_n", "b_end_n") - F.greatest("start_n", "b_start_n")
    return hit.groupBy(*keys, "label_set_id").agg(F.sum(shared).alias("duration_ns"))


def tree(label_sets: DataFrame, root_id: int, max_depth: int | None = None) -> dict:
    """Nested names below one name (dimension-sized, built on the driver)."""
    rows = joins.descendants(label_sets, max_depth).where(F.col("root_id") == root_id).select("label_set_id", "depth").join(label_sets, "label_set_id").collect()
    children: dict = {}
    for r in rows:
        if r["depth"]:
            children.setdefault(r["parent_id"], []).append(r)

    def below(key: int) -> dict:
        return {r["name"]: below(r["label_set_id"]) for r in sorted(children.get(key, []), key=lambda r: r["name"])}

    return below(root_id)
