"""Interval, point and as-of joins, source mapping and label hierarchies.

Interval joins turn ranges into equi-joins: both sides are dealt to time buckets, and
a pair is kept in the one bucket where the later start lies, so no pair repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.units import floor_div
from . import intervals as iv

DAY_NS = iv.DAY_NS


def _bucketed(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    low, high = floor_div(F.col(start), width), floor_div(F.col(end) - 1, width)
    return df.where(F.col(start) < F.col(end)).withColumn(name, F.explode(F.sequence(low, F.greatest(low, high))))


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], width_ns: int = 7 * DAY_NS) -> DataFrame:
    """Pairs of equal keys that share time: the columns of both, b's times as b_start_n, b_end_n."""
    right = b.withColumnsRenamed({"start_n": "b_start_n", "end_n": "b_end_n"})
    x = _bucketed(a, "start_n", "end_n", width_ns, "__k")
    y = _bucketed(right, "b_start_n", "b_end_n", width_ns, "__k")
    joined = x.join(y, [*keys, "__k"]).where("start_n < b_end_n and b_start_n < end_n")
    return joined.where(F.col("__k") == floor_div(F.greatest("start_n", "b_start_n"), width_ns)).drop("__k")


def point_join(points: DataFrame, b: DataFrame, keys: list[str], width_ns: int = 7 * DAY_NS) -> DataFrame:
    """Rows of ``points(time_n)`` with every interval of b that holds them: start <= t < end."""
    y = _bucketed(b, "start_n", "end_n", width_ns, "__k")
    x = points.withColumn("__k", floor_div(F.col("time_n"), width_ns))
    return x.join(y, [*keys, "__k"]).where("start_n <= time_n and time_n < end_n").drop("__k")


def point_held(points: DataFrame, b: DataFrame, keys: list[str], width_ns: int = 7 * DAY_NS) -> DataFrame:
    """Each row of ``points(time_n)`` once with __held: whether an interval of b holds it; those of a key lie apart."""
    y = _bucketed(b, "start_n", "end_n", width_ns, "__k").select(*keys, "__k", F.col("start_n").alias("__s"), F.col("end_n").alias("__e"))
    x = points.withColumn("__k", floor_div(F.col("time_n"), width_ns))
    same = [x[k] == y[k] for k in [*keys, "__k"]]
    hit = x.join(y, [*same, x["time_n"] >= y["__s"], x["time_n"] < y["__e"]], "left")
    return hit.select(*[x[c] for c in points.columns], y["__s"].isNotNull().alias("__held"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], ties: list[str] = ()) -> DataFrame:
    """Each left row with the newest right row at or before it (null values if none).

    One union and one window; no pair is built. Ties on time take the greatest ``ties``.
    """
    data = F.struct(*[F.col(v) for v in values])
    l = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(ties)], F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit(None).cast(right.select(data.alias("d")).schema["d"].dataType).alias("__r"))
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(ties)], F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), data.alias("__r"))
    w = W.partitionBy(*keys).orderBy("__t", "__side", *[f"__tie{i}" for i in range(len(ties))]).rowsBetween(W.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__v", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__l.*", *[F.col(f"__v.{v}").alias(v) for v in values])


def closed_end(end: Column, now_n: int) -> Column:
    return F.coalesce(end, F.lit(now_n))


def mapping_range(mapping: DataFrame, start_n: int, end_n: int) -> DataFrame:
    """Mapping rows that overlap the range; a null end is open."""
    return mapping.where((F.col("end_n").isNull() | (F.col("end_n") > start_n)) & (F.col("start_n") < end_n))


def group_ranges(mapping: DataFrame) -> DataFrame:
    """device_id, patient_id, ranges: the ranges of each pair in order of their starts."""
    return mapping.groupBy("device_id", "patient_id").agg(F.sort_array(F.collect_list(F.struct("start_n", "end_n"))).alias("ranges"))


def by_first_start(ranges: DataFrame, key: str) -> DataFrame:
    """Sources in the order of their first range's start: key, first_n."""
    return ranges.groupBy(key).agg(F.min("start_n").alias("first_n")).orderBy("first_n", key)


def mapping_at(mapping: DataFrame, time_n: int) -> DataFrame:
    return mapping.where((F.col("start_n") <= time_n) & (F.col("end_n").isNull() | (F.col("end_n") > time_n)))


def mapping_truncated(mapping: DataFrame, start_n: int, end_n: int, now_n: int) -> DataFrame:
    """Overlapping rows, open ends closed at ``now_n``, cut to the range."""
    rows = mapping_range(mapping, start_n, end_n).withColumn("end_n", closed_end(F.col("end_n"), now_n))
    return iv.clip(rows, start_n, end_n)


def convert_source(mapping: DataFrame, source: str, target: str, ranges: DataFrame, policy: str = "error", now_n: int = 2**62) -> DataFrame:
    """The one target whose merged mapping holds each range of ``ranges(source, q_start, q_end)``.

    ``policy`` for several holders, or none: ``error`` raises when there are several;
    ``90_percent_overlap`` takes a target that covers at least 90 % of the range;
    ``always_none`` gives null. Result: ranges plus ``target`` (null if none).
    """
    merged = iv.union(mapping.withColumn("end_n", closed_end(F.col("end_n"), now_n)), [source, target])
    rows = ranges.withColumn("__q", F.monotonically_increasing_id()).join(merged, source)
    shared = F.least("end_n", "q_end") - F.greatest("start_n", "q_start")
    rows = rows.where(shared > 0).withColumn("__share", shared / (F.col("q_end") - F.col("q_start")))
    holds = (F.col("start_n") <= F.col("q_start")) & (F.col("end_n") >= F.col("q_end"))
    best = rows.groupBy(source, "q_start", "q_end").agg(
        F.count_distinct(F.when(holds, F.col(target))).alias("__n"), F.max(F.when(holds, F.col(target))).alias("__held"), F.max_by(target, F.struct("__share", target)).alias("__most"), F.max("__share").alias("__share")
    )
    if policy == "error":
        if not best.where("__n > 1").isEmpty():
            raise ValueError(f"a range maps to more than one {target}")
        found = F.col("__held")
    elif policy == "90_percent_overlap":
        found = F.when(F.col("__n") == 1, F.col("__held")).when(F.col("__share") >= 0.9, F.col("__most"))
    elif policy == "always_none":
        found = F.when(F.col("__n") == 1, F.col("__held"))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return ranges.join(best.select(source, "q_start", "q_end", found.alias(target)), [source, "q_start", "q_end"], "left")


def map_sources(ranges: DataFrame, mapping: DataFrame, now_n: int) -> DataFrame:
    """Device ranges cut by the device-patient mapping: device_id, patient_id, start_n, end_n.

    What no mapping covers stays with a null patient_id.
    """
    closed = mapping.select("device_id", "patient_id", "start_n", closed_end(F.col("end_n"), now_n).alias("end_n"))
    hit = interval_join(ranges.select("device_id", "start_n", "end_n"), closed, ["device_id"])
    mapped = hit.select("device_id", "patient_id", F.greatest("start_n", "b_start_n").alias("start_n"), F.least("end_n", "b_end_n").alias("end_n"))
    mapped = iv.union(mapped, ["device_id", "patient_id"])
    rest = iv.difference(ranges, closed, ["device_id"]).select("device_id", F.lit(None).cast("long").alias("patient_id"), "start_n", "end_n")
    return mapped.unionByName(rest)


def encounters_where(encounters: DataFrame, time_n: int | None = None, start_n: int | None = None, end_n: int | None = None, bed_id: int | None = None, patient_id: int | None = None) -> DataFrame:
    out = mapping_at(encounters, time_n) if time_n is not None else encounters
    if start_n is not None:
        out = out.where(F.col("end_n").isNull() | (F.col("end_n") > start_n))
    if end_n is not None:
        out = out.where(F.col("start_n") < end_n)
    out = out if bed_id is None else out.where(F.col("bed_id") == bed_id)
    return out if patient_id is None else out.where(F.col("patient_id") == patient_id)


def encounter_fanout(encounters: DataFrame, devices: DataFrame, block: int = 65_536, spread: int = 16) -> DataFrame:
    """device_id, patient_id, encounter_id, start_n, end_n of the static devices in each bed.

    The result has encounters x devices / beds rows. Encounters meet arrays of a bed's devices, each of at
    most ``block`` ids, which are unfolded last; nothing but the arrays is held. A bed's encounters are dealt
    to ``spread`` groups, so that few beds do not bound the number of tasks.
    """
    static = devices.where("type = 'static'").groupBy("bed_id", floor_div(F.col("device_id"), block).alias("__b")).agg(F.collect_list("device_id").alias("__d"))
    static = static.withColumn("__s", F.explode(F.array(*[F.lit(k).cast("long") for k in range(spread)])))
    dealt = encounters.withColumnRenamed("id", "encounter_id").withColumn("__s", F.pmod(F.xxhash64("encounter_id"), F.lit(spread)))
    return dealt.join(static, ["bed_id", "__s"]).select(F.explode("__d").alias("device_id"), "patient_id", "encounter_id", "start_n", "end_n")


def descendants(label_sets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root_id, label_set_id, depth: every name below each name, itself at depth 0.

    Level by level; the number of joins is the depth of the forest.
    """
    edges = label_sets.where("parent_id is not null").select(F.col("parent_id").alias("__p"), F.col("label_set_id").alias("__c"))
    level = label_sets.select(F.col("label_set_id").alias("root_id"), "label_set_id", F.lit(0).alias("depth"))
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(edges, level["label_set_id"] == edges["__p"]).select("root_id", F.col("__c").alias("label_set_id"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def ancestors(label_sets: DataFrame) -> DataFrame:
    """label_set_id, ancestor_id, depth (1 is the parent)."""
    return descendants(label_sets).where("depth > 0").select("label_set_id", F.col("root_id").alias("ancestor_id"), "depth")


def requested_roots(label_sets: DataFrame, requested: DataFrame) -> DataFrame:
    """label_set_id, requested_id: the nearest requested name at or above each name."""
    below = descendants(label_sets).join(requested.select(F.col("label_set_id").alias("root_id")), "root_id", "left_semi")
    return below.groupBy("label_set_id").agg(F.min_by("root_id", F.struct("depth", "root_id")).alias("requested_id"))
