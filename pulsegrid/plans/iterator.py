"""From validated ranges to windows with signals, labels and patient values, and their iteration.

All measures are joined to the windows in one pass: a sample meets its windows once and its slot
follows from its measure's own period. A window is one row; nothing is collected but by ``batches``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import floor_div
from ..operators import joins, windows
from ..operators import intervals as iv


def window_slots(wins: DataFrame, samples: DataFrame, measures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, window_start_n, measure_id, slot, value of all measures; of samples in one slot the latest stays."""
    spans = wins.select(*keys, F.col("window_start_n").alias("start_n"), F.least("window_end_n", "end_n").alias("end_n"), "window_start_n", "window_end_n")
    timed = samples.join(measures.select("measure_id", "period_ns"), "measure_id")
    hit = joins.point_join(timed, spans, keys, joins.DAY_NS)
    slot = F.bround((F.col("time_n") - F.col("window_start_n")).cast("decimal(38,6)") / F.col("period_ns"), 0).cast("long")
    inside = hit.withColumn("slot", slot).where(F.col("slot") < floor_div(F.col("window_end_n") - F.col("window_start_n"), F.col("period_ns")))
    return inside.groupBy(*keys, "window_start_n", "measure_id", "slot").agg(F.max_by("value", "time_n").alias("value"))


def windows_of(
    ranges: DataFrame, samples: DataFrame, measures: DataFrame, duration_ns: int, slide_ns: int, *, gap_tolerance_ns: int = 0, full_only: bool = False, labels: DataFrame | None = None,
    label_period_ns: int | None = None, label_threshold: float = 0.5, history: DataFrame | None = None, fields: tuple[str, ...] = (), keep: Column | None = None, seed: int | None = None,
) -> DataFrame:
    """One row per window of ranges(device_id, patient_id, start_n, end_n).

    Ranges with gaps up to the tolerance are joined first. Columns: device_id, patient_id, start_n, end_n,
    window_no, window_start_n, window_end_n; signals: an array in order of measure_id of (measure_id, tag,
    period_ns, unit, expected_count, actual_count, values with NaN where no sample is); labels: a map of
    label_set_id to 0 or 1, by the share of the window's points above the threshold; a column per field
    of the patient's newest value at the window's start. ``keep`` filters windows, ``seed`` shuffles them.
    """
    keys = ["device_id", "patient_id"]
    joined = iv.union(ranges.select(*keys, "start_n", "end_n"), keys, gap_tolerance_ns)
    wins = windows.enumerate_windows(joined, duration_ns, slide_ns, full_only)
    held = window_slots(wins.select("device_id", "window_start_n", "window_end_n", "end_n").distinct(), samples, measures, ["device_id"])
    packed = held.groupBy("device_id", "window_start_n", "measure_id").agg(F.count(F.when(~F.isnan("value"), 1)).alias("actual_count"), F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    one = F.struct("measure_id", F.struct("actual_count", "m").alias("held"))
    packed = packed.groupBy("device_id", "window_start_n").agg(F.map_from_entries(F.collect_list(one)).alias("__held"))
    known = measures.select(F.struct("measure_id", "tag", "period_ns", "unit").alias("x")).agg(F.sort_array(F.collect_list("x")).alias("__measures"))  # one row of a definition's measures

    def signal(x: Column) -> Column:
        mine = F.try_element_at("__held", x["measure_id"])
        n = floor_div(F.lit(duration_ns), x["period_ns"])
        values = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.coalesce(F.try_element_at(mine["m"], i), F.lit(float("nan"))))
        return F.struct(x["measure_id"].alias("measure_id"), x["tag"].alias("tag"), x["period_ns"].alias("period_ns"), x["unit"].alias("unit"), n.alias("expected_count"), F.coalesce(mine["actual_count"], F.lit(0)).alias("actual_count"), values.alias("values"))

    out = wins.join(packed, ["device_id", "window_start_n"], "left").withColumn("__k", F.lit(0)).join(F.broadcast(known.withColumn("__k", F.lit(0))), "__k")  # broadcast: one row
    out = out.withColumn("signals", F.transform("__measures", signal)).drop("__held", "__measures", "__k")
    if labels is not None:
        period = label_period_ns or duration_ns // 100 or 1
        spans = wins.select("device_id", "window_start_n").distinct()
        marked = windows.label_windows(spans, labels, ["device_id"], duration_ns, period, label_threshold)
        marked = marked.groupBy("device_id", "window_start_n").agg(F.map_from_entries(F.collect_list(F.struct("label_set_id", "label"))).alias("labels"))
        out = out.join(marked, ["device_id", "window_start_n"], "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<bigint,int>")))
    for field in fields:
        out = windows.with_patient_values(out, history, field)
    out = out if keep is None else out.where(keep)
    return out if seed is None else windows.shuffled(out, keys, seed)


def batches(rows: DataFrame, size: int, convert: Callable[[pa.RecordBatch], object] | None = None) -> Iterator:
    """Arrow record batches of at most ``size`` windows, in order; one partition's rows at a time are on the driver."""
    names, held = rows.columns, []

    def batch():
        out = pa.Table.from_pylist([{c: r[c] for c in names} for r in held]).combine_chunks().to_batches()[0]
        return out if convert is None else convert(out)

    def plain(v):
        if hasattr(v, "asDict"):
            return v.asDict(recursive=True)
        return [plain(x) for x in v] if isinstance(v, list) else list(v.items()) if isinstance(v, dict) else v

    for r in rows.toLocalIterator():
        held.append({c: plain(r[c]) for c in names})
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def combine_validated(*ranges: DataFrame) -> DataFrame:
    """device_id, patient_id, start_n, end_n: the union of validated definitions' ranges by source."""
    keys = ["device_id", "patient_id"]
    both = ranges[0].select(*keys, "start_n", "end_n")
    for r in ranges[1:]:
        both = both.unionByName(r.select(*keys, "start_n", "end_n"))
    return iv.union(both, keys)


def label_priorities(wanted: list, label_sets: DataFrame, in_definition: list[int]) -> list[int]:
    """Ids of the labels to stratify by, given as ids or names; each must be in the definition."""
    names = [x for x in wanted if isinstance(x, str)]
    known = {r["name"]: r["label_set_id"] for r in label_sets.where(F.col("name").isin(names)).collect()} if names else {}
    out = []
    for x in wanted:
        number = known.get(x) if isinstance(x, str) else x
        if number not in in_definition:
            raise ValueError(f"label {x!r} is not in the definition")
        out.append(number)
    return out


def parts_to_ranges(ranges: DataFrame, parts: DataFrame, key: str) -> dict[int, DataFrame]:
    """Ranges of each part of a partition(key, part), to be validated definitions of their own."""
    numbers = [r["part"] for r in parts.select("part").distinct().orderBy("part").collect()]  # a part each
    joined = ranges.join(parts, key)
    return {n: joined.where(F.col("part") == n).drop("part") for n in numbers}


def part_report(ranges: DataFrame, parts: DataFrame, key: str, labels: DataFrame | None = None) -> DataFrame:
    """part, n_sources, duration_ns and, per label set, label_ns: what a partition dealt to each part."""
    joined = ranges.join(parts, key)
    out = joined.groupBy("part").agg(F.count_distinct(key).alias("n_sources"), F.sum(F.col("end_n") - F.col("start_n")).alias("duration_ns"))
    if labels is None:
        return out
    hit = joins.interval_join(joined.select("device_id", "part", "start_n", "end_n"), labels.select("device_id", "start_n", "end_n", "label_set_id"), ["device_id"])
    span = F.least("end_n", "b_end_n") - F.greatest("start_n", "b_start_n")
    each = hit.groupBy("part", "label_set_id").agg(F.sum(span).alias("ns"))
    packed = each.groupBy("part").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label_set_id", "ns")))).alias("label_ns"))
    return out.join(packed, "part", "left")
