"""Registered queries of writes, look-ups, message algebra and the codec, through the library's own operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import gaps, messages
from ..schema import TABLES
from ..sources import codec
from ..sources.dataset import Dataset
from ..sources.events import HOUR_NS
from .registry import A_N, B_N, CELLS, DAY_NS, KEYS, _with, islands, query



class Views(Dataset):
    """The look-ups of a dataset over the canonical views; nothing is written."""

    def __init__(self, c):
        super().__init__(c.spark, c.dir)
        self.c = c

    def table(self, name: str):
        c, t = self.c, self.c.table
        if name == "patients":
            rows = t("customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("mrn"), F.col("c_mktsegment").alias("gender"))
        elif name == "beds":
            rows = t("nation").select(F.col("n_nationkey").cast("long").alias("bed_id"), F.col("n_regionkey").cast("long").alias("unit_id"), F.col("n_name").alias("name"))
        elif name == "units":
            rows = t("region").select(F.col("r_regionkey").cast("long").alias("unit_id"), F.lit(1).cast("long").alias("institution_id"), F.col("r_name").alias("name"))
        elif name == "intervals":
            rows = c.samples.select(*KEYS, F.col("time_n").alias("start_n"), (F.col("time_n") + F.lit(HOUR_NS)).alias("end_n"))
        else:
            rows = {"measures": lambda: c.measures, "devices": lambda: c.devices, "patient_history": lambda: c.history, "device_patient": lambda: c.mapping, "encounters": lambda: c.encounters, "label_sets": lambda: c.label_sets, "labels": lambda: c.labels}[name]()
        missing = [x for x in TABLES[name].split(", ") if x.split()[0] not in rows.columns]
        return rows.withColumns({x.split()[0]: F.lit(None).cast(x.split()[1]) for x in missing})


def _dataset(c) -> Dataset:
    """A new dataset in the folder that the cluster shares, with the measures of the views."""
    shared = c.spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not c.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        shared = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    ds = Dataset(c.spark, f"{shared.rstrip('/')}/dataset-{uuid.uuid4().hex}").create()
    ds.replace("measures", Views(c).table("measures").select(*[x.split()[0] for x in TABLES["measures"].split(", ")]))
    return ds


_OLD = "o as (select measure_id, device_id, time_n, arg_max(value, write_seq) as hi, arg_min(value, write_seq) as lo from samples group by 1, 2, 3), n as (select measure_id, device_id, time_n, arg_max(value, write_seq) * 2 as hi from samples where tag in ('error', 'view') group by 1, 2, 3)"


def _written(c, policy: str):
    ds = _dataset(c)
    ds.write(c.samples.select(*KEYS, "time_n", "value", "write_seq"))
    ds.write(c.samples.where("tag in ('error', 'view')").select(*KEYS, "time_n", (F.col("value") * 2).alias("value"), "write_seq"), policy)
    return ds


@query(_with("samples", f"+ {_OLD} select measure_id, device_id, time_n, coalesce(n.hi, o.hi) as value from o left join n using (measure_id, device_id, time_n)"))
def write_last(c):
    return _written(c, "last").table("samples").groupBy(*KEYS, "time_n").agg(F.max_by("value", "write_seq").alias("value"))


@query(_with("samples", f"+ {_OLD} select measure_id, device_id, time_n, lo as value from o"))
def write_first(c):
    return _written(c, "first").table("samples").groupBy(*KEYS, "time_n").agg(F.min_by("value", "write_seq").alias("value"))


@query(_with("samples", "select measure_id, count(*) * (case when measure_id in (2, 5) then 2 else 1 end) as n, count(distinct (device_id, time_n)) as n_times from samples group by measure_id"))
def write_append(c):
    rows = _written(c, "append").table("samples")
    return rows.groupBy("measure_id").agg(F.count("*").alias("n"), F.count_distinct("device_id", "time_n").alias("n_times"))


@query(_with("samples", f"+ {CELLS}, {islands('cells', 'measure_id, device_id')} select * from isl"))
def write_coverage(c):
    """Coverage as two writes, one after the other, leave it."""
    ds = _dataset(c)
    half = F.col("time_n") < A_N
    for part in (half, ~half):
        ds.write(c.samples.where(part).select(*KEYS, "time_n", "value", "write_seq"))
    return ds.table("intervals")


@query(_with("samples", f"+ {CELLS}, {islands('cells', 'measure_id, device_id')} select * from isl"))
def rebuild_intervals(c):
    ds = _dataset(c)
    ds.write(c.samples.select(*KEYS, "time_n", "value", "write_seq"))
    ds.replace("intervals", ds.table("intervals").limit(0))
    return ds.rebuild_intervals()


@query(_with("samples", "select measure_id, device_id, time_n, arg_max(value, write_seq) * (case when tag in ('error', 'view') then 2 else 1 end) as value from samples group by measure_id, device_id, time_n, tag"))
def compact(c):
    ds = _written(c, "append")
    ds.compact(keep="last")
    return ds.table("samples").select(*KEYS, "time_n", "value")


# -- look-ups -----------------------------------------------------------------
@query(_with("label_sets", "select label_set_id, name, parent_id from label_sets order by label_set_id limit 40 offset 7"))
def label_sets_page(c):
    return Views(c).label_sets(40, 7)


@query(_with("label_sets", "select label_set_id, name, parent_id from label_sets where parent_id = 3"))
def label_set_children(c):
    return Views(c).label_set_children(3)


@query("select c_custkey as patient_id, c_name as mrn from customer order by c_custkey limit 25 offset 50")
def patients_page(c):
    return Views(c).patients(25, 50).select("patient_id", "mrn")


@query("select c_name as mrn, c_custkey as patient_id from customer")
def mrn_to_patient(c):
    return Views(c).mrn_to_patient()


@query("select c_custkey as patient_id, c_name as mrn from customer where c_custkey in (3, 5, 8)")
def patient_to_mrn(c):
    return Views(c).patient_to_mrn([3, 5, 8])


@query(_with("history", "select id, field, value, time_n from history where patient_id = 7 and field = 'R' and time_n between 700000000000000000 and 900000000000000000"))
def patient_history_of(c):
    return Views(c).history(7, "R", 700_000_000_000_000_000, 900_000_000_000_000_000).select("id", "field", "value", "time_n")


@query(_with("devices", "select device_id, tag, type, bed_id from devices where device_id in (1, 4, 9)"))
def devices_in(c):
    return Views(c).rows_in("devices", [1, 4, 9]).select("device_id", "tag", "type", "bed_id")


@query("select n_nationkey::bigint as bed_id, n_name as name from nation where n_nationkey in (2, 3)")
def beds_in(c):
    return Views(c).rows_in("beds", [2, 3]).select("bed_id", "name")


@query("select r_regionkey::bigint as unit_id, r_name as name from region order by 1")
def units_all(c):
    return Views(c).page("units").select("unit_id", "name")


# -- messages -----------------------------------------------------------------
_MESSAGES = f"msg as (select measure_id, device_id, time_n as start_n, (count(*) * 3)::bigint as n from samples group by 1, 2, 3), ends as (select *, start_n + n * {HOUR_NS} as end_n from msg)"


def _messages(c):
    return c.samples.groupBy(*KEYS, F.col("time_n").alias("start_n")).agg((F.count("*") * 3).alias("n"))


@query(_with("samples", f"+ {_MESSAGES}, g as (select measure_id, device_id, start_n - lag(end_n) over w as gap_ns, (sum(n) over (w rows between unbounded preceding and 1 preceding))::bigint as idx from ends window w as (partition by measure_id, device_id order by start_n)) select measure_id, device_id, idx, gap_ns from g where gap_ns <> 0"))
def message_gaps(c):
    return messages.variable_gaps(_messages(c), KEYS, F.lit(HOUR_NS))


@query(_with("samples", f"+ {_MESSAGES} select measure_id, device_id, start_n, n from msg"))
def messages_from_gaps(c):
    m = _messages(c)
    starts = m.groupBy(*KEYS).agg(F.min("start_n").alias("start_n"), F.sum("n").alias("n"))
    return messages.from_gaps(starts, messages.variable_gaps(m, KEYS, F.lit(HOUR_NS)), KEYS, F.lit(HOUR_NS))


@query(_with("samples", f"+ {_MESSAGES}, {islands('ends', 'measure_id, device_id', 12 * HOUR_NS)} select * from isl"))
def message_intervals(c):
    return messages.to_intervals(_messages(c), KEYS, F.lit(HOUR_NS), 12 * HOUR_NS)


@query(_with("samples", f"+ {_MESSAGES}, {islands('ends', 'measure_id, device_id', 30 * HOUR_NS)} select * from isl"))
def close_gaps(c):
    return messages.close_gaps(_messages(c).withColumn("end_n", F.col("start_n") + F.col("n") * F.lit(HOUR_NS)), KEYS, 30 * HOUR_NS)


@query(_with("samples", f"+ {CELLS}, {islands('cells', 'measure_id, device_id')} select * from isl"))
def written_intervals(c):
    return messages.written_intervals(c.samples, KEYS, F.lit(HOUR_NS), "times")


@query(_with("samples", f"+ {_MESSAGES}, f as (select *, coalesce(sum(n) over (partition by measure_id, device_id order by start_n rows between unbounded preceding and 1 preceding), 0)::bigint as before from msg), b as (select *, unnest(range(before // 8, (before + n - 1) // 8 + 1)) as block from f) select measure_id, device_id, block::bigint as block, (start_n + (greatest(block * 8, before) - before) * {HOUR_NS})::bigint as start_n, (least((block + 1) * 8, before + n) - greatest(block * 8, before))::bigint as n from b"))
def messages_split_at_blocks(c):
    return messages.split_at(_messages(c), KEYS, F.lit(HOUR_NS), 8)


@query(_with("samples", f"+ s as (select distinct measure_id, device_id, time_n from samples), r as (select *, row_number() over (partition by measure_id, device_id order by time_n) - 1 as idx, min(time_n) over (partition by measure_id, device_id) as first_n from s) select measure_id, device_id, (idx // 4)::bigint as block, time_n as start_n, (time_n - first_n - idx * {HOUR_NS})::bigint as gap_ns from r where idx % 4 = 0"))
def block_gap_starts(c):
    s = c.samples.select(*KEYS, "time_n").distinct()
    starts = s.groupBy(*KEYS).agg(F.min("time_n").alias("start_n"), F.count("*").alias("n"))
    return messages.block_starts(starts, gaps.encode(s, KEYS, F.lit(HOUR_NS)), KEYS, F.lit(HOUR_NS), 4)


_NEW = "nw as (select measure_id, device_id, time_n, max(value) * 2 as value from samples where value > 50 group by 1, 2, 3), od as (select measure_id, device_id, time_n, max(value) as value from samples where value <= 80 group by 1, 2, 3)"


def _sides(c):
    one = lambda rows, by: rows.groupBy(*KEYS, "time_n").agg((F.max("value") * by).alias("value"))
    return one(c.samples.where("value <= 80"), 1), one(c.samples.where("value > 50"), 2)


@query(_with("samples", f"+ {_NEW} select measure_id, device_id, time_n, coalesce(nw.value, od.value) as value from od full join nw using (measure_id, device_id, time_n)"))
def merge_samples_new_wins(c):
    return messages.merge_samples(*_sides(c), KEYS)


@query(_with("samples", f"+ {_NEW} select measure_id, device_id, time_n, coalesce(od.value, nw.value) as value from od full join nw using (measure_id, device_id, time_n)"))
def merge_samples_old_wins(c):
    return messages.merge_samples(*_sides(c), KEYS, "old")


@query(_with("samples", f"+ {_NEW}, t as (select measure_id, device_id, time_n from od union select measure_id, device_id, time_n from nw), g as (select measure_id, device_id, row_number() over w - 1 as idx, time_n - lag(time_n) over w - {HOUR_NS} as gap_ns from t window w as (partition by measure_id, device_id order by time_n)) select * from g where gap_ns <> 0"))
def merge_gap_data(c):
    return messages.merge_gap_data(*_sides(c), KEYS, F.lit(HOUR_NS))[1]


# -- codec --------------------------------------------------------------------
@query(_with("samples", "select measure_id, device_id, time_n, value from samples"))
def codec_round_trip(c):
    s = c.samples.select(*KEYS, "time_n", "value")
    return codec.decode_frame(codec.encode_frame(s, KEYS, HOUR_NS, 10 * DAY_NS), KEYS)


@query(_with("samples", f"select measure_id, device_id, time_n // {10 * DAY_NS} as chunk, count(*) as n, min(time_n) as start_n, max(time_n) + {HOUR_NS} as end_n, min(value) as v_min, max(value) as v_max from samples group by 1, 2, 3"))
def codec_headers(c):
    return codec.encode_frame(c.samples.select(*KEYS, "time_n", "value"), KEYS, HOUR_NS, 10 * DAY_NS).drop("block")


# -- definitions and mappings -----------------------------------------------------
@query(_with("samples mapping", f"select device_id, patient_id, min(start_n) as first_n, count(*) as n_ranges from mapping where (end_n is null or end_n > {A_N}) and start_n < {B_N} group by 1, 2"))
def mapping_grouped(c):
    """Ranges of each (device, patient) in the order of their starts."""
    from ..operators import joins

    rows = joins.group_ranges(joins.mapping_range(c.mapping, A_N, B_N))
    return rows.select("device_id", "patient_id", F.get("ranges", F.lit(0))["start_n"].alias("first_n"), F.size("ranges").cast("long").alias("n_ranges"))


# -- windows over all measures -----------------------------------------------------
_DUR, _SLIDE = 6 * HOUR_NS, 3 * HOUR_NS
_ALL = f"{CELLS}, u as (select device_id, start_n, end_n from cells), {islands('u', 'device_id')}, w as (select device_id, start_n, end_n, s as window_start_n, s + {_DUR} as window_end_n from (select *, unnest(range(start_n, end_n, {_SLIDE})) as s from isl))"
_CELL = f"x as (select w.device_id, window_start_n, s.measure_id, round_even((time_n - window_start_n)::decimal(38, 6) / {HOUR_NS}, 0)::bigint as slot, arg_max(value, time_n) as value from w join samples s on s.device_id = w.device_id and time_n >= window_start_n and time_n < least(window_end_n, end_n) group by 1, 2, 3, 4)"


def _ranges(c):
    from ..operators import intervals as iv

    return iv.from_samples(c.samples, ["device_id"], F.lit(HOUR_NS), 0).select("device_id", F.lit(None).cast("long").alias("patient_id"), "start_n", "end_n")


@query(_with("samples", f"+ {_ALL}, {_CELL} select * from x where slot < 6"))
def window_slots(c):
    """Slots of every measure in every window of all sources, in one join."""
    from ..operators import windows
    from . import iterator

    wins = windows.enumerate_windows(_ranges(c), _DUR, _SLIDE)
    return iterator.window_slots(wins, c.samples, c.measures, ["device_id"])


@query(_with("samples", f"+ {_ALL}, {_CELL}, n as (select device_id, window_start_n, count(*) as n, count(distinct measure_id) as k, sum(value) as s from x where slot < 6 group by 1, 2) select w.device_id, w.window_start_n, 30::bigint as expected, coalesce(n, 0)::bigint as actual, coalesce(k, 0)::bigint as n_measures, round(coalesce(s, 0), 6) as total from w left join n using (device_id, window_start_n) where coalesce(n, 0) >= 2"))
def definition_windows(c):
    """The iterator's windows with two samples or more, their nested signals summed up again."""
    from . import iterator

    rows = iterator.windows_of(_ranges(c), c.samples, c.measures, _DUR, _SLIDE, keep=F.aggregate("signals", F.lit(0).cast("long"), lambda a, x: a + x["actual_count"]) >= 2)
    add = lambda f: F.aggregate("signals", F.lit(0).cast("long"), lambda a, x: a + f(x))
    total = F.aggregate(F.flatten(F.transform("signals", lambda x: F.filter(x["values"], lambda v: ~F.isnan(v)))), F.lit(0.0), lambda a, v: a + v)
    return rows.select("device_id", "window_start_n", add(lambda x: x["expected_count"]).alias("expected"), add(lambda x: x["actual_count"]).alias("actual"), add(lambda x: (x["actual_count"] > 0).cast("long")).alias("n_measures"), F.round(total, 6).alias("total"))


@query(_with("samples mapping", f"+ a as (select device_id, patient_id, start_n, coalesce(end_n, {B_N + 400 * DAY_NS}) as end_n from mapping), b as (select device_id, patient_id, start_n - {DAY_NS} as start_n, start_n + {DAY_NS} as end_n from mapping), z as (select * from a union all select * from b), {islands('z', 'device_id, patient_id')} select * from isl"))
def combine_validated(c):
    from . import iterator

    m = c.mapping
    a = m.withColumn("end_n", F.coalesce("end_n", F.lit(B_N + 400 * DAY_NS)))
    b = m.withColumn("end_n", F.col("start_n") + DAY_NS).withColumn("start_n", F.col("start_n") - DAY_NS)
    return iterator.combine_validated(a, b)
