"""Registered queries of the signal engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gaps, messages, units, values
from ..operators import aggregates, joins, labels, scan, windows
from ..operators import intervals as iv
from ..sources import blocks, files
from ..sources.events import EPOCH_N, HOUR_NS, NOW_N, Canonical
from . import definition as df_
from . import splits

DAY_NS = iv.DAY_NS
A_N = EPOCH_N + 5 * DAY_NS
B_N = EPOCH_N + 12 * DAY_NS
KEYS = ["measure_id", "device_id"]
QUERIES: dict = {}
SQL: dict = {}

CTE = {
    "samples": """samples as (select (case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 when 'view' then 5 end)::bigint as measure_id,
      user_id as device_id, (epoch_us(ts) * 1000)::bigint as time_n, value, event_id as write_seq, event_type as tag from events)""",
    "mapping": f"""mapping as (select device_id * 100 + w as id, device_id, device_id * 100 + w as patient_id, ({EPOCH_N} + w * {168 * HOUR_NS})::bigint as start_n,
      case when w < max(w) over (partition by device_id) then ({EPOCH_N} + (w + 1) * {168 * HOUR_NS})::bigint end as end_n
      from (select distinct device_id, ((time_n - {EPOCH_N}) // {168 * HOUR_NS})::bigint as w from samples))""",
    "encounters": f"""encounters as (select o_orderkey as id, o_custkey as patient_id, c_nationkey::bigint as bed_id, (epoch_us(o_orderdate) * 1000)::bigint as start_n,
      case when o_orderstatus <> 'O' then (epoch_us(o_orderdate) * 1000 + (o_orderkey % 30 + 1) * {24 * HOUR_NS})::bigint end as end_n from orders join customer on c_custkey = o_custkey)""",
    "devices": "devices as (select s_suppkey as device_id, s_name as tag, case when s_suppkey % 2 = 0 then 'static' else 'dynamic' end as type, s_nationkey::bigint as bed_id from supplier)",
    "label_sets": """label_sets as (select (r_regionkey + 1)::bigint as label_set_id, r_name as name, null::bigint as parent_id from region
      union all select (n_nationkey + 101)::bigint, n_name, (n_regionkey + 1)::bigint from nation
      union all select distinct (1000 + c_nationkey * 100 + ascii(c_mktsegment))::bigint, c_nationkey || ':' || c_mktsegment, (c_nationkey + 101)::bigint from customer)""",
    "labels": f"labels_t as (select write_seq as label_id, (101 + write_seq % 25)::bigint as label_set_id, device_id, 2::bigint as measure_id, 1::bigint as label_source_id, time_n as start_n, (time_n + {2 * HOUR_NS})::bigint as end_n from samples where tag = 'error')",
    "history": """history as (select (l_orderkey * 10 + l_linenumber)::bigint as id, o_custkey as patient_id, l_returnflag as field, l_quantity as value, (epoch_us(l_shipdate) * 1000)::bigint as time_n
      from lineitem join orders on l_orderkey = o_orderkey)""",
}


def _with(names: str, body: str) -> str:
    need = names.split()
    if any(n in need for n in ("mapping", "labels")) and "samples" not in need:
        need.insert(0, "samples")
    recursive = "recursive " if "recursive" in need else ""
    ctes = ", ".join(CTE[n] for n in CTE if n in need)
    return f"with {recursive}{ctes}{', ' if ctes and body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


def islands(source: str, keys: str, tolerance: int = 0, name: str = "isl") -> str:
    """CTE text: merge source(keys, start_n, end_n) within the tolerance."""
    return f"""{name}_o as (select {keys}, start_n, end_n, case when start_n > max(end_n) over (partition by {keys} order by start_n, end_n rows between unbounded preceding and 1 preceding) + {tolerance} then 1 else 0 end as o from {source} where start_n < end_n),
    {name}_g as (select *, sum(o) over (partition by {keys} order by start_n, end_n rows unbounded preceding) as g from {name}_o),
    {name} as (select {keys}, min(start_n) as start_n, max(end_n) as end_n from {name}_g group by {keys}, g)"""


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Canonical(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CELLS = f"cells as (select measure_id, device_id, time_n as start_n, time_n + {HOUR_NS} as end_n from samples)"


# -- scans ------------------------------------------------------------------
@query(_with("samples", f"select measure_id, device_id, time_n, value from samples where measure_id = 5 and device_id = 3 and time_n >= {A_N} and time_n < {B_N}"))
def range_scan_device(c):
    return scan.range_scan(c.samples_of(5, A_N, B_N), 5, A_N, B_N, device_id=3, sort=False).select("measure_id", "device_id", "time_n", "value")


@query(_with("samples mapping", f"select measure_id, s.device_id, time_n, value from samples s join mapping m on m.device_id = s.device_id where m.patient_id = 301 and time_n >= greatest(m.start_n, {A_N}) and time_n < least(coalesce(m.end_n, {NOW_N}), {NOW_N})"))
def range_scan_patient(c):
    return scan.range_scan(c.samples, None, A_N, NOW_N, patient_id=301, mapping=c.mapping, now_n=NOW_N, sort=False).select("measure_id", "device_id", "time_n", "value")


@query(_with("samples", f"select measure_id, device_id, time_n // {DAY_NS} as block, min(time_n) as start_n, max(time_n) as end_n, count(*) as num_vals, min(value) as v_min, max(value) as v_max, round(avg(value), 6) as v_mean, round(stddev_pop(value), 6) as v_std from samples group by 1, 2, 3"))
def header_stats(c):
    b = scan.blocks(c.samples, KEYS)
    return b.withColumn("v_mean", F.round("v_mean", 6)).withColumn("v_std", F.round("v_std", 6))


@query(_with("samples", f"select * from (select measure_id, device_id, time_n // {DAY_NS} as block, min(time_n) as start_n, max(time_n) as end_n, count(*) as num_vals from samples group by 1, 2, 3) where end_n >= {A_N} and start_n <= {B_N}"))
def blocks_in_range(c):
    return scan.blocks_in_range(scan.blocks(c.samples, KEYS), A_N, B_N).select(*KEYS, "block", "start_n", "end_n", "num_vals")


@query(_with("samples", "select measure_id, device_id, (rn - 1) // 5 as window_no, count(*) as n, min(time_n) as first_n, max(time_n) as last_n from (select *, row_number() over (partition by measure_id, device_id order by time_n) as rn from samples) group by 1, 2, 3"))
def row_windows(c):
    w = scan.row_windows(c.samples, KEYS, 5, 5)
    return w.select(*KEYS, "window_no", "n", F.array_min("times").alias("first_n"), F.array_max("times").alias("last_n"))


# -- values -----------------------------------------------------------------
@query(_with("samples", "select write_seq, round(round(value * 100)::bigint * 0.01::double + 0.0::double, 6) as value from samples"))
def analog_scaling(c):
    r = c.samples_raw
    return r.select("write_seq", F.round(values.analog(F.col("value_raw"), F.col("scale_m"), F.col("scale_b")), 6).alias("value"))


@query(
    _with(
        "samples",
        f"""+ k as (select distinct measure_id, device_id from samples), spine as (select measure_id, device_id, unnest(range({7 * 24}))::bigint as slot from k),
    h as (select measure_id, device_id, round_even((time_n - {A_N})::decimal(38, 6) / {HOUR_NS}, 0)::bigint as slot, arg_max(value, (time_n, write_seq)) as value from samples where time_n >= {A_N} and time_n < {B_N} group by 1, 2, 3)
    select measure_id, device_id, slot, {A_N} + slot * {HOUR_NS} as time_n, value from spine left join h using (measure_id, device_id, slot)""",
    )
)
def nan_fill_grid(c):
    return scan.fill(c.samples, KEYS, A_N, B_N, HOUR_NS)


@query(_with("samples", "+ t as (select measure_id, (time_n // 60000000000) * 60000000000 as time_n from samples), d as (select measure_id, time_n - lag(time_n) over (partition by measure_id order by time_n) as step from t), n as (select measure_id, step, count(*) as n from d where step > 0 group by 1, 2) select measure_id, arg_max(step, (n, -step)) as period_ns from n group by 1"))
def detect_period(c):
    minute = (units.floor_div(F.col("time_n"), 60_000_000_000) * 60_000_000_000).alias("time_n")
    return gaps.detect_period(c.samples.select("measure_id", minute), ["measure_id"])


@query(_with("samples", f"select measure_id, device_id, idx, gap_ns from (select measure_id, device_id, row_number() over w - 1 as idx, time_n - lag(time_n) over w - {HOUR_NS} as gap_ns from samples window w as (partition by measure_id, device_id order by time_n)) where gap_ns <> 0"))
def gap_array(c):
    return gaps.encode(c.samples, KEYS, F.lit(HOUR_NS))


@query(_with("samples", "select measure_id, device_id, row_number() over (partition by measure_id, device_id order by time_n) - 1 as idx, time_n from samples"))
def gap_array_round_trip(c):
    s = c.samples.select(*KEYS, "time_n")
    starts = s.groupBy(*KEYS).agg(F.min("time_n").alias("start_n"), F.count("*").alias("n"))
    return gaps.decode(starts, gaps.encode(s, KEYS, F.lit(HOUR_NS)), KEYS, F.lit(HOUR_NS))


@query(_with("samples", f"select measure_id, device_id, time_n as start_n, time_n + {HOUR_NS} as end_n, 1::bigint as n from samples"))
def gap_array_intervals(c):
    s = c.samples.select(*KEYS, "time_n")
    starts = s.groupBy(*KEYS).agg(F.min("time_n").alias("start_n"), F.count("*").alias("n"))
    return gaps.to_intervals(starts, gaps.encode(s, KEYS, F.lit(HOUR_NS)), KEYS, F.lit(HOUR_NS))


@query(_with("samples", "select measure_id, min(value)::double as low, max(value)::double as high, case when min(value) >= -128 and max(value) <= 127 then 1 when min(value) >= -32768 and max(value) <= 32767 then 2 else 4 end as bytes from samples group by 1"))
def bytes_per_value(c):
    g = c.samples.groupBy("measure_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return g.withColumn("bytes", values.bytes_per_value(F.col("low"), F.col("high")))


@query("select n_nationkey, 1000000000000000000 // ((n_nationkey + 7) * 1000000000::bigint) as period_ns, ((n_nationkey * 1000 + 1)::hugeint * 1000000000000000000 // ((n_nationkey + 7) * 1000000000::bigint))::bigint as duration_ns from nation")
def period_and_duration(c):
    n = c.table("nation").withColumn("f", (F.col("n_nationkey") + 7).cast("long") * 1_000_000_000)
    count = (F.col("n_nationkey") * 1000 + 1).cast("long")
    return n.select("n_nationkey", units.period_of(F.col("f")).alias("period_ns"), units.duration_by_freq(count, F.col("f")).alias("duration_ns"))


@query(_with("samples", "select write_seq, strftime(make_timestamp(time_n // 1000), '%Y-%m-%dT%H:%M:%S.%f') as iso from samples"))
def iso_times(c):
    return c.samples.select("write_seq", units.iso_string(F.col("time_n")).alias("iso"))


# -- intervals --------------------------------------------------------------
@query(_with("samples", f"+ {CELLS}, {islands('cells', 'measure_id, device_id', 48 * HOUR_NS)} select * from isl"))
def coverage_intervals(c):
    return iv.coverage(c.samples, KEYS, HOUR_NS, 48 * HOUR_NS)


@query(_with("samples", f"+ {CELLS}, {islands('cells', 'measure_id, device_id', 0, 'i1')}, cl as (select measure_id, device_id, greatest(start_n, {A_N}) as start_n, least(end_n, {B_N}) as end_n from i1), {islands('cl', 'measure_id, device_id', 6 * HOUR_NS, 'i2')} select * from i2"))
def coverage_clipped(c):
    return iv.coverage(c.samples, KEYS, HOUR_NS, 6 * HOUR_NS, A_N, B_N)


@query(_with("encounters", f"+ e as (select bed_id, start_n, coalesce(end_n, start_n + {DAY_NS}) as end_n from encounters), {islands('e', 'bed_id')} select * from isl"))
def interval_union(c):
    return iv.union(c.encounters.withColumn("end_n", F.coalesce("end_n", F.col("start_n") + DAY_NS)), ["bed_id"])


def _by_measure(c, m):
    return iv.union(iv.from_samples(c.samples.where(F.col("measure_id") == m), ["device_id"], 12 * HOUR_NS), ["device_id"])


_MEAS = ", ".join(
    f"c{m} as (select device_id, time_n as start_n, time_n + {12 * HOUR_NS} as end_n from samples where measure_id = {m}), " + islands(f"c{m}", "device_id", 0, f"m{m}") for m in (1, 3, 5)
)


@query(_with("samples", f"+ {_MEAS}, x as (select m1.device_id, greatest(m1.start_n, m3.start_n) as start_n, least(m1.end_n, m3.end_n) as end_n from m1 join m3 on m1.device_id = m3.device_id and m1.start_n < m3.end_n and m3.start_n < m1.end_n), {islands('x', 'device_id')} select * from isl"))
def interval_intersection(c):
    return iv.intersection([_by_measure(c, 1), _by_measure(c, 3)], ["device_id"])


@query(
    _with(
        "samples",
        f"""+ {_MEAS}, e as (select device_id, start_n as t, 1 as a, 0 as b from m1 union all select device_id, end_n, -1, 0 from m1 union all select device_id, start_n, 0, 1 from m3 union all select device_id, end_n, 0, -1 from m3),
    s as (select device_id, t, sum(a) as a, sum(b) as b from e group by 1, 2), r as (select device_id, t as start_n, lead(t) over w as end_n, sum(a) over w as a, sum(b) over w as b from s window w as (partition by device_id order by t)),
    p as (select device_id, start_n, end_n from r where a > 0 and b <= 0 and end_n is not null), {islands('p', 'device_id')} select * from isl""",
    )
)
def interval_difference(c):
    return iv.difference(_by_measure(c, 1), _by_measure(c, 3), ["device_id"])


@query(_with("samples", f"+ {_MEAS} select device_id, end_n as start_n, nx as end_n from (select *, lead(start_n) over (partition by device_id order by start_n, end_n) as nx from m1) where nx is not null"))
def interval_gaps(c):
    return iv.gaps(_by_measure(c, 1), ["device_id"])


@query(_with("samples", f"+ {_MEAS} select device_id, sum(end_n - start_n)::bigint as duration_ns, count(*) as n_intervals from m5 group by 1"))
def interval_duration(c):
    return iv.duration(_by_measure(c, 5), ["device_id"])


@query(_with("samples", f"+ {_MEAS} select device_id, max((start_n <= {A_N} and end_n > {A_N})::int)::boolean as contains from m5 group by 1"))
def interval_contains(c):
    return iv.contains(_by_measure(c, 5), A_N, ["device_id"])


@query(_with("encounters", f"+ e as (select bed_id, start_n, coalesce(end_n, start_n + {DAY_NS}) as end_n from encounters), r as (select *, max(end_n) over (partition by bed_id order by start_n, end_n rows between unbounded preceding and 1 preceding) as m from e) select bed_id, coalesce(max((start_n < m)::int)::boolean, false) as overlaps from r group by 1"))
def interval_overlaps(c):
    return iv.any_overlap(c.encounters.withColumn("end_n", F.coalesce("end_n", F.col("start_n") + DAY_NS)), ["bed_id"])


@query(_with("samples", f"+ {_MEAS}, u as (select * from m1 union all select * from m3 union all select * from m5), {islands('u', 'device_id', 6 * HOUR_NS)} select * from isl"))
def build_from_measures_union(c):
    return iv.by_strategy([_by_measure(c, m) for m in (1, 3, 5)], ["device_id"], "union", 6 * HOUR_NS)


@query(
    _with(
        "samples",
        f"""+ {_MEAS}, x as (select m1.device_id, greatest(m1.start_n, m3.start_n, m5.start_n) as start_n, least(m1.end_n, m3.end_n, m5.end_n) as end_n from m1 join m3 on m1.device_id = m3.device_id and m1.start_n < m3.end_n and m3.start_n < m1.end_n
    join m5 on m5.device_id = m1.device_id and m5.start_n < least(m1.end_n, m3.end_n) and m5.end_n > greatest(m1.start_n, m3.start_n)), {islands('x', 'device_id')} select * from isl""",
    )
)
def build_from_measures_intersection(c):
    return iv.by_strategy([_by_measure(c, m) for m in (1, 3, 5)], ["device_id"], "intersection")


@query(_with("samples", f"+ {_MEAS}, p as (select device_id, unnest(range(start_n, end_n, {5 * HOUR_NS})) as s, end_n from m5) select device_id, s as start_n, least(end_n, s + {5 * HOUR_NS}) as end_n from p"))
def split_ranges(c):
    return iv.split(_by_measure(c, 5), 5 * HOUR_NS)


@query(_with("samples", f"+ {_MEAS} select device_id, start_n + {HOUR_NS} as start_n, end_n + {HOUR_NS} as end_n from m3"))
def shift_ranges(c):
    return iv.shift(_by_measure(c, 3), HOUR_NS)


@query(_with("samples", f"+ {_MEAS}, p as (select device_id, unnest(range(start_n, end_n, {5 * HOUR_NS})) as s, end_n from m5) select device_id, min(s) as start_n, end_n from p group by 1, 3"))
def merge_touching(c):
    return iv.merge_touching(iv.split(_by_measure(c, 5), 5 * HOUR_NS), ["device_id"])


# -- mapping and joins ------------------------------------------------------
@query(_with("mapping", f"select id, device_id, patient_id, start_n, end_n from mapping where (end_n is null or end_n > {A_N}) and start_n < {B_N}"))
def mapping_range(c):
    return joins.mapping_range(c.mapping, A_N, B_N)


@query(_with("mapping", f"select id, device_id, patient_id, start_n, end_n from mapping where start_n <= {A_N} and (end_n is null or end_n > {A_N})"))
def mapping_point(c):
    return joins.mapping_at(c.mapping, A_N)


@query(_with("mapping", f"select id, device_id, patient_id, greatest(start_n, {A_N}) as start_n, least(coalesce(end_n, {NOW_N}), {B_N}) as end_n from mapping where (end_n is null or end_n > {A_N}) and start_n < {B_N} and greatest(start_n, {A_N}) < least(coalesce(end_n, {NOW_N}), {B_N})"))
def mapping_truncate(c):
    return joins.mapping_truncated(c.mapping, A_N, B_N, NOW_N)


def _ranges(c):
    w = (F.col("device_id") % 5).cast("long") * DAY_NS
    return c.samples.select("device_id").distinct().select("device_id", (F.lit(A_N) + w).alias("q_start"), (F.lit(A_N) + w + 30 * HOUR_NS).alias("q_end"))


_CONVERT = f"""+ mm as (select device_id, patient_id, start_n, coalesce(end_n, {NOW_N}) as end_n from mapping), {islands('mm', 'device_id, patient_id')},
    q as (select distinct device_id, {A_N} + (device_id % 5) * {DAY_NS} as q_start, {A_N} + (device_id % 5) * {DAY_NS} + {30 * HOUR_NS} as q_end from samples),"""


@query(_with("mapping", _CONVERT + " h as (select q.device_id, q_start, max(patient_id) as patient_id from q join isl on isl.device_id = q.device_id and start_n <= q_start and end_n >= q_end group by 1, 2 having count(distinct patient_id) = 1) select q.device_id, q.q_start, q.q_end, h.patient_id from q left join h using (device_id, q_start)"))
def convert_device_to_patient(c):
    return joins.convert_source(c.mapping, "device_id", "patient_id", _ranges(c), "always_none", NOW_N)


@query(
    _with(
        "mapping",
        _CONVERT
        + """ o as (select q.device_id, q_start, q_end, patient_id, (least(end_n, q_end) - greatest(start_n, q_start)) / (q_end - q_start) as share, start_n <= q_start and end_n >= q_end as holds from q join isl on isl.device_id = q.device_id and start_n < q_end and end_n > q_start),
    h as (select device_id, q_start, case when count(distinct case when holds then patient_id end) = 1 then max(case when holds then patient_id end) when max(share) >= 0.9 then arg_max(patient_id, (share, patient_id)) end as patient_id from o group by 1, 2)
    select q.device_id, q.q_start, q.q_end, h.patient_id from q left join h using (device_id, q_start)""",
    )
)
def convert_device_to_patient_90pct(c):
    return joins.convert_source(c.mapping, "device_id", "patient_id", _ranges(c), "90_percent_overlap", NOW_N)


@query(
    _with(
        "mapping",
        f"""+ r as (select distinct device_id, {A_N} as start_n, {NOW_N + DAY_NS} as end_n from samples), m as (select device_id, patient_id, start_n, coalesce(end_n, {NOW_N}) as end_n from mapping),
    x as (select r.device_id, m.patient_id, greatest(r.start_n, m.start_n) as start_n, least(r.end_n, m.end_n) as end_n from r join m on r.device_id = m.device_id and r.start_n < m.end_n and m.start_n < r.end_n), {islands('x', 'device_id, patient_id', 0, 'hit')},
    b as (select device_id, start_n as s, end_n as e from x union all select device_id, {NOW_N + DAY_NS}, {NOW_N + DAY_NS} from r), g as (select device_id, greatest(coalesce(max(e) over (partition by device_id order by s, e rows between unbounded preceding and 1 preceding), {A_N}), {A_N}) as start_n, s as end_n from b)
    select device_id, patient_id, start_n, end_n from hit union all select device_id, null, start_n, end_n from g where start_n < end_n""",
    )
)
def map_sources(c):
    r = c.samples.select("device_id").distinct().select("device_id", F.lit(A_N).alias("start_n"), F.lit(NOW_N + DAY_NS).alias("end_n"))
    return joins.map_sources(r, c.mapping, NOW_N)


@query(_with("samples mapping", f"select s.write_seq, m.patient_id from samples s join mapping m on m.device_id = s.device_id and s.time_n >= m.start_n and s.time_n < coalesce(m.end_n, {NOW_N + DAY_NS * 400})"))
def sample_patients(c):
    m = c.mapping.withColumn("end_n", F.coalesce("end_n", F.lit(NOW_N + DAY_NS * 400)))
    return joins.point_join(c.samples, m, ["device_id"]).select("write_seq", "patient_id")


@query(_with("history encounters", "select e.id, h.value from (select id, patient_id, start_n from encounters) e asof left join (select patient_id, time_n, arg_max(value, id) as value from history where field = 'N' group by 1, 2) h on e.patient_id = h.patient_id and e.start_n >= h.time_n"))
def asof_history(c):
    e = c.encounters.select("id", "patient_id", "start_n")
    h = c.placed_history.where("field = 'N'").withColumnRenamed("id", "hid")
    return joins.as_of(e, h, ["patient_id"], "start_n", "time_n", ["value"], ["hid", "earlier"]).select("id", "value")


@query(_with("history", "select patient_id, field, arg_max(value, (time_n, id)) as value, max(time_n) as time_n from history group by 1, 2"))
def latest_history(c):
    return aggregates.latest_history(c.placed_history, ("id", "earlier"))


_E0 = 800_000_000_000_000_000


@query(_with("encounters", f"select * from encounters where start_n <= {_E0} and (end_n is null or end_n > {_E0})"))
def encounters_at(c):
    return joins.encounters_where(c.encounters, time_n=_E0)


@query(_with("encounters", f"select * from encounters where (end_n is null or end_n > {_E0}) and start_n < {_E0 + 30 * DAY_NS} and bed_id = 3"))
def encounters_range(c):
    return joins.encounters_where(c.encounters, start_n=_E0, end_n=_E0 + 30 * DAY_NS, bed_id=3)


@query(_with("encounters devices", "select d.device_id, e.patient_id, e.id as encounter_id, e.start_n, e.end_n from encounters e join devices d using (bed_id) where d.type = 'static'"))
def encounter_fanout(c):
    return joins.encounter_fanout(c.encounters, c.devices)


# -- labels -----------------------------------------------------------------
_DOWN = "+ d as (select label_set_id as root_id, label_set_id, 0 as depth from label_sets union all select d.root_id, l.label_set_id, depth + 1 from d join label_sets l on l.parent_id = d.label_set_id)"


def _rec(names: str, body: str) -> str:
    return _with(names, body).replace("with ", "with recursive ", 1)


@query(_rec("label_sets", _DOWN + " select * from d"))
def label_descendants(c):
    return joins.descendants(c.label_sets)


@query(_rec("label_sets", _DOWN + " select label_set_id, root_id as ancestor_id, depth from d where depth > 0"))
def label_ancestors(c):
    return joins.ancestors(c.label_sets)


@query(_rec("label_sets", _DOWN + " select root_id, max(depth) as depth, count(*) as n from d where depth <= 1 group by 1"))
def label_tree_depth(c):
    return joins.descendants(c.label_sets, 1).groupBy("root_id").agg(F.max("depth").alias("depth"), F.count("*").alias("n"))


@query(_rec("label_sets", _DOWN + " select label_set_id, arg_min(root_id, (depth, root_id)) as requested_id from d where root_id in (2, 105, 3) group by 1"))
def labels_with_requested_root(c):
    return joins.requested_roots(c.label_sets, c.label_sets.where("label_set_id in (2, 105, 3)"))


@query(_rec("label_sets labels", _DOWN + f" select label_id, label_set_id, device_id, start_n, end_n from labels_t where label_set_id in (select label_set_id from d where root_id = 2) and device_id in (1, 2, 3, 4, 5, 6, 7, 8) and end_n >= {A_N} and start_n <= {B_N}"))
def labels_by_device(c):
    name = "AMERICA"
    return labels.find(c.labels, c.label_sets, [name], list(range(1, 9)), A_N, B_N).select("label_id", "label_set_id", "device_id", "start_n", "end_n")


_SPANS = f"+ ms as (select device_id, patient_id, start_n, coalesce(end_n, {NOW_N}) as end_n from mapping where patient_id in (301, 302, 400)), {islands('ms', 'device_id, patient_id')}"


@query(_with("mapping labels", _SPANS + " select label_id, patient_id, greatest(l.start_n, i.start_n) as start_n, least(l.end_n, i.end_n) as end_n from labels_t l join isl i on i.device_id = l.device_id and l.start_n < i.end_n and i.start_n < l.end_n"))
def labels_by_patient(c):
    out = labels.find(c.labels, c.label_sets, patients=[301, 302, 400], mapping=c.mapping, now_n=NOW_N)
    return out.select("label_id", "patient_id", "start_n", "end_n")


@query(_with("mapping labels", f"select l.label_id, min(m.patient_id) as patient_id from labels_t l left join mapping m on m.device_id = l.device_id and l.start_n >= m.start_n and l.end_n <= coalesce(m.end_n, {NOW_N}) group by 1"))
def labels_with_patient(c):
    return labels.with_patient(c.labels, c.mapping, NOW_N).select("label_id", "patient_id")


_GRID = f"g as (select device_id, unnest(range({A_N}, {B_N}, {HOUR_NS})) as time_n from (select distinct device_id from samples))"
_RASTER = f"{_GRID}, r as (select g.device_id, g.time_n, (count(l.label_id) > 0)::int as \"on\" from g left join labels_t l on l.device_id = g.device_id and l.start_n <= g.time_n and g.time_n <= l.end_n group by 1, 2)"


@query(_with("labels", f'+ {_RASTER} select device_id, time_n, "on" from r'))
def label_raster(c):
    return labels.raster_of(c.samples.select("device_id").distinct(), c.labels, ["device_id"], A_N, B_N, HOUR_NS)


@query(_with("labels", f'+ {_RASTER} select device_id, (time_n - {A_N}) // {6 * HOUR_NS} as win, round(avg("on"), 6) as share, (avg("on") > 0.3)::int as label from r group by 1, 2'))
def label_threshold(c):
    sources = c.samples.select("device_id").distinct()
    return labels.threshold_of(sources, c.labels, ["device_id"], A_N, B_N, HOUR_NS, 6, 0.3).withColumn("share", F.round("share", 6))


@query(_with("labels", f"+ {islands('labels_t', 'device_id, label_set_id', 24 * HOUR_NS)} select * from isl"))
def label_intervals(c):
    return labels.label_intervals(c.labels, 24 * HOUR_NS)


@query(_with("labels", f"+ r as (select distinct device_id, {A_N} as start_n, {B_N} as end_n from samples) select device_id, label_set_id, sum(least(l.end_n, r.end_n) - greatest(l.start_n, r.start_n))::bigint as duration_ns from labels_t l join r using (device_id) where l.start_n < r.end_n and r.start_n < l.end_n group by 1, 2"))
def label_durations(c):
    r = c.samples.select("device_id").distinct().select("device_id", F.lit(A_N).alias("start_n"), F.lit(B_N).alias("end_n"))
    return labels.label_durations(c.labels, r, ["device_id"])


# -- windows ----------------------------------------------------------------
DUR, SLIDE = 6 * HOUR_NS, 4 * HOUR_NS
_WIN = f"{_MEAS}, w as (select device_id, start_n, end_n, window_start_n, window_start_n + {DUR} as window_end_n from (select *, unnest(range(start_n, end_n, {SLIDE})) as window_start_n from m5))"


def _windows(c):
    return windows.enumerate_windows(_by_measure(c, 5), DUR, SLIDE)


@query(_with("samples", f"+ {_WIN} select device_id, start_n, end_n, ((window_start_n - start_n) // {SLIDE})::int as window_no, window_start_n, window_end_n from w"))
def window_enumerate(c):
    return _windows(c)


_SLOTS = f"s as (select w.device_id, window_start_n, round_even((time_n - window_start_n)::decimal(38, 6) / {HOUR_NS}, 0)::bigint as slot, arg_max(value, time_n) as value from w join samples x on x.device_id = w.device_id and x.measure_id = 5 and time_n >= window_start_n and time_n < least(window_end_n, end_n) group by 1, 2, 3)"


@query(_with("samples", f"+ {_WIN}, {_SLOTS} select * from s where slot < {DUR // HOUR_NS}"))
def window_values(c):
    return windows.slots(_windows(c), c.samples.where("measure_id = 5"), ["device_id"], HOUR_NS)


@query(_with("samples", f"+ {_WIN}, {_SLOTS}, n as (select device_id, window_start_n, count(*) as n from s where slot < 6 group by 1, 2) select device_id, window_start_n, {DUR // HOUR_NS}::bigint as expected_count, coalesce(n, 0) as actual_count from w left join n using (device_id, window_start_n)"))
def window_counts(c):
    return windows.matrix(_windows(c), c.samples.where("measure_id = 5"), ["device_id"], DUR, HOUR_NS).drop("values")


@query(_with("samples", f"+ {_WIN}, {_SLOTS}, n as (select device_id, window_start_n from s where slot < 6 group by 1, 2 having count(*) >= 2), k as (select device_id, window_start_n as start_n, least(window_end_n, end_n) as end_n from w join n using (device_id, window_start_n)), {islands('k', 'device_id')} select * from isl"))
def window_filtered(c):
    win = _windows(c)
    good = windows.matrix(win, c.samples.where("measure_id = 5"), ["device_id"], DUR, HOUR_NS).where("actual_count >= 2").select("device_id", "window_start_n")
    return windows.accepted_ranges(win.join(good, ["device_id", "window_start_n"]), ["device_id"])


@query(_with("samples", f"+ {_MEAS}, n as (select *, (end_n - 1 - start_n) // {SLIDE} + 1 as n_windows from m5) select device_id, start_n, end_n, n_windows, coalesce(sum(n_windows) over (order by device_id, start_n rows between unbounded preceding and 1 preceding), 0)::bigint as first_idx from n"))
def window_light_index(c):
    return windows.light_index(_by_measure(c, 5), ["device_id"], DUR, SLIDE)


@query(_with("encounters history", f"+ w as (select id, patient_id, start_n + {DAY_NS} as window_start_n from encounters) select w.id as win, w.patient_id, window_start_n, h.value as \"R\" from w asof left join (select patient_id, time_n, arg_max(value, id) as value from history where field = 'R' group by 1, 2) h on w.patient_id = h.patient_id and w.window_start_n >= h.time_n"))
def window_patient_asof(c):
    w = c.encounters.select(F.col("id").alias("win"), "patient_id", (F.col("start_n") + DAY_NS).alias("window_start_n"))
    return windows.with_patient_values(w, c.placed_history, "R", ("id", "earlier"))


@query(_with("labels", f"+ {_WIN}, {islands('lb', 'device_id', 0, 'lu').replace('from lb', f'from (select device_id, start_n, end_n + 1 as end_n from labels_t) lb')}, gp as (select device_id, window_start_n, unnest(range(6)) * {HOUR_NS} + window_start_n as t from w), r as (select gp.device_id, window_start_n, t, max((l.start_n is not null)::int) as o from gp left join labels_t l on l.device_id = gp.device_id and l.start_n <= t and t <= l.end_n group by 1, 2, 3) select device_id, window_start_n, round(avg(o), 6) as share, (avg(o) > 0.3)::int as label from r group by 1, 2 having max(o) = 1"))
def window_labels(c):
    one = c.labels.withColumn("label_set_id", F.lit(1).cast("long"))
    out = windows.label_windows(_windows(c), one, ["device_id"], DUR, HOUR_NS, 0.3)
    return out.where("share > 0").select("device_id", "window_start_n", F.round("share", 6).alias("share"), "label")


@query()
def window_signals(c):
    """Multi-rate windows as nested rows (arrays with NaN have no common SQL form)."""
    m = c.measures.withColumn("period_ns", F.when(F.col("measure_id") == 5, HOUR_NS).otherwise(2 * HOUR_NS)).where("measure_id in (1, 5)")
    return windows.signals(_windows(c), c.samples, m, DUR)


# -- definitions and splits -------------------------------------------------
def _definition():
    d = df_.Definition.from_dict({"measures": ["view"], "device_ids": {1: "all", 2: [{"start": A_N}], 3: [{"end": B_N}, {"time0": B_N + DAY_NS, "pre": HOUR_NS, "post": 3 * HOUR_NS}], 4: [{"start": A_N, "end": B_N}]}})
    return d.combine(df_.Definition.from_dict({"measures": ["click"], "device_ids": {4: [{"start": B_N - DAY_NS, "end": B_N + DAY_NS}], 5: "all"}}))


_SPEC = f"""en as (select device_id, min(start_n) as s, max(end_n) as e from m5 group by 1),
    raw as (select device_id, start_n, end_n from m5 where device_id in (1, 5) union all select device_id, {A_N}, e from en where device_id = 2 union all select device_id, s, {B_N} from en where device_id = 3
      union all select device_id, {B_N + DAY_NS - HOUR_NS}, {B_N + DAY_NS + 3 * HOUR_NS} from en where device_id = 3 union all select device_id, {A_N}, {B_N} from en where device_id = 4 union all select device_id, {B_N - DAY_NS}, {B_N + DAY_NS} from en where device_id = 4), {islands('raw', 'device_id', 0, 'spec')}"""


@query(_with("samples", f"+ {_MEAS}, {_SPEC} select * from spec"))
def definition_time_specs(c):
    return df_.resolve(_definition().specs(c.spark, "device_ids"), _by_measure(c, 5), "device_id")


@query(_with("mapping", f"+ {_MEAS}, {_SPEC}, m as (select device_id, patient_id, start_n, coalesce(end_n, {NOW_N + 400 * DAY_NS}) as end_n from mapping), x as (select spec.device_id, m.patient_id, greatest(spec.start_n, m.start_n) as start_n, least(spec.end_n, m.end_n) as end_n from spec join m on spec.device_id = m.device_id and spec.start_n < m.end_n and m.start_n < spec.end_n), {islands('x', 'device_id, patient_id', 0, 'y')} select patient_id, sum(end_n - start_n)::bigint as duration_ns from y group by 1"))
def validated_definition(c):
    out = df_.validate(_definition(), c.spark, _by_measure(c, 5), c.mapping, NOW_N + 400 * DAY_NS)
    return out.where("patient_id is not null").groupBy("patient_id").agg(F.sum(F.col("end_n") - F.col("start_n")).alias("duration_ns"))


_PART = f"{_MEAS}, p as (select device_id, case when device_id % 10 < 7 then 0 when device_id % 10 < 9 then 1 else 2 end as part, sum(end_n - start_n) as d from m5 group by 1, 2)"


def _parts(c):
    return splits.modulo_split(iv.duration(_by_measure(c, 5), ["device_id"]), "device_id", [7, 2, 1])


@query(_with("samples", f"+ {_PART} select part, sum(d)::bigint as duration_ns, count(distinct device_id) as n_sources from p group by 1"))
def partition_durations(c):
    """A row a part. BIGINT as in the SQL where it has a result; its cast raises beyond, and there the exact total is a decimal."""
    t = partition_durations_of(c)
    rows = t.collect()  # one row a part
    kind = "long" if all(r["duration_ns"] < 2**63 for r in rows) else "decimal(38,0)"
    made = [(r["part"], int(r["duration_ns"]) if kind == "long" else r["duration_ns"], r["n_sources"]) for r in rows]
    return c.spark.createDataFrame(made, f"part int, duration_ns {kind}, n_sources long")


@query(_with("samples", f"+ {_PART}, t as (select part, sum(d) as a, count(*) as b from p group by 1), s as (select a / sum(a) over () - w as ea, b / sum(b) over () - w as eb from t join (values (0, 0.7), (1, 0.2), (2, 0.1)) v(part, w) using (part)) select round((sqrt(avg(ea * ea)) + sqrt(avg(eb * eb))) / 2, 9) as error from s"))
def partition_error(c):
    t = partition_durations_of(c).withColumns({m: F.col(m).cast("double") for m in ("duration_ns", "n_sources")})
    return aggregates.ratio_error(t, "part", ["duration_ns", "n_sources"], {0: 0.7, 1: 0.2, 2: 0.1}).select(F.round("error", 9).alias("error"))


def partition_durations_of(c):
    return aggregates.partition_totals(iv.duration(_by_measure(c, 5), ["device_id"]), _parts(c), "device_id")


@query(
    _with(
        "samples",
        """+ f as (select distinct device_id, device_id % 5 as fold from samples), v as (select unnest(range(5)) as v), t as (select v, unnest(range(5)) as t from v), c as (select v, t, row_number() over (order by v, t) - 1 as split_no from t where v <> t)
    select split_no::bigint as split_no, case when fold = v then 'val' when fold = t then 'test' else 'train' end as role, count(*) as n from f, c group by 1, 2""",
    )
)
def cv_folds(c):
    s = c.samples.select("device_id").distinct()
    return splits.fold_roles(s, "device_id", 5).groupBy("split_no", "role").agg(F.count("*").alias("n"))


# -- writes -----------------------------------------------------------------
def _twice(c):
    s = c.samples.select(*KEYS, "time_n", "value", "write_seq")
    return s.unionByName(s.where("write_seq % 3 = 0").withColumn("value", F.col("value") + 1).withColumn("write_seq", F.col("write_seq") + 10_000_000))


_TWICE = "t as (select measure_id, device_id, time_n, value, write_seq from samples union all select measure_id, device_id, time_n, value + 1, write_seq + 10000000 from samples where write_seq % 3 = 0)"


def _dedup_sql(direction: str) -> str:
    return _with("samples", f"+ {_TWICE} select measure_id, device_id, time_n, value, write_seq from (select *, row_number() over (partition by measure_id, device_id, time_n order by write_seq {direction}) as n from t) where n = 1")


@query(_dedup_sql("asc"))
def dedup_first_wins(c):
    return scan.dedup(_twice(c), KEYS, "first")


@query(_dedup_sql("desc"))
def dedup_last_wins(c):
    return scan.dedup(_twice(c), KEYS, "last")


@query(_with("samples", "+ n as (select measure_id, device_id, time_n, value * 2 as value from samples where tag = 'error') select measure_id, device_id, time_n, value from n union all select s.measure_id, s.device_id, s.time_n, s.value from samples s where not exists (select 1 from n where n.measure_id = s.measure_id and n.device_id = s.device_id and n.time_n = s.time_n)"))
def overwrite_merge(c):
    new = c.samples.where("tag = 'error'").select(*KEYS, "time_n", (F.col("value") * 2).alias("value"))
    return messages.merge_samples(c.samples, new, KEYS)


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def vacuum_anti(c):
    used = c.table("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return c.table("orders").join(used, "o_orderkey", "left_anti").select("o_orderkey")


@query(_with("samples", f"select s.measure_id, s.device_id + 1000 as device_id, time_n - {DAY_NS} as time_n, value from samples s where s.device_id in (1, 2, 3) and time_n >= {A_N} and time_n < {B_N}"))
def transfer_shifted(c):
    ids = c.samples.select("device_id").distinct().where("device_id in (1, 2, 3)")
    r = ids.select("device_id", F.lit(A_N).alias("start_n"), F.lit(B_N).alias("end_n"))
    m = ids.withColumn("new_device_id", F.col("device_id") + 1000)
    return files.transfer(c.samples, r, m, -DAY_NS).select("measure_id", "device_id", "time_n", "value")


# -- order, aggregates, metadata --------------------------------------------
@query(_with("samples", "select measure_id, count(*) as n_rows from samples group by 1 order by 2 desc, 1 limit 1"))
def best_measure_topk(c):
    return aggregates.best_measures(c.samples, c.measures).select("measure_id", "n_rows").limit(1)


@query(_with("labels", "select label_id, start_n, end_n from labels_t order by start_n, end_n, label_id limit 20 offset 5"))
def sort_limit_offset(c):
    return labels.find(c.labels, c.label_sets, limit=20, offset=5).select("label_id", "start_n", "end_n")


@query(_with("history", "select distinct field from history"))
def distinct_fields(c):
    return c.history.select("field").distinct()


@query(_with("samples", "+ h as (select measure_id, floor(value) as v, count(*) as n from samples group by 1, 2) select measure_id, round(log2(sum(n)::double) - sum(n * log2(n::double)) / sum(n)::double, 6) as entropy, count(*) as n_distinct from h group by 1"))
def entropy_by_measure(c):
    s = c.samples.withColumn("v", F.floor("value"))
    return aggregates.entropy(s, ["measure_id"], "v").withColumn("entropy", F.round("entropy", 6))


@query(_with("samples", "select measure_id, floor(value)::bigint as v, count(*) as n from samples group by 1, 2"))
def value_histogram(c):
    return aggregates.histogram(c.samples.withColumn("v", F.floor("value")), ["measure_id"], "v")


@query("select c_custkey as patient_id, c_name as mrn from customer where c_mktsegment like '%BUILD%' and c_acctbal > 0")
def metadata_search(c):
    return c.table("customer").where(F.col("c_mktsegment").contains("BUILD") & (F.col("c_acctbal") > 0)).select(F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("mrn"))


@query(_with("devices", "select device_id, tag, type, bed_id, n_name as bed from devices join nation on n_nationkey = bed_id"))
def device_info(c):
    return c.devices.join(c.table("nation").select(F.col("n_nationkey").cast("long").alias("bed_id"), F.col("n_name").alias("bed")), "bed_id")


_BLOCKS = f"b as (select *, least((row_number() over (partition by measure_id, device_id, chunk order by time_n) - 1) // 4, greatest(1, count(*) over (partition by measure_id, device_id, chunk) // 4) - 1)::bigint as block from (select *, (time_n // {30 * DAY_NS})::bigint as chunk from samples))"


@query(_with("samples", f"+ {_BLOCKS} select measure_id, device_id, chunk, block, min(time_n) as start_n, max(time_n) as end_n, count(*) as num_vals, min(value) as v_min, max(value) as v_max from b group by 1, 2, 3, 4"))
def block_encode(c):
    return blocks.encode(c.samples, KEYS, 4).drop("times", "values")


@query(_with("samples", "select measure_id, device_id, time_n, value from samples"))
def block_round_trip(c):
    return blocks.decode(blocks.encode(c.samples, KEYS, 4), KEYS)


@query(_with("samples", f"+ {_BLOCKS}, h as (select measure_id, device_id, min(time_n) as start_n, max(time_n) as end_n, count(*) > 4 as long from b group by 1, 2, chunk, block), o as (select *, case when lag(long) over w is distinct from long or row_number() over w = 1 then 1 else 0 end as o from h window w as (partition by measure_id, device_id order by start_n, end_n)), g as (select *, sum(o) over (partition by measure_id, device_id order by start_n, end_n rows unbounded preceding) as g from o) select measure_id, device_id, long, min(start_n) as start_n, max(end_n) as end_n, count(*) as n_blocks from g group by 1, 2, 3, g"))
def block_header_groups(c):
    h = blocks.encode(c.samples, KEYS, 4).select(*KEYS, "start_n", "end_n", (F.col("num_vals") > 4).alias("long"))
    return blocks.header_groups(h, KEYS, ["long"])


@query(_with("samples", "select measure_id, tag, count(*) as n_rows from samples where tag like '%r%' group by 1, 2"))
def measure_search(c):
    found = c.measures.where(F.col("tag").contains("r") & (F.col("freq_nhz") == 277777))
    return aggregates.best_measures(c.samples, found).select("measure_id", "tag", "n_rows")


@query(_with("samples mapping", f"+ c as (select device_id, min(time_n) as s from samples group by 1) select m.patient_id, count(*) as n_devices, min(greatest(m.start_n, c.s)) as first_n from mapping m join c using (device_id) where coalesce(m.end_n, {NOW_N}) > c.s group by 1"))
def patient_devices(c):
    first = c.samples.groupBy("device_id").agg(F.min("time_n").alias("s"))
    m = c.mapping.join(first, "device_id").where(joins.closed_end(F.col("end_n"), NOW_N) > F.col("s"))
    return m.groupBy("patient_id").agg(F.count("*").alias("n_devices"), F.min(F.greatest("start_n", "s")).alias("first_n"))


@query("select p.o_custkey as patient_id, count(distinct l_returnflag) as n_fields, min(l_shipdate) as first_seen from lineitem join orders p on l_orderkey = o_orderkey where l_shipdate between timestamp '1995-01-01' and timestamp '1996-01-01' group by 1")
def history_range(c):
    low, high = 788_918_400_000_000_000, 820_454_400_000_000_000
    h = c.history.where(F.col("time_n").between(low, high))
    out = h.groupBy("patient_id").agg(F.count_distinct("field").alias("n_fields"), F.min("time_n").alias("t"))
    return out.select("patient_id", "n_fields", F.timestamp_micros(units.floor_div(F.col("t"), 1000)).cast("timestamp_ntz").alias("first_seen"))


# -- streaming, in its batch form -------------------------------------------
@query(_with("samples", f"select device_id, measure_id, (time_n // {6 * HOUR_NS} * {6 * HOUR_NS} // 1000)::bigint as start_us, ((time_n // {6 * HOUR_NS} + 1) * {6 * HOUR_NS} // 1000)::bigint as end_us, count(*) as n, round(avg(value), 6) as mean from samples group by 1, 2, 3, 4"))
def stream_windows(c):
    from ..streaming import ingest

    config = ingest.WindowConfig(size="6 hours")
    return ingest.windowed(ingest.prepared(c.samples, config), config).withColumn("mean", F.round("mean", 6))


@query(
    _with(
        "samples",
        f"+ o as (select *, case when time_n - lag(time_n) over w >= {12 * HOUR_NS} then 1 else 0 end as o from samples window w as (partition by device_id, measure_id order by time_n)), g as (select *, sum(o) over (partition by device_id, measure_id order by time_n rows unbounded preceding) as g from o) select device_id, measure_id, (min(time_n) // 1000)::bigint as start_us, (max(time_n) // 1000 + {12 * HOUR_NS // 1000})::bigint as end_us, count(*) as n from g group by 1, 2, g",
    )
)
def stream_sessions(c):
    from ..streaming import ingest

    return ingest.sessions(ingest.prepared(c.samples, ingest.WindowConfig()), "12 hours")


def _more() -> None:
    from . import registry_more  # noqa: F401  (adds its queries here)


def queries() -> dict:
    _more()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(SQL)



