"""Range scans and what follows them: trimming, dedup, sorting, gap filling, batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.units import ceil_div, floor_div
from . import intervals as iv
from . import joins

DAY_NS = iv.DAY_NS


def trim(samples: DataFrame, start_n: int | None = None, end_n: int | None = None) -> DataFrame:
    """start <= t < end, in a form that reaches the Parquet reader (and the day partitions, if any)."""
    for bound, low in ((start_n, True), (end_n, False)):
        if bound is not None:
            samples = samples.where(F.col("time_n") >= bound if low else F.col("time_n") < bound)
            if "day" in samples.columns:
                samples = samples.where(F.col("day") >= bound // DAY_NS if low else F.col("day") <= (bound - 1) // DAY_NS)
    return samples


def dedup(samples: DataFrame, keys: list[str], keep: str = "last", order: str = "write_seq") -> DataFrame:
    """One sample for each key and time: the first or last written."""
    direction = F.col(order).asc() if keep == "first" else F.col(order).desc()
    w = W.partitionBy(*keys, "time_n").orderBy(direction)
    return samples.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def range_scan(
    samples: DataFrame,
    measure_id: int | list[int] | None = None,
    start_n: int | None = None,
    end_n: int | None = None,
    device_id: int | list[int] | None = None,
    patient_id: int | None = None,
    mapping: DataFrame | None = None,
    now_n: int = 2**62,
    sort: bool = True,
    allow_duplicates: bool = True,
    clip: bool = True,
) -> DataFrame:
    """Half-open scan of measures, by device or through a patient's mapping.

    A patient's samples are those of the mapped devices inside the mapped times
    (``clip``), each once even where mapping rows overlap.
    """
    out = trim(samples, start_n, end_n)
    for name, wanted in (("measure_id", measure_id), ("device_id", device_id)):
        if wanted is not None:
            out = out.where(F.col(name).isin(wanted) if isinstance(wanted, list) else F.col(name) == wanted)
    if patient_id is not None:
        if mapping is None:
            raise ValueError("a scan by patient needs the mapping")
        rows = mapping.where(F.col("patient_id") == patient_id)
        rows = joins.mapping_range(rows, start_n if start_n is not None else -(2**62), end_n if end_n is not None else 2**62)
        spans = iv.union(rows.withColumn("end_n", joins.closed_end(F.col("end_n"), now_n)), ["device_id"])
        if clip:
            spans = iv.clip(spans, start_n, end_n)
            spans = spans.withColumnsRenamed({"start_n": "__s", "end_n": "__e"})
            out = out.join(spans, "device_id").where("time_n >= __s and time_n < __e").drop("__s", "__e")
        else:
            out = out.join(spans.select("device_id").distinct(), "device_id", "left_semi")
    if not allow_duplicates:
        out = dedup(out, ["measure_id", "device_id"])
    return out.orderBy("measure_id", "device_id", "time_n") if sort else out


def grid(start_n: int, end_n: int, period_ns: int, keys: DataFrame) -> DataFrame:
    """keys x slots: the regular times of the range; ``round((end - start) / period)`` slots."""
    n = round((end_n - start_n) / period_ns)
    if n <= 0:
        return keys.select("*", F.lit(0).cast("long").alias("slot"), F.lit(start_n).alias("time_n")).where("false")
    return keys.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("time_n", F.lit(start_n) + F.col("slot") * period_ns)


def fill(samples: DataFrame, keys: list[str], start_n: int, end_n: int, period_ns: int, order: str = "write_seq") -> DataFrame:
    """keys, slot, time_n, value: a value for every slot, null where no sample rounds to it.

    Two samples of a slot: the later one by time, then by ``order``.
    """
    slot = F.bround((F.col("time_n") - start_n).cast("decimal(38,6)") / F.lit(period_ns), 0).cast("long")
    late = F.struct("time_n", order) if order in samples.columns else F.struct("time_n")
    held = trim(samples, start_n, end_n).withColumn("slot", slot).groupBy(*keys, "slot").agg(F.max_by("value", late).alias("value"))
    spine = grid(start_n, end_n, period_ns, samples.select(*keys).distinct())
    return spine.join(held, [*keys, "slot"], "left").select(*keys, "slot", "time_n", "value")


def row_windows(samples: DataFrame, keys: list[str], size: int, step: int, keep_last: bool = True) -> DataFrame:
    """keys, window_no, n, times, values: windows of ``size`` rows every ``step`` rows."""
    w = W.partitionBy(*keys).orderBy("time_n")
    rows = samples.withColumn("__rn", F.row_number().over(w) - 1)
    low, high = F.greatest(F.lit(0), ceil_div(F.col("__rn") - size + 1, step)), floor_div(F.col("__rn"), step)
    rows = rows.withColumn("window_no", F.explode(F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))))
    rows = rows.where(f"__rn >= window_no * {step} and __rn < window_no * {step} + {size}")
    out = rows.groupBy(*keys, "window_no").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("time_n", "value"))).alias("__r"))
    out = out.select(*keys, "window_no", "n", F.col("__r.time_n").alias("times"), F.col("__r.value").alias("values"))
    return out if keep_last else out.where(F.col("n") == size)


def batches(df: DataFrame, rows: int = 100_000) -> Iterator:
    """Arrow-backed pandas batches of bounded size, one partition ahead."""
    import pandas as pd

    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row.asDict())
        if len(held) == rows:
            yield pd.DataFrame(held)
            held = []
    if held:
        yield pd.DataFrame(held)


def blocks(samples: DataFrame, keys: list[str], width_ns: int = DAY_NS) -> DataFrame:
    """Block index and statistics: one row per key and time chunk (population deviation)."""
    return samples.groupBy(*keys, floor_div(F.col("time_n"), width_ns).alias("block")).agg(
        F.min("time_n").alias("start_n"), F.max("time_n").alias("end_n"), F.count("*").alias("num_vals"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.stddev_pop("value").alias("v_std")
    )


def blocks_in_range(block_index: DataFrame, start_n: int, end_n: int) -> DataFrame:
    """Blocks that touch the range, both ends inclusive (a block ends at its last sample)."""
    return block_index.where((F.col("end_n") >= start_n) & (F.col("start_n") <= end_n))
