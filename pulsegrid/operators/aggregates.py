"""Aggregates over samples and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_per_measure(samples: DataFrame) -> DataFrame:
    return samples.groupBy("measure_id").agg(F.count("*").alias("n_rows"))


def best_measures(samples: DataFrame, measures: DataFrame, tag: str | None = None) -> DataFrame:
    """Measures by how many rows they have, most first (ties: least id)."""
    chosen = measures if tag is None else measures.where(F.col("tag") == tag)
    return chosen.join(rows_per_measure(samples), "measure_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).orderBy(F.desc("n_rows"), "measure_id")


def histogram(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*keys, value).agg(F.count("*").alias("n"))


def entropy(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Shannon entropy in bits: log2(N) - sum(n log2 n) / N, from the value histogram."""
    h = histogram(samples, keys, value)
    n = F.sum("n").cast("double")
    return h.groupBy(*keys).agg((F.log2(n) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n).alias("entropy"), F.count("*").alias("n_distinct"))


def latest_history(history: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """patient_id, field, value, time_n of the newest row of each field; of several the one with the greatest ``ties``."""
    return history.groupBy("patient_id", "field").agg(F.max_by("value", F.struct("time_n", *ties)).alias("value"), F.max("time_n").alias("time_n"))


def partition_totals(durations: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """part, duration_ns (decimal: nanoseconds of many sources are beyond a BIGINT), n_sources of each partition."""
    total = F.sum(F.col("duration_ns").cast("decimal(19,0)")).cast("decimal(38,0)")
    return durations.join(parts, key).groupBy("part").agg(total.alias("duration_ns"), F.count_distinct(key).alias("n_sources"))


def ratio_error(shares: DataFrame, by: str, metrics: list[str], targets: dict[str, float]) -> DataFrame:
    """Mean over the metrics of the root mean square distance of each partition's share to its target."""
    totals = shares.agg(*[F.sum(m).alias(m) for m in metrics])
    wanted = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    rows = shares.select(F.element_at(wanted, F.col(by)).alias("__t"), *[F.col(m).alias(f"__{m}") for m in metrics]).crossJoin(F.broadcast(totals))  # one row of totals
    return rows.agg(F.expr("(" + " + ".join(f"sqrt(avg(power(__{m} / {m} - __t, 2)))" for m in metrics) + f") / {len(metrics)}").alias("error"))
