"""Connected components of a link table, on the cluster unless the caller lets the driver join a few links.

Alternating large-star and small-star rounds: every node points its larger (then
smaller-or-equal) neighbours at the least node it knows. The number of rounds is
logarithmic in practice and each moves O(links) rows; the neighbour minimum is a
partially aggregated ``min``, so a hub costs one row per task, and it is written
before it is joined back, so that adaptive execution can split the hub's rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): for each u of pairs(u, v) the least of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _on_driver(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(u, v), by union and find."""
    found = edges.toArrow()
    parent: dict = {}

    def find(k):
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    for u, v in zip(found.column("u").to_pylist(), found.column("v").to_pylist(), strict=True):
        low, high = sorted((find(u), find(v)))
        parent[high] = low
    nodes, kind = list(parent), found.schema.field("u").type
    rows = pa.table({"node": pa.array(nodes, kind), "component": pa.array(map(find, nodes), kind)})
    return edges.sparkSession.createDataFrame(rows, edges.select(F.col("u").alias("node"), F.col("v").alias("component")).schema)


def connected_components(links: DataFrame, left: str, right: str, name: str = "cc", few: int = 0) -> DataFrame:
    """One row (node, component) for every node that occurs in ``links``.

    ``component`` is the least node reachable. Self-links and null ends are ignored;
    an empty link table gives an empty result. Repeated links are harmless. Up to ``few`` links
    are joined by the driver in one step; nodes are then numbers or bytes.
    """
    edges = (
        links.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = materialise(edges, f"{name}-edges")
    if few and edges.count() <= few:
        groups = materialise(_on_driver(edges), f"{name}-groups")
        release(edges)
        return groups
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(_least(both), f"{name}-big")
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = materialise(big, f"{name}-large")
        release(edges, least)
        least = materialise(_least(big), f"{name}-small")
        small = big.join(least, "u")
        small = small.select("v", "m").where("v <> m").unionByName(small.select(F.col("u").alias("v"), "m")).where("v <> m")
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-edges")
        release(big, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
