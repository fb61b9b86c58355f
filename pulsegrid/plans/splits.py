"""Stratified partitions and cross-validation folds over sources."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations
from math import comb, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_split(sources: DataFrame, key: str, ratios: list[int], seed: int = 0) -> DataFrame:
    """key, part: a stateless split by hash, for any number of sources."""
    bounds, total, below = F.lit(None).cast("int"), sum(ratios), 0
    spot = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(total))
    part = F.when(F.lit(False), bounds)
    for k, r in enumerate(ratios):
        below += r
        part = part.when(spot < below, k)
    return sources.select(key, part.alias("part"))


def modulo_split(sources: DataFrame, key: str, ratios: list[int]) -> DataFrame:
    """As hash_split, by the key's remainder: the form that SQL engines share."""
    spot, below, part = F.pmod(F.col(key), F.lit(sum(ratios))), 0, F.when(F.lit(False), F.lit(None).cast("int"))
    for k, r in enumerate(ratios):
        below += r
        part = part.when(spot < below, k)
    return sources.select(key, part.alias("part"))


def stratify(items: list[tuple], ratios: list[float], seed: int = 0) -> list[int]:
    """Greedy: items (key, amounts) in a seeded order go where the relative deficit is largest.

    Every item gets one part; the parts' shares of each amount approach the ratios.
    The items are sources (one row each), held on the driver.
    """
    if any(r <= 0 for r in ratios):
        raise ValueError("ratios are positive")
    share = [r / sum(ratios) for r in ratios]
    n = len(items[0][1]) if items else 0
    totals = [sum(x[1][j] for x in items) or 1 for j in range(n)]
    held = [[0.0] * n for _ in ratios]
    order = sorted(range(len(items)), key=lambda i: str(items[i][0]))
    random.Random(seed).shuffle(order)
    out = [0] * len(items)
    for i in order:
        need = [sum((s - h / t) for h, t in zip(held[p], totals, strict=True) for s in [share[p]]) / share[p] for p in range(len(ratios))]
        best = max(range(len(ratios)), key=lambda p: (need[p], -p))
        out[i] = best
        for j in range(n):
            held[best][j] += items[i][1][j]
    return out


def split_error(items: list[tuple], parts: list[int], ratios: list[float]) -> float:
    share = [r / sum(ratios) for r in ratios]
    n = len(items[0][1]) if items else 0
    errors = []
    for j in range(n):
        total = sum(x[1][j] for x in items) or 1
        got = [sum(x[1][j] for x, p in zip(items, parts, strict=True) if p == k) / total for k in range(len(ratios))]
        errors.append(sqrt(sum((a - b) ** 2 for a, b in zip(got, share, strict=True)) / len(ratios)))
    return sum(errors) / max(1, len(errors))


def partition(items: list[tuple], ratios: list[float], trials: int = 8, seed: int = 0) -> tuple[list[int], float]:
    """The best of several seeded greedy partitions, and its error."""
    seeds = random.Random(seed).sample(range(2**31 - 1), trials)
    tries = [stratify(items, ratios, s) for s in seeds]
    best = min(tries, key=lambda t: split_error(items, t, ratios))
    return best, split_error(items, best, ratios)


def fold_combinations(n: int, val: int = 1, test: int = 1) -> Iterator[tuple[tuple, tuple, tuple]]:
    """(train, val, test) fold numbers: C(n, val) * C(n - val, test) of them."""
    for v in combinations(range(n), val):
        rest = [k for k in range(n) if k not in v]
        for t in combinations(rest, test):
            yield tuple(k for k in rest if k not in t), v, t


def n_combinations(n: int, val: int = 1, test: int = 1) -> int:
    return comb(n, val) * comb(n - val, test)


def fold_roles(sources: DataFrame, key: str, n: int, val: int = 1, test: int = 1) -> DataFrame:
    """key, fold, split_no, role: each source's role in each combination of folds."""
    spark = sources.sparkSession
    rows = []
    for no, (train, v, t) in enumerate(fold_combinations(n, val, test)):
        rows += [(f, no, "train") for f in train] + [(f, no, "val") for f in v] + [(f, no, "test") for f in t]
    roles = spark.createDataFrame(rows, "fold long, split_no long, role string")
    return sources.select(key, F.pmod(F.col(key), F.lit(n)).cast("long").alias("fold")).join(F.broadcast(roles), "fold")  # n folds: bounded by the call
