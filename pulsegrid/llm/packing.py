"""Operator 3: best-fit packing of documents into sequences of a fixed token length.

The pieces' length histogram (at most ``capacity`` rows, whatever the corpus) goes
to the driver. There the configuration linear program, which covers the histogram
by fractional weights of patterns of lengths that fit one sequence, is solved by
multiplicative weights: a length's price falls by a factor with its cover, and patterns
are those of the highest price, found by a knapsack dynamic program. The weights are
rounded, and what is left is packed best-fit, longest first, again by whole patterns,
so that the driver's work depends on the capacity only.

The cluster then numbers the pieces of each length and reads each piece's place
off the pattern table. The numbering uses (length, hash bucket) groups of bounded
size, so that a length which a third of all pieces have is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise
from .tokens import END_ID, encoder, vocabulary

CAPACITY = 1024
ROWS_PER_BUCKET = 8192
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then id 2. One that is longer than ``capacity`` is cut
    into pieces of ``capacity``, of which only the first may be shorter.
    """
    path = path or vocabulary()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            doc, no, start, length, crc, ids = [], [], [], [], [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                all_ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                n = len(all_ids)
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k in range(len(edges) - 1):
                    part = all_ids[edges[k] : edges[k + 1]]
                    doc.append(key), no.append(k), start.append(edges[k]), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(no, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For every room the highest price that fits, and the index taken there (-1: the room below)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        value = best[c - lengths[: fit[c]]] + price[: fit[c]]
        k = int(value.argmax())
        best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] else (best[c - 1], -1)
    return best, choice.tolist()


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, eta: float = 0.3) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional pattern weights that cover the demand, and a lower bound of the linear program.

    Patterns are tuples of indices. The demand is met in phases, half as many as lengths (50 at
    least), of growing targets. In a phase every length that is behind the target is met by the
    pattern of the highest price that holds it; between phases a price falls by a factor with
    the length's cover beyond the target. The prices of each phase are also a solution of the
    dual program once scaled, which bounds the weights from below.
    """
    phases, sizes = max(50, len(lengths) // 2), lengths.tolist()
    weights: dict[tuple[int, ...], float] = {}
    cover, price = np.zeros(len(lengths)), lengths / capacity
    bound = 0.0
    for phase in range(1, phases + 1):
        target = (phase / phases) ** 2
        best, choice = _knapsack(lengths, price, capacity)
        bound = max(bound, float((demand * price).sum() / best[capacity]))
        for top in range(len(sizes) - 1, -1, -1):
            if cover[top] >= target:
                continue
            items, room = [top], capacity - sizes[top]
            while room > 0:
                k = choice[room]
                if k < 0:
                    room -= 1
                else:
                    items.append(k)
                    room -= sizes[k]
            pattern = tuple(sorted(items, reverse=True))
            held = Counter(pattern)
            weight = float((target - cover[top]) * demand[top] / held[top])
            for k, m in held.items():
                cover[k] += weight * m / demand[k]
            weights[pattern] = weights.get(pattern, 0.0) + weight
        price = lengths / capacity * np.exp(-eta * np.minimum(cover / target - 1, 3))
    return weights, bound


def rounded(weights: dict[tuple[int, ...], float], bound: float, left: np.ndarray) -> list[tuple[Counter, int]]:
    """Whole counts of the patterns, taken off ``left``; what cannot be taken stays there.

    The weights are scaled down to the bound; the fraction that rounding down cuts from a pattern
    goes to the next one, and no length is taken more often than it is left.
    """
    out, carry, scale = [], 0.0, min(1.0, bound / max(sum(weights.values()), 1e-9))
    for pattern in sorted(weights, reverse=True):
        carry += weights[pattern] * scale
        want = int(carry)
        carry -= want
        held = Counter(pattern)
        times = min(want, *(int(left[k]) // m for k, m in held.items()))
        if times:
            for k, m in held.items():
                left[k] -= m * times
            out.append((held, times))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, sequences) that hold the histogram exactly."""
    out: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        out.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(x for x, n in histogram.items() if n > 0 and x < capacity), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    if len(lengths):
        weights, bound = fractional(lengths, left.astype(float), capacity)
        out += [({int(lengths[k]): m for k, m in held.items()}, times) for held, times in rounded(weights, bound, left)]
    # best fit for the rest: the longest that is left, then what fills the gap best (an exact subset sum
    # over the lengths that are left)
    while left.any():
        room, pattern = capacity, Counter()
        top = int(np.flatnonzero(left)[-1])
        pattern[top] += 1
        room -= int(lengths[top])
        for k in _fill(lengths, left - np.bincount([top], minlength=len(lengths)), room):
            pattern[k] += 1
        times = min(int(left[k]) // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
        out.append(({int(lengths[k]): m for k, m in pattern.items()}, times))
    return out


def _fill(lengths: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """Indices whose lengths fill ``room`` best; up to three items by exact search, then longest first."""
    alive = np.flatnonzero((left > 0) & (lengths <= room))
    if not len(alive):
        return []
    sizes = lengths[alive]
    one = int(alive[-1])
    if sizes[-1] == room or len(alive) == 1 and left[one] < 2:
        chosen = [one]
    else:
        pairs = sizes[:, None] + sizes[None, :]
        pairs = np.where((pairs <= room) & ~(np.eye(len(alive), dtype=bool) & (left[alive] < 2)[:, None]), pairs, -1)
        i, j = divmod(int(pairs.argmax()), len(alive))
        chosen = [int(alive[i]), int(alive[j])] if pairs[i, j] > sizes[-1] else [one]
    rest = room - int(lengths[chosen].sum())
    if rest >= lengths[0]:
        left = left - np.bincount(chosen, minlength=len(lengths))
        chosen += _fill(lengths, left, rest)
    return chosen


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, first_sequence, offset): the pieces of that length whose
    ranks are in the half-open range go, one each, to consecutive sequences at that offset."""
    rows, used, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                rows.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    return rows


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are one piece, the end id alone. A null doc_id is kept.
    Repeated rows are packed as often as they occur. Other columns are not read.
    An empty table gives no rows.
    """
    cut = materialise(pieces(docs, capacity, path), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(solve(histogram, capacity))
    n_buckets = max(1, -(-sum(histogram.values()) // ROWS_PER_BUCKET))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_buckets)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    # the slot table has a few rows for each pattern, of which there are fewer than lengths times phases,
    # and best-fit patterns of the remainder: a bound that does not grow with the corpus
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            more = [pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), pa.array(row[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, PIECES + ", sequence_id long, offset long")
