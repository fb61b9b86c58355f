"""A block codec: values and times of a stretch of samples as one compressed byte string.

Layout of a block: a fixed header (``HEADER``), then the compressed times, then the compressed
values. Whole-number values are stored as differences of the order (0 to 5) whose histogram has
the least entropy, narrowed to 1, 2, 4 or 8 bytes; others as doubles. Times are a start and a
period with a gap array, or all times. Parquet stays the storage format of a dataset; this is for
files that travel as bytes. ``encode_frame`` and ``decode_frame`` run it over rows in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"PGB1"
#: magic, kind of values, order, width, kind of times, n, start_n, end_n, period_ns, minimum, maximum, bytes of times, of values
HEADER = struct.Struct("<4sBBBBqqqqddqq")
FIELDS = ("magic", "value_kind", "order", "width", "time_kind", "n", "start_n", "end_n", "period_ns", "v_min", "v_max", "time_bytes", "value_bytes")
WHOLE, DOUBLE = 1, 2
TIMES, GAPS = 1, 2
MAX_ORDER = 5
_PACK = zstandard.ZstdCompressor(level=3)


def compress(data: bytes) -> bytes:
    return _PACK.compress(data)


def decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def entropy(x: np.ndarray) -> float:
    """Shannon entropy of the values' histogram, in bits a value."""
    if not len(x):
        return 0.0
    p = np.unique(x, return_counts=True)[1] / len(x)
    return float(-(p * np.log2(p)).sum())


def delta(x: np.ndarray, order: int) -> np.ndarray:
    """Differences of the order; the first ``order`` members carry what the sum needs."""
    out = np.asarray(x, dtype=np.int64).copy()
    for k in range(order):
        out[k + 1 :] = np.diff(out[k:])
    return out


def undelta(x: np.ndarray, order: int) -> np.ndarray:
    out = np.asarray(x, dtype=np.int64).copy()
    for k in reversed(range(order)):
        out[k:] = np.cumsum(out[k:])
    return out


def best_order(x: np.ndarray) -> int:
    """The order whose differences have the least entropy; the lowest on ties."""
    return min(range(min(MAX_ORDER, max(0, len(x) - 1)) + 1), key=lambda k: (round(entropy(delta(x, k)), 9), k))


def width(x: np.ndarray) -> int:
    """Bytes that hold every value: 1, 2, 4 or 8."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    return next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))


def narrow(x: np.ndarray) -> tuple[int, bytes]:
    w = width(x)
    return w, x.astype(f"<i{w}").tobytes()


def widen(data: bytes, w: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{w}").astype(np.int64)


def time_kind(times: np.ndarray, period_ns: int) -> int:
    """Gaps where they take less room than the times, two numbers each."""
    return GAPS if period_ns > 0 and 2 * int((np.diff(times) != period_ns).sum()) < len(times) else TIMES


def buffer_bound(n: int) -> int:
    """Bytes that no block of n samples exceeds."""
    slack = lambda b: b + (b >> 7) + 1024
    return HEADER.size + slack(16 * n) + slack(8 * n)


def encode(times, values, period_ns: int) -> bytes:
    """One block of samples in order of time."""
    t, v = np.asarray(times, dtype=np.int64), np.asarray(values)
    if len(t) != len(v) or not len(t):
        raise ValueError("a block needs as many times as values, one at least")
    kind = time_kind(t, period_ns)
    if kind == GAPS:
        step = np.diff(t) - period_ns
        at = np.flatnonzero(step)
        packed_times = compress(np.concatenate((at + 1, step[at])).astype("<i8").tobytes())
    else:
        packed_times = compress(delta(t, 1).astype("<i8").tobytes())
    as_float = v.astype(np.float64)
    if np.isfinite(as_float).all() and (as_float == np.floor(as_float)).all() and np.abs(as_float).max() < 2**53 and not np.signbit(as_float[as_float == 0]).any():
        whole = as_float.astype(np.int64)
        order = best_order(whole)
        w, raw = narrow(delta(whole, order))
        value_kind = WHOLE
    else:
        value_kind, order, w, raw = DOUBLE, 0, 8, as_float.astype("<f8").tobytes()
    packed = compress(raw)
    finite = as_float[np.isfinite(as_float)]
    low, high = (float(finite.min()), float(finite.max())) if len(finite) else (float("nan"), float("nan"))
    end = int(t[-1]) + max(0, period_ns)
    return HEADER.pack(MAGIC, value_kind, order, w, kind, len(t), int(t[0]), end, period_ns, low, high, len(packed_times), len(packed)) + packed_times + packed


def header(data: bytes, at: int = 0) -> dict:
    found = dict(zip(FIELDS, HEADER.unpack_from(data, at), strict=True))
    if found["magic"] != MAGIC:
        raise ValueError("this is no block")
    return found


def headers(data: bytes) -> list[dict]:
    """Headers of all blocks that stand one after the other, each with its place (``at``, ``size``)."""
    out, at = [], 0
    while at < len(data):
        h = header(data, at)
        size = HEADER.size + h["time_bytes"] + h["value_bytes"]
        out.append({**h, "at": at, "size": size})
        at += size
    return out


def decode(data: bytes, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(times, values) of the block that starts at ``at``."""
    h = header(data, at)
    body = at + HEADER.size
    raw_times = np.frombuffer(decompress(data[body : body + h["time_bytes"]]), dtype="<i8")
    if h["time_kind"] == GAPS:
        steps = np.full(h["n"], h["period_ns"], dtype=np.int64)
        steps[0] = h["start_n"]
        half = len(raw_times) // 2
        steps[raw_times[:half]] += raw_times[half:]
        times = np.cumsum(steps)
    else:
        times = undelta(raw_times, 1)
    raw = decompress(data[body + h["time_bytes"] : body + h["time_bytes"] + h["value_bytes"]])
    values = undelta(widen(raw, h["width"]), h["order"]).astype(np.float64) if h["value_kind"] == WHOLE else np.frombuffer(raw, dtype="<f8")
    return times, values


def encode_many(times, values, period_ns: int, values_per_block: int) -> bytes:
    """All samples as blocks of at most ``values_per_block`` (a last short one joins the one before)."""
    n = len(times)
    cuts = [*range(0, n, values_per_block), n]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < values_per_block // 2:
        del cuts[-2]
    return b"".join(encode(times[a:b], values[a:b], period_ns) for a, b in zip(cuts, cuts[1:], strict=False))


def decode_all(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts = [decode(data, h["at"]) for h in headers(data)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0))


def coalesce_reads(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, at, size: byte ranges (keys, at, size) of a file joined where they touch."""
    from ..functions import messages

    rows = messages.contiguous(blocks.select(*keys, F.col("at").alias("start_n"), F.col("size").alias("n")), keys, F.lit(1))
    return rows.select(*keys, F.col("start_n").alias("at"), F.col("n").alias("size"))


BLOCK_ROW = "n long, start_n long, end_n long, v_min double, v_max double, block binary"


def _changes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the members of two columns differ; nulls are equal."""
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
    return other.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): whole runs of equal keys, of rows in the order of the keys, and the first row of each.

    Several runs come at a time; what is held is a batch and the run that is still open.
    """
    held: list[pa.RecordBatch] = []
    starts = [0]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= _changes(c.slice(1), c.slice(0, len(c) - 1))
            if held:
                new[0] |= _changes(c.slice(0, 1), held[-1].column(k).slice(held[-1].num_rows - 1))[0]
        cuts, before = np.flatnonzero(new), sum(b.num_rows for b in held)
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]), np.array([*starts, *(cuts[:-1] + before)])
            held = []
            batch = batch.slice(cuts[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held), np.array(starts)


def encode_frame(samples: DataFrame, keys: list[str], period_ns: int, chunk_ns: int) -> DataFrame:
    """keys, chunk, n, start_n, end_n, v_min, v_max, block: a block per signal and stretch of time.

    A stretch bounds what one task holds of a signal; samples of equal time keep the order of value.
    Stretches are sorted by Spark and come to Python many at a time.
    """
    parted = [*keys, "chunk"]
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    rows = samples.select(*keys, F.floor(F.col("time_n") / chunk_ns).cast("long").alias("chunk"), "time_n", F.col("value").cast("double").alias("value"))
    rows = rows.repartition(*parted).sortWithinPartitions(*parted, "time_n", F.asc_nulls_last("value"))

    def build(batches):
        for table, starts in runs(batches, parted):
            times, values = (table.column(c).to_numpy() for c in ("time_n", "value"))
            blocks = [encode(times[a:b], values[a:b], period_ns) for a, b in zip(starts, [*starts[1:], len(times)], strict=True)]
            found = [header(b) for b in blocks]
            same = [table.column(k).combine_chunks().take(pa.array(starts)) for k in parted]
            told = [pa.array([h[k] for h in found], kind) for k, kind in (("n", pa.int64()), ("start_n", pa.int64()), ("end_n", pa.int64()), ("v_min", pa.float64()), ("v_max", pa.float64()))]
            yield from _batches([*same, *told, pa.array(blocks, pa.binary())], [*parted, "n", "start_n", "end_n", "v_min", "v_max", "block"])

    return rows.mapInArrow(build, f"{kinds}, chunk long, {BLOCK_ROW}")


def _batches(columns: list, names: list[str]) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays(columns, names=names).to_batches()


def decode_frame(blocks: DataFrame, keys: list[str], rows: int = 65_536) -> DataFrame:
    """keys, time_n, value: the samples of encoded blocks, given on when ``rows`` of them have come together."""
    kinds = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def packed(batch, first, parts):
        counts = [len(t) for t, _ in parts]
        at = pa.array(np.repeat(np.arange(first, first + len(parts)), counts))
        times, values = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return _batches([*[batch.column(k).take(at) for k in keys], pa.array(times, pa.int64()), pa.array(values, pa.float64())], [*keys, "time_n", "value"])

    def read(batches):
        for batch in batches:
            first, parts, held = 0, [], 0
            for block in batch.column("block"):
                parts.append(decode_all(block.as_py()))
                held += len(parts[-1][0])
                if held >= rows:
                    yield from packed(batch, first, parts)
                    first, parts, held = first + len(parts), [], 0
            if parts:
                yield from packed(batch, first, parts)

    return blocks.select(*keys, "block").mapInArrow(read, f"{kinds}, time_n long, value double")
