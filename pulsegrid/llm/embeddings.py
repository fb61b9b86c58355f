"""Operator 2: embedding near-duplicates by a cover-tree dual traversal.

Vectors of one label are compared on the unit sphere, where cosine >= c means
distance <= sqrt(2 - 2c). Each label's vectors are dealt to cells around pivots,
chosen from a bounded sample (at most ``MAX_PIVOTS`` in all), and cells larger than
``BLOCK`` are dealt on into blocks. A cell's covering radius is a partial maximum.
A vector is a guest of each lesser cell that can hold a vector near it, by that cell's radius
and by the plane between the two pivots; blocks of a cell's own vectors meet each other and
blocks of guests in tasks of bounded size. Lists of guests and tasks hold ids and stay on the cluster; vectors are
joined to them last. In a task each block is a cover tree (nested levels, halving radii), and pairs of nodes
are pruned by the same bound down to single vectors, which are compared exactly.

Equal vectors are one from the start, and a task reports a count of links and one
root per vector, never its pairs, so copies and dense groups stay linear.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .components import connected_components

COSINE = 0.98
BLOCK = 1500
MAX_PIVOTS = 4096
SAMPLE_PER_PIVOT = 4
_SLACK = 1e-6
#: Numbers in one matrix of a Python worker.
_MATRIX = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


class CoverTree:
    """Nested levels over unit vectors: every point of level k + 1 lies within radius
    2**-k * first of its parent, and a parent is its own first child."""

    def __init__(self, x: np.ndarray, stop: float):
        self.x, n = x, len(x)
        # levels[k]: (indices of the points, position of each one's parent in level k - 1, covering radius)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        centres, owner, dist = np.zeros(1, dtype=np.int64), np.zeros(n, dtype=np.int64), self._distance(np.arange(n), np.zeros(1, dtype=np.int64))[:, 0] if n else np.zeros(0)
        self.levels.append((centres, np.zeros(1, dtype=np.int64), np.array([dist.max() if n else 0.0])))
        radius = dist.max() if n else 0.0
        cover = np.array([radius])
        while radius > stop and len(centres) < n:
            radius /= 2
            split, whole = np.flatnonzero(cover > radius), np.flatnonzero(cover <= radius)
            if not len(split):
                continue  # the level would repeat the one before
            # nodes that the radius covers already stay as they are
            place = np.full(len(centres), -1)
            place[whole] = np.arange(len(whole))
            new, new_parent = centres[whole].tolist(), whole.tolist()
            new_owner, new_dist = place[owner], dist.copy()
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
            for k in split:
                c, left = centres[k], order[cuts[k] : cuts[k + 1]]
                left = np.concatenate(([c], left[left != c]))  # nested: the centre stays a centre
                while len(left):
                    # a handful of centres at once: those of the first candidates that are apart
                    near = self._distance(left[:64], left[:64]) <= radius
                    taken: list[int] = []
                    for i in range(len(near)):
                        if not near[i, taken].any():
                            taken.append(i)
                    chosen = left[taken]
                    d = self._distance(left, chosen)
                    best = d.argmin(axis=1)
                    value = d[np.arange(len(left)), best]
                    best[taken], value[taken] = np.arange(len(taken)), 0.0
                    inside = value <= radius
                    new_owner[left[inside]], new_dist[left[inside]] = len(new) + best[inside], value[inside]
                    new += chosen.tolist()
                    new_parent += [int(k)] * len(chosen)
                    left = left[~inside]
            centres, owner, dist = np.array(new), new_owner, new_dist
            cover = np.zeros(len(centres))
            np.maximum.at(cover, owner, dist)
            self.levels.append((centres, np.array(new_parent), cover))
        if len(centres) < n:  # leaves: every point under its last centre
            self.levels.append((np.arange(n), owner, np.zeros(n)))

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.x[a] @ self.x[b].T)))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _children(parents_pos: np.ndarray, n_parents: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(parents_pos, kind="stable")
    return order, np.searchsorted(parents_pos[order], np.arange(n_parents + 1))


def dual_pairs(a: CoverTree, b: CoverTree, reach: float, step: int = 1 << 18):
    """Yield (i, j) index arrays of points that may lie within ``reach``."""
    stack = [(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    deep_a, deep_b = len(a.levels) - 1, len(b.levels) - 1
    while stack:
        k, pa_, pb_ = stack.pop()
        (ca, _, ra), (cb, _, rb) = a.level(k), b.level(k)
        gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", a.x[ca[pa_]], b.x[cb[pb_]])))
        keep = gap <= ra[pa_] + rb[pb_] + reach + _SLACK
        pa_, pb_ = pa_[keep], pb_[keep]
        if not len(pa_):
            continue
        if k >= deep_a and k >= deep_b:
            yield ca[pa_], cb[pb_]
            continue
        na, nb = len(a.level(k)[0]), len(b.level(k)[0])
        kids_a = _children(a.level(k + 1)[1], na) if k < deep_a else (np.arange(na), np.arange(na + 1))
        kids_b = _children(b.level(k + 1)[1], nb) if k < deep_b else (np.arange(nb), np.arange(nb + 1))
        size_a, size_b = np.diff(kids_a[1])[pa_], np.diff(kids_b[1])[pb_]
        total = size_a * size_b
        at = 0
        while at < len(pa_):
            end = at + max(1, int(np.searchsorted(np.cumsum(total[at:]), step)))
            x, y, n = pa_[at:end], pb_[at:end], total[at:end]
            if len(x) == 1 and n[0] > step:  # one dense pair of nodes: a product of matrices
                u, v = kids_a[0][kids_a[1][x[0]] : kids_a[1][x[0] + 1]], kids_b[0][kids_b[1][y[0]] : kids_b[1][y[0] + 1]]
                (da, _, sa), (db, _, sb) = a.level(k + 1), b.level(k + 1)
                for row in range(0, len(u), max(1, (1 << 21) // max(1, len(v)))):
                    part = u[row : row + max(1, (1 << 21) // max(1, len(v)))]
                    d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[da[part]] @ b.x[db[v]].T)))
                    i, j = np.nonzero(d <= sa[part][:, None] + sb[v][None, :] + reach + _SLACK)
                    if len(i):
                        stack.append((k + 1, part[i], v[j]))
            else:
                group = np.repeat(np.arange(len(x)), n)
                inside = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
                width = size_b[at:end][group]
                u = kids_a[0][kids_a[1][x][group] + inside // width]
                v = kids_b[0][kids_b[1][y][group] + inside % width]
                stack.append((k + 1, u, v))
            at = end


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def link_block(own: np.ndarray, other: np.ndarray | None, weights: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and a root (the least linked index) of each vector of a task.

    ``own`` against itself, or against ``other``; indices run over own, then other.
    """
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    a = CoverTree(_unit(own), reach / 2)
    b = a if other is None else CoverTree(_unit(other), reach / 2)
    shift = 0 if other is None else len(own)
    raw = _scaled(own if other is None else np.concatenate((own, other)))
    counts = np.zeros(len(raw), dtype=np.int64)
    parent = np.arange(len(raw))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in dual_pairs(a, b, reach):
        j = j + shift
        if other is None:
            keep = i < j
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 17):
            p, q = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            ok = _cosines(raw[p], raw[q]) >= cosine
            p, q = p[ok], q[ok]
            np.add.at(counts, p, weights[q])
            np.add.at(counts, q, weights[p])
            # components by hooking to the least root, a few vectorised rounds
            while len(p):
                rp, rq = parent[p], parent[q]
                while True:
                    up, uq = parent[rp], parent[rq]
                    if (up == rp).all() and (uq == rq).all():
                        break
                    rp, rq = up, uq
                low, high = np.minimum(rp, rq), np.maximum(rp, rq)
                differ = low < high
                if not differ.any():
                    break
                np.minimum.at(parent, high[differ], low[differ])
                p, q = p[differ], q[differ]
    root = np.array([find(k) for k in range(len(raw))], dtype=np.int64)
    return counts, root


def _rows(pdf: pd.DataFrame, index=slice(None)) -> np.ndarray:
    return np.array(pdf["x"].iloc[index].tolist(), dtype=np.float64)


def _by_net(pdf: pd.DataFrame, dims: np.ndarray):
    """((label, length of the vectors), rows) of a batch."""
    return pdf.groupby([pdf["label"].to_numpy(), dims]).indices.items()


def homes(x: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the distance to it."""
    cells, gaps, step = np.zeros(len(x), dtype=np.int64), np.zeros(len(x)), max(1, _MATRIX // len(net))
    for at in range(0, len(x), step):
        dot = _unit(x[at : at + step]) @ net.T
        cells[at : at + step], gaps[at : at + step] = dot.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * dot.max(axis=1)))
    return cells, gaps


def visits(x: np.ndarray, home: np.ndarray, net: np.ndarray, radii: np.ndarray, reach: float):
    """Yield (row, cell): the lesser cells that may hold a vector within ``reach`` of the row's.

    Such a cell's radius comes within reach, and so does the plane half way between its pivot and the row's own.
    """
    step = max(1, _MATRIX // len(net))
    wide = np.sqrt(np.maximum(0, 2 - 2 * (net @ net.T)))
    for at in range(0, len(x), step):
        unit, own = _unit(x[at : at + step]), home[at : at + step]
        dot = unit @ net.T
        over = dot[np.arange(len(own)), own][:, None] - dot
        near = (np.arange(len(net)) < own[:, None]) & (radii >= 0) & (over <= (reach + _SLACK) * wide[own] + 1e-9)
        near &= np.sqrt(np.maximum(0, 2 - 2 * dot)) <= radii + reach + _SLACK
        row, cell = np.nonzero(near)
        yield row + at, cell


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``cosine``. Null vectors, zero vectors and those with null or non-finite
    members link with nothing and are components of their own, as are rows with a
    null label or a null vec_id. Vectors of different lengths do not link. Repeated
    rows link with each other like other equal vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))
    usable = vectors.where(good).select("vec_id", "label", x.alias("x")).withColumn("h1", F.xxhash64("x", "label")).withColumn("h2", F.hash("x", F.lit(7)))
    # equal vectors are one node, weighted by their number; ids may repeat, so they name no node
    # (floats stay floats where vectors are stored and sent; arithmetic is in double)
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    unique = usable.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("x").cast("array<float>" if narrow else "array<double>").alias("x"))
    unique = materialise(unique.withColumn("rep", F.monotonically_increasing_id()), "emb-unique")
    n = unique.count()
    n_pivots = min(MAX_PIVOTS, max(1, -(-n // (block // 2))))
    pool = unique.select("label", "x", F.xxhash64("h1", "h2").alias("o")).orderBy("o").limit(n_pivots * SAMPLE_PER_PIVOT).collect()
    pivots: dict = {}
    for r in pool:  # bounded: at most MAX_PIVOTS * SAMPLE_PER_PIVOT rows
        pivots.setdefault((r["label"], len(r["x"])), []).append(r["x"])
    chosen = {}
    for key, found in pivots.items():
        unit = _unit(np.array(found, dtype=np.float64))
        want, picks = max(1, round(len(found) / SAMPLE_PER_PIVOT)), [0]
        gap = 1 - unit @ unit[0]
        while len(picks) < want and gap.max() > 1e-9:  # farthest first: pivots are a net
            picks.append(int(gap.argmax()))
            gap = np.minimum(gap, 1 - unit @ unit[picks[-1]])
        chosen[key] = unit[picks]
    nets = spark.sparkContext.broadcast(chosen)

    def place(batches):
        for pdf in batches:
            cells, gaps = np.full(len(pdf), -1, dtype=np.int64), np.zeros(len(pdf))
            dims = pdf["x"].map(len).to_numpy()
            for key, index in _by_net(pdf, dims):
                net = nets.value.get(key)
                if net is not None:  # else a label that the sample missed: one cell without guests
                    cells[index], gaps[index] = homes(_rows(pdf, index), net)
            yield pdf.assign(dim=dims.astype(np.int32), cell=cells, gap=gaps)[["label", "dim", "cell", "gap", "rep", "n", "x"]]

    kind, items = unique.schema["label"].dataType.simpleString(), unique.schema["x"].dataType.simpleString()
    placed = materialise(unique.select("label", "rep", "n", "x").mapInPandas(place, f"label {kind}, dim int, cell long, gap double, rep long, n long, x {items}"), "emb-cells")
    radii: dict = {key: np.full(len(net), -1.0) for key, net in chosen.items()}
    for r in placed.where("cell >= 0").groupBy("label", "dim", "cell").agg(F.max("gap").alias("radius")).collect():  # at most MAX_PIVOTS * SAMPLE_PER_PIVOT cells
        radii[(r["label"], r["dim"])][r["cell"]] = r["radius"]
    covers = spark.sparkContext.broadcast(radii)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))

    def visit(batches):
        for pdf in batches:
            for key, index in _by_net(pdf, pdf["dim"].to_numpy()):
                net = nets.value.get(key)
                if net is None:
                    continue
                home, rep = pdf["cell"].to_numpy()[index], pdf["rep"].to_numpy()[index]
                for at in range(0, len(index), 1024):
                    part = index[at : at + 1024]
                    for row, cell in visits(_rows(pdf, part), home[at : at + 1024], net, covers.value[key], reach):
                        yield pd.DataFrame({"label": pdf["label"].iloc[part[row]].to_numpy(), "dim": np.int32(key[1]), "cell": cell, "rep": rep[at + row]})

    cell = ["label", "dim", "cell"]
    guests = materialise(placed.select(*cell, "rep", "x").mapInPandas(visit, f"label {kind}, dim int, cell long, rep long"), "emb-guests")
    parts = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / block).cast("int")
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("h")).join(guests.groupBy(*cell).agg(F.count("*").alias("g")), cell, "left")
    sizes = materialise(sizes.select(*cell, parts(F.col("h")).alias("hp"), parts(F.col("g")).alias("gp")), "emb-sizes")
    # tasks of a cell: i and j are blocks of its own vectors, or j = -1 - k is block k of its guests; ids travel, vectors follow
    own, none = F.pmod(F.xxhash64("rep"), "hp").cast("int"), F.array().cast("array<struct<i:int,j:int,side:int>>")
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    among = F.transform(F.filter(F.sequence(F.lit(0), F.col("hp") - 1), lambda o: o != F.col("b")), lambda o: task(F.least(o, "b"), F.greatest(o, "b"), o < F.col("b")))
    host = F.when(F.col("gp") > 0, F.transform(F.sequence(F.lit(-1), -F.greatest("gp", F.lit(1))), lambda j: task(F.col("b"), j, F.lit(0)))).otherwise(F.array(task(F.col("b"), F.col("b"), F.lit(0))))
    guest = F.when(F.col("hp") > 0, F.transform(F.sequence(F.lit(0), F.greatest("hp", F.lit(1)) - 1), lambda i: task(i, -1 - F.col("b"), F.lit(1)))).otherwise(none)
    at_home = placed.select(*cell, "rep").join(sizes, cell).withColumn("b", own).select(*cell, "rep", F.explode(F.concat(among, host)).alias("t"))
    abroad = guests.join(sizes, cell).withColumn("b", F.pmod(F.xxhash64("rep"), "gp").cast("int")).select(*cell, "rep", F.explode(guest).alias("t"))
    dealt = materialise(at_home.unionByName(abroad).select(*cell, "rep", "t.*"), "emb-dealt")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = pdf[pdf["side"] == 0].sort_values("rep"), pdf[pdf["side"] == 1].sort_values("rep")
        out = [pd.DataFrame({"rep": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})]
        # a block meets itself beside the first block of guests
        for both, other in ([(a, None)] if j in (i, -1) and len(a) > 1 else []) + ([(pd.concat([a, b]), b)] if len(a) and len(b) else []):
            counts, root = link_block(_rows(a), None if other is None else _rows(b), both["n"].to_numpy(), cosine)
            linked, ids = counts > 0, both["rep"].to_numpy()
            out.append(pd.DataFrame({"rep": ids[linked], "links": counts[linked], "root": ids[root[linked]]}))
        return pd.concat(out)

    met = dealt.join(placed.select("rep", "n", "x"), "rep").groupBy(*cell, "i", "j")
    found = materialise(met.applyInPandas(compare, "rep long, links long, root long"), "emb-links")
    release(guests, sizes, dealt)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found, "rep", "root", "emb").withColumnRenamed("node", "rep")
    named = unique.join(counts, "rep", "left").join(groups, "rep", "left")
    named = named.select("label", "h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = materialise(named, "emb-nodes")
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "emb-least")
    named = materialise(named.join(least, "component"), "emb-names")
    release(unique, placed, found, least)
    linked = usable.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
