"""Operator 4: MinHash near-duplicates by order MinHash and banded alignment.

A text's 5-word shingles are labelled with their occurrence number, so that each
occurs once. Each of ``SKETCHES`` hash functions picks the two least of them and
keeps them in text order: two texts share such a sketch with a chance that falls
with their edit distance, order included. Texts that share a sketch are candidates;
they are linked if a banded alignment matches at least 0.8 of the longer one's words.

Exact copies are one text from the start. Texts of up to ``SHORT`` words have few shingles; they also get
keys by an exact prefix filter on their words. The first ``ROUNDS`` sketches are tried alone: each text
meets one end of its bucket, which settles most of a large group with a pair or two a text. Then in each bucket that
spans components every text is compared with the bucket's least and greatest member, if in another component.
Then every pair of a bucket's members that are not in one component by now and were
not tried is a candidate too, unless their words, told apart by 16 bits of their hashes, prove it
below the threshold. Links are not transitive, so no member leaves a bucket before that.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release
from .components import connected_components

SHINGLE = 5
SKETCHES = 16
SIMILARITY = 0.8
#: Texts of up to so many words also get keys that no similar pair can miss.
SHORT = 24
#: Ids of candidate texts are broadcast up to this many (12 bytes each), else joined.
BROADCAST_IDS = 400_000
#: Sketches that are tried alone before all buckets; they only save pairs.
ROUNDS = 2
_CHUNK = 2 << 20
#: Links are joined by the driver up to this many (12 bytes an end), else on the cluster.
DRIVER_LINKS = 100_000
#: Members of a bucket that meet in one group, and hash bins of the word counts that are compared first.
BLOCK = 256
BINS = 64

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (any bijection with good avalanche serves)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            up, down = np.full(n, _R), np.full(n, _R_INVERSE)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and each text's number of words."""
    blob = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[blob]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(first, np.concatenate(([0], ends))))
    if not len(first):
        return np.zeros(0, dtype=np.uint64), counts
    _powers.grow(len(blob))
    values = (blob.astype(np.uint64) + np.uint64(1)) * _powers.up[: len(blob)]
    values[space] = 0
    return _mix(np.add.reduceat(values, first) * _powers.down[first]), counts


def _occurrences(h: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """The rank of each hash among the equal ones of its text."""
    own = _mix(h + text_of.astype(np.uint64) * _R)
    order = np.argsort(own, kind="stable")
    run = np.concatenate(([True], own[order][1:] != own[order][:-1]))
    run_start = np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = (np.arange(len(order)) - run_start).astype(np.uint64)
    return label


def bags(texts: list[bytes]) -> list[np.ndarray]:
    """Per text 16 bits for each word, told apart from its equals by its occurrence."""
    words, counts = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, dtype="<u2") for _ in texts]
    label = _occurrences(words, np.repeat(np.arange(len(texts)), counts))
    bins = (_mix(words + label * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype("<u2")
    return np.split(bins, np.cumsum(counts)[:-1])


def sketch(texts: list[bytes], sketches: int = SKETCHES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(texts x sketches array of keys, number of words); rows of texts without a word mean nothing."""
    words, counts = word_hashes(texts)
    keys = np.zeros((len(texts), sketches), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return keys, counts
    n = np.maximum(counts[some] - shingle + 1, 1)
    text_of = np.repeat(np.arange(len(some)), n)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    within = np.arange(len(text_of)) - starts[text_of]
    word_start = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
    at, end = word_start[text_of] + within, (word_start + counts[some])[text_of]
    padded = np.concatenate((words, np.zeros(shingle, dtype=np.uint64)))
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(shingle):
        h = (h + np.where(at + j < end, padded[at + j], np.uint64(j + 1))) * _R
    h = _mix(h)
    h = _mix(h + _occurrences(h, text_of) * np.uint64(0xC2B2AE3D27D4EB4F))
    top, place = np.uint64(2**64 - 1), np.arange(len(h))
    for j in range(sketches):
        v = _mix(h ^ _mix(np.uint64([j + 1]))[0])
        low = np.minimum.reduceat(v, starts)
        is_low = v == low[text_of]
        at_low = np.minimum.reduceat(np.where(is_low, place, len(h)), starts)
        v[is_low] = top
        second = np.minimum.reduceat(v, starts)
        at_second = np.minimum.reduceat(np.where((v == second[text_of]) & (v < top), place, len(h)), starts)
        early, late = np.where(at_low < at_second, low, second), np.where(at_low < at_second, second, low)
        keys[some, j] = _mix(early * _R + _mix(late) + np.uint64(j))
    return keys, counts


def aligned_words(a: list, b: list, need: int) -> int:
    """The most words that an order-keeping alignment matches, or less than ``need`` if below it.

    Such an alignment skips at most len(a) - need words of a and len(b) - need of b, so it stays
    in a band around the diagonal; matches outside the band are masked. One row of the dynamic
    program is one step on a machine integer of len(b) bits.
    """
    n, m = len(a), len(b)
    lead = 0
    while lead < min(n, m) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(n, m) - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[lead : n - tail], b[lead : m - tail]
    done = lead + tail
    skip_a, skip_b = n - need, m - need
    if skip_a < 0 or skip_b < 0:
        return 0
    if not a or not b:
        return done
    where: dict = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, band = full, (1 << (skip_a + skip_b + 1)) - 1
    for i, w in enumerate(a):
        match = where.get(w, 0)
        if match:
            low = i - skip_a
            match &= band << low if low >= 0 else band >> -low
            u = v & match
            v = ((v + u) | (v - u)) & full
    return done + len(b) - v.bit_count()


def similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether an alignment matches ``least`` of the longer text's words."""
    x, y = a.split(), b.split()
    longest = max(len(x), len(y))
    need = -int(-least * longest // 1)
    if min(len(x), len(y)) < need or not longest:
        return False
    common = Counter(x) & Counter(y)
    return common.total() >= need and aligned_words(x, y, need) >= need


def short_keys(words: np.ndarray, least: float = SIMILARITY) -> list[int]:
    """Keys of a short text: pairs of its prefix words in the order of their hashes.

    Similar texts of n and m words share at least ``least`` of the longer one's words, so two of the shared
    ones are among the first n - need + 2 of both; words are labelled with their occurrence.
    """
    seen: Counter = Counter()
    labelled = []
    for w in words.tolist():
        labelled.append(hash((w, seen[w])))
        seen[w] += 1
    labelled.sort()
    need = -int(-least * len(labelled) // 1)
    return [hash(pair) for pair in combinations(labelled[: len(labelled) - need + 2], 2)] if need > 1 else []


def text_id() -> Column:
    """96 bits of hashes of the text: equal for equal texts, null for null."""
    of = F.concat(F.lpad(F.hex(F.xxhash64("text")), 16, "0"), F.lpad(F.hex(F.hash("text")), 8, "0"))
    return F.when(F.col("text").isNotNull(), F.unhex(F.right(of, F.lit(24))))


def _sketched(docs: DataFrame, sketches: int, shingle: int, least: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
                    size += len(texts[end])
                    end += 1
                keys, counts = sketch(texts[at:end], sketches, shingle)
                lists = list(keys.view(np.int64))
                for k in np.flatnonzero((counts > 0) & (counts <= SHORT)):
                    lists[k] = np.concatenate((lists[k], np.array(short_keys(word_hashes([texts[at + k]])[0], least), dtype=np.int64)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in batch.columns[:3]), pa.array(counts.astype(np.int64)), column], names=["doc_id", "row", "tid", "n_words", "keys"])
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_id().alias("tid"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row long, tid binary, n_words long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs(a, b) that align; a's text travels to b."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            ok = pa.array([similar((p or "").encode("utf-8", "surrogatepass"), (q or "").encode("utf-8", "surrogatepass"), least) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    left = texts.select(F.col("tid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("tid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _bagged(texts: DataFrame) -> DataFrame:
    """tid, bag: two bytes for each word of the text."""

    def run(batches):
        for batch in batches:
            out = [bags([(text or "").encode("utf-8", "surrogatepass")])[0].tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, pa.binary())], names=["tid", "bag"])

    return texts.select("tid", "text").mapInArrow(run, "tid binary, bag binary")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """tid, text of the texts that ids(tid) names."""
    ids = materialise(ids.distinct(), "nd-ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select(text_id().alias("tid"), "text").join(chosen, "tid", "left_semi").dropDuplicates(["tid"])


def _untried(opened: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of all members of a bucket in different components that can be similar.

    opened(key, tid, n_words, n, component). A bucket is dealt to blocks of about ``BLOCK``
    members and each pair of blocks is one group, so no task holds a bucket whole. Two texts match
    at most as many words as their bags share, so pairs below the need are no loss. Of the buckets
    that two texts share only that of the least key compares them, so each pair is found once.
    """
    shared = materialise(opened.groupBy("tid").agg(F.collect_set("key").alias("keys")), "nd-shared")
    bagged = materialise(_bagged(_texts(docs, shared.select("tid"))).join(shared, "tid"), "nd-bags")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = opened.withColumn("block", F.pmod(F.xxhash64("tid"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tid", "n_words", "component")
    cells = materialise(dealt.join(bagged, "tid"), "nd-cells")
    release(shared, bagged)

    def meet(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("n_words", "ascending"), ("tid", "ascending")]).combine_chunks()
        tid, words, block = cell.column("tid").to_pylist(), cell.column("n_words").to_numpy(), cell.column("block").to_numpy()
        component = np.unique(np.array(cell.column("component").to_pylist(), dtype=object), return_inverse=True)[1].ravel()
        bag = [np.frombuffer(b, dtype="<u2") for b in cell.column("bag").to_pylist()]
        counts = np.stack([np.bincount(b % BINS, minlength=BINS) for b in bag]).astype(np.int32)
        keys = [set(k) for k in cell.column("keys").to_pylist()]
        key, i, j = (cell.column(c)[0].as_py() for c in ("key", "i", "j"))
        found, mine, need = [], np.zeros(1 << 16, dtype=bool), np.ceil(least * words - 1e-9)
        # in order of length each text meets the longer ones that its words can cover
        for x in range(len(tid)):
            longest = int(np.searchsorted(words, int(words[x] / least + 1e-9), side="right"))
            y = np.arange(x + 1, longest)
            y = y[(component[y] != component[x]) & (block[y] != block[x] if i != j else True)]
            if len(y):
                y = y[np.minimum(counts[x], counts[y]).sum(axis=1) >= need[y]]
                mine[bag[x]] = True
                near = [k for k in y.tolist() if min(keys[x] & keys[k]) == key and np.count_nonzero(mine[bag[k]]) >= need[k]]
                mine[bag[x]] = False
                found += [(min(tid[x], tid[k]), max(tid[x], tid[k])) for k in near]
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return cells.groupBy("key", "i", "j").applyInArrow(meet, "a binary, b binary")


def near_duplicates(docs: DataFrame, sketches: int = SKETCHES, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id, kept: one row per row of ``docs``.

    ``component_id`` is the least doc_id among the copies and near copies that links
    reach; ``kept`` marks one row of each group, also where rows or ids repeat: of the least doc_id one
    row. Texts without a word (empty, white space) are copies of equal texts only; null texts are groups
    of their own, as are rows without a doc_id, whose component_id is null. Ids may be of any type. A
    very long text is aligned in one task, in memory linear in it. An empty table gives no rows.
    """
    return _grouped(docs, sketches, shingle, least).select("doc_id", "component_id", "kept")


def _grouped(docs: DataFrame, sketches: int = SKETCHES, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """doc_id, tid, component_id, kept: texts are told apart by their id, not by a document's."""
    rows = materialise(_sketched(docs, sketches, shingle, least), "nd-sketches")
    usable = rows.where("doc_id is not null and tid is not null")
    unique = materialise(usable.groupBy("tid").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.any_value("n_words").alias("n_words"), F.any_value("keys").alias("keys")), "nd-unique")
    words, groups, tried = unique.where("n_words > 0"), None, None
    end = F.struct("n_words", "tid", "component")
    spans = [F.count("*").alias("n"), F.min(end).alias("lo"), F.max(end).alias("hi"), F.min("component").alias("l"), F.max("component").alias("h")]

    def placed(texts: DataFrame) -> DataFrame:
        """``texts`` with the component that each is in by now."""
        if groups is None:
            return texts.withColumn("component", F.col("tid"))
        return texts.join(groups.withColumnRenamed("node", "tid"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))

    def untried(members: DataFrame, *ends: str) -> DataFrame:
        """Pairs (a, b) of members and ends of their buckets that no link connects so far."""
        found = []
        for e in map(F.col, ends):
            fits = F.least(e["n_words"], F.col("n_words")) >= least * F.greatest(e["n_words"], F.col("n_words"))
            found.append(members.where((F.col("component") != e["component"]) & fits).select(F.least(e["tid"], F.col("tid")).alias("a"), F.greatest(e["tid"], F.col("tid")).alias("b")))
        pairs = reduce(DataFrame.unionByName, found).distinct()
        return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")

    def link(pairs: DataFrame) -> None:
        nonlocal groups, tried
        pairs = materialise(pairs, "nd-pairs")
        if pairs.isEmpty():
            return release(pairs)
        texts = materialise(_texts(docs, pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid")))), "nd-texts")
        links = materialise(_verified(pairs, texts, least), "nd-links")
        if not links.isEmpty():
            known = links if groups is None else groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
            groups = connected_components(known, "a", "b", "nd", DRIVER_LINKS)
        tried = pairs if tried is None else tried.unionByName(pairs)
        release(texts, links)

    # a few sketches alone settle most of a large group, with one pair a text
    for k in range(min(ROUNDS, sketches)):
        members = materialise(placed(words.select("tid", "n_words", F.get("keys", F.lit(k)).alias("key"))), "nd-members")
        leaders = materialise(members.groupBy("key").agg(*spans).where("l < h").select("key", "lo", "hi"), "nd-leaders")
        link(untried(members.join(leaders, "key"), "hi" if k % 2 else "lo"))
        release(members, leaders)
    # of all buckets those that still span components are open
    members = materialise(placed(words.select("tid", "n_words", "keys")).select("tid", "n_words", "component", F.explode("keys").alias("key")), "nd-keys")
    leaders = materialise(members.groupBy("key").agg(*spans).where("l < h").select("key", "n", "lo", "hi"), "nd-leaders")
    bucketed = materialise(members.join(leaders, "key").distinct(), "nd-buckets")
    release(members, leaders)
    link(untried(bucketed, "lo", "hi"))
    # three members are all compared by now
    large = materialise(placed(bucketed.where("n > 3").select("key", "tid", "n_words", "n")), "nd-large")
    wide = materialise(large.groupBy("key").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l < h").select("key"), "nd-spans")
    opened = materialise(large.join(wide, "key"), "nd-open")
    release(bucketed, large, wide)
    if not opened.isEmpty():
        rest = _untried(opened, docs, least)
        link(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"))
    release(opened)
    if groups is None:
        groups = words.select(F.col("tid").alias("node"), F.col("tid").alias("component")).limit(0)
    named = materialise(unique.select("tid", "rep").join(groups.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "rep", F.coalesce("component", "tid").alias("component")), "nd-named")
    least_of = materialise(named.groupBy("component").agg(F.min("rep").alias("first")), "nd-first")
    names = materialise(named.join(least_of, "component").select("tid", "first"), "nd-names")
    release(unique, named, least_of)
    found = usable.select("doc_id", "row", "tid").join(names, "tid").select("doc_id", "tid", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "row") == F.col("first")).alias("kept"))
    alone = rows.where("doc_id is null or tid is null").select("doc_id", "tid", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    found = materialise(_grouped(docs, **how).where("doc_id is not null and tid is not null").groupBy("doc_id", "tid").agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "nd-found")
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("r"), F.col("doc_id").alias("doc_id"), text_id().alias("tid"))
    gone = materialise(found.where("not kept").select("doc_id", "tid"), "nd-gone")
    few = gone.count() <= BROADCAST_IDS
    left = keyed.join(F.broadcast(gone) if few else gone, ["doc_id", "tid"], "left_anti")
    # equal rows of a kept document: one of them stays
    again = materialise(found.where("kept and n > 1").select("doc_id", "tid"), "nd-again")
    release(found)
    if again.isEmpty():
        return left.select("r.*")
    repeated = materialise(left.join(again, ["doc_id", "tid"], "left_semi").withColumn("n", F.monotonically_increasing_id()), "nd-repeated")
    first = materialise(repeated.groupBy("doc_id", "tid").agg(F.min("n").alias("n")), "nd-one")
    one = repeated.join(first, ["doc_id", "tid", "n"], "left_semi").select("r.*")
    return left.join(again, ["doc_id", "tid"], "left_anti").select("r.*").unionByName(one)
