import collections
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from oracle import connect, rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from pulsegrid.llm import components, embeddings, html, licenses, lines, mixing, neardup, packing, quality, tokens, warc
from pulsegrid.llm import queries as registered

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")
RNG = random.Random(5)
VOCABULARY = ["w%d" % i for i in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, every, rng=RNG):
    words = text.split(" ")
    for i in range(3, len(words), every):
        words[i] = rng.choice(VOCABULARY)
    return " ".join(words)


ODD = [(None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "x" * 50_000), (5, prose(3000)), (6, "same text here"), (6, "same text here"), (7, "same text here")]


# -- SQL parity -------------------------------------------------------------
@has_data
@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_rows(spark, name):
    assert rows_of_spark(registered.queries()[name](spark, DATA)) == rows_of_sql(connect(DATA), registered.oracle_sql()[name])


# -- quality ----------------------------------------------------------------
def repeated_words(words):
    grams = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_quality_counts(spark, docs):
    rows = [*ODD, *[(100 + i, " ".join(RNG.choice("abc") for _ in range(RNG.randrange(1, 80)))) for i in range(30)]]
    got = quality.score(docs(rows), cascade=[r.name for r in quality.RULES]).collect()
    assert len(got) == len(rows)
    expected = collections.Counter((k, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), repeated_words(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in got) == expected
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_quality_order_changes_nothing(spark, docs):
    df = docs([(i, prose(60)) for i in range(5)] + [(9, prose(60).upper().replace(" ", "!! ")), (10, prose(60).replace(" ", "%% "))])
    names = [r.name for r in quality.RULES]
    a = {r["doc_id"]: r["kept"] for r in quality.score(df, cascade=names).collect()}
    assert a == {r["doc_id"]: r["kept"] for r in quality.score(df, cascade=names[::-1]).collect()} == {r["doc_id"]: r["kept"] for r in quality.score(df).collect()}
    assert a == {0: True, 1: True, 2: True, 3: True, 4: True, 9: False, 10: False}
    assert quality.keep_good(df, cascade=names).columns == df.columns
    assert quality.order([("a", 0.5, 1.0), ("b", 0.4, 0.1), ("c", 0.0, 0.1)]) == ["b", "a", "c"]


# -- components -------------------------------------------------------------
def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 120)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 120), 100), 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_few_links_on_the_driver(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(edges, "a long, b long").select(*[F.encode(F.lpad(c, 4, "0"), "UTF-8").alias(c) for c in "ab"])
    found = [sorted(map(tuple, components.connected_components(links, "a", "b", "t", few).collect())) for few in (0, 1, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 200
    assert components.connected_components(links.limit(0), "a", "b", "t", 1000).count() == 0


# -- embeddings -------------------------------------------------------------
def brute_links(rows, cosine):
    import numpy as np

    good = {k: (label, np.array(x) / max(abs(v) for v in x)) for k, label, x in rows if k is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)}
    return {(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.sqrt((good[a][1] @ good[a][1]) * (good[b][1] @ good[b][1])) >= cosine}


def check_embeddings(spark, rows, cosine, **how):
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("vec_id", "label", "embedding", F.lit(1).alias("n")), cosine, **how).collect()}
    links = brute_links([(k, label, x) for k, x, label in rows], cosine)
    degree = collections.Counter(x for pair in links for x in pair)
    parent = {k: k for k in got}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert len(got) == len(rows)
    for k, r in got.items():
        assert (r["n_links"], r["component_id"]) == (degree[k], find(k)), k
    return links


def test_embeddings_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        if i % 3 and rows:
            base = rng.choice(rows)[1]
            x = [v + rng.gauss(0, 0.06) for v in base] if i % 2 else list(base)
        else:
            x = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, x, i % 2 if i < 200 else 5))
    assert check_embeddings(spark, rows, 0.98)
    assert check_embeddings(spark, rows, 0.98, block=20)


def test_guests_cover_all_pairs_and_few_cells():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    x[500:] = x[:500].repeat(2, axis=0) + rng.normal(scale=0.1, size=(1000, 64))
    net = embeddings._unit(x[:60])
    home, gap = embeddings.homes(x, net)
    radii = np.array([max(gap[home == c], default=-1.0) for c in range(60)])
    parts = list(embeddings.visits(x, home, net, radii, 0.2))
    found = {(int(r), int(c)) for rows, cells in parts for r, c in zip(rows, cells, strict=True)}
    unit = embeddings._unit(x)
    near = [(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True) if home[a] > home[b]]
    assert near and all((a, home[b]) in found for a, b in near)
    assert len(found) < 20 * len(x)  # all lesser cells would be 30 a vector


def test_embeddings_send_ids_not_vectors(spark, monkeypatch):
    written = {}

    def record(df, name, real=embeddings.materialise):
        out = real(df, name)
        written[name] = (df.columns, out.count())
        return out

    monkeypatch.setattr(embeddings, "materialise", record)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist(), 1) for i in range(600)]
    check_embeddings(spark, rows, 0.98, block=40)
    columns, n = written["emb-dealt"]
    assert "x" not in columns and n < 20 * len(rows)  # 30 cells: cell against cell took all of them, 30 a vector


def test_embeddings_edge_cases(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 0.0], None), (6, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [float("inf"), 0.0], 1), (10, [], 1)]
    check_embeddings(spark, rows, 0.98)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    check_embeddings(spark, [(1, [1e-200, 0.0], 1), (2, [1e200, 1e198], 1), (3, [0.0, 3e-310], 1)], 0.98)
    # an id for two vectors: both keep their links
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0001], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


# -- packing ----------------------------------------------------------------
@pytest.mark.parametrize("name", ["", "a  b", "  ", "x \n\n y z", "don't  stop", "　　é", "1234 %%% \t x ", "<|endoftext|> a", "a b  c", "\x1c\x1d a"])
def test_ids_are_the_tokenizer_files(name):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = tokens.encoder(tokens.vocabulary())
    for text in (name, name + prose(30), prose(30) + name):
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pack(spark, docs):
    rows = [*ODD, *[(100 + i, prose(RNG.randrange(1, 400))) for i in range(80)]]
    got = packing.pack(docs(rows)).collect()
    encode = tokens.encoder(tokens.vocabulary())
    for k, text in rows:
        ids = [*encode(text or "").tolist(), 2]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == k})
        at = 0
        for no, (piece, start, length, crc) in enumerate(own):
            assert (piece, start) == (no, at) and (no == 0 or length == 1024 or len(own) == 1)
            part = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            assert crc == zlib.crc32(part)
            at += length
        assert at == len(ids)
    assert len([r for r in got if r["doc_id"] == 6]) == 2
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) * 1.05 + 1
    assert packing.pack(docs([])).count() == 0


def test_solve_holds_the_histogram():
    rng = random.Random(2)
    for n in (1, 40, 5000):
        histogram = collections.Counter(min(1024, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(n))
        held = collections.Counter()
        for pattern, times in (found := packing.solve(dict(histogram))):
            assert sum(length * m for length, m in pattern.items()) <= 1024
            for length, m in pattern.items():
                held[length] += m * times
        assert held == histogram
        if n == 5000:
            assert sum(t for _, t in found) <= 1.01 * sum(length * m for length, m in histogram.items()) / 1024 + 1


def test_packing_solves_the_fractional_program():
    import numpy as np

    rng = random.Random(2)
    histogram = collections.Counter(min(1023, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(57_000))
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[int(x)] for x in lengths])
    weights, bound = packing.fractional(lengths, demand.astype(float), 1024)
    cover = np.zeros(len(lengths))
    for pattern, weight in weights.items():
        assert lengths[list(pattern)].sum() <= 1024
        np.add.at(cover, list(pattern), weight)
    assert (cover >= demand * (1 - 1e-9)).all()
    # the bound may not be above what the lengths themselves need
    assert bound <= sum(weights.values()) <= 1.15 * bound and bound >= 0.999 * (lengths * demand).sum() / 1024
    left = demand.copy()
    sequences = sum(times for _, times in packing.rounded(weights, bound, left))
    assert left.sum() <= 0.3 * demand.sum() and sequences <= bound + 1
    assert sum(times for _, times in packing.solve(histogram)) <= 1.005 * bound


# -- order MinHash ----------------------------------------------------------
def classes(df):
    return {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}


def test_near_duplicates_match_brute_force(spark, docs):
    base = [prose(120) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, edited(base[0], 25)) for i in range(12)] + [(30, base[1]), (31, base[1]), (32, edited(base[2], 3)), (33, base[3] + " " + prose(10)), (34, base[4][: len(base[4]) // 2])]
    rows += [(50 + i, prose(80) + " " + base[5][:120]) for i in range(8)]
    got = classes(docs(rows))
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    text = dict(rows)
    for a in text:
        for b in text:
            if a < b and neardup.similar(text[a].encode(), text[b].encode()):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got == {k: find(k) for k in text}


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_of_drifting_chains(spark, docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(11)
    common, rows = prose(50, rng), []
    for chain in range(12):
        tail = prose(75, rng).split()
        for step in range(5):
            rows.append((rng.randrange(10**9), common + " " + " ".join(tail)))
            tail[15 * step : 15 * step + 15] = prose(15, rng).split()
    text = dict(rows)
    assert len(text) == len(rows)
    ids = sorted(text)
    keys = dict(zip(ids, (set(map(int, k)) for k in neardup.sketch([text[k].encode() for k in ids], sketches=1)[0]), strict=True))
    parent = {k: k for k in ids}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and keys[a] & keys[b] and neardup.similar(text[a].encode(), text[b].encode()):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert not neardup.similar(rows[0][1].encode(), rows[4][1].encode())
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows), sketches=1).collect()}
    assert got == {k: find(k) for k in ids}


def test_near_duplicates_try_few_pairs_of_a_large_group(spark, docs, monkeypatch):
    tried = []

    def record(pairs, texts, least, real=neardup._verified):
        tried.append(pairs.count())
        return real(pairs, texts, least)

    monkeypatch.setattr(neardup, "_verified", record)
    rng = random.Random(8)
    base = prose(200, rng)
    rows = [(i, edited(" ".join(base.split()[i % 5 :]), 40 + i % 30, rng)) for i in range(250)]
    assert set(classes(docs(rows)).values()) == {0}
    assert sum(tried) < 5 * len(rows)


def test_near_duplicates_disprove_pairs_by_their_words(spark, docs, monkeypatch):
    tried = []

    def record(opened, documents, least, real=neardup._untried):
        found = real(opened, documents, least)
        tried.append((opened.count(), found.count()))
        assert found.distinct().count() == found.count()
        return real(opened, documents, least)

    monkeypatch.setattr(neardup, "_untried", record)
    rng = random.Random(5)
    common = prose(300, rng)
    rows = [(i, common + " " + " ".join(f"t{rng.randrange(10**9)}" for _ in range(100))) for i in range(120)]
    rows += [(200 + i, edited(rows[i][1], 40, rng)) for i in range(3)]
    assert classes(docs(rows)) == {k: k % 200 for k, _ in rows}
    # all meet in the buckets of what they have in common, but only the three copies share 0.8 of their words
    [(members, pairs)] = tried
    assert members > 1000 and pairs < 10


def test_bags_bound_the_alignment():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
        b = [w for w in a if rng.random() < 0.9] + ["x"] * rng.randrange(4) or ["y"]
        x, y = neardup.bags([" ".join(a).encode(), " ".join(b).encode()])
        assert (len(x), len(y)) == (len(a), len(b))
        assert np.isin(y, x).sum() >= (collections.Counter(a) & collections.Counter(b)).total() >= neardup.aligned_words(a, b, 0)
    assert [len(x) for x in neardup.bags([b"", b" a a ", b""])] == [0, 2, 0]


def test_near_duplicates_edge_cases(spark, docs):
    got = neardup.near_duplicates(docs(ODD)).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by[None] == {(None, True)} and by[1] == {(1, True)} and by[2] == {(2, True)} and by[3] == {(3, True)}
    assert by[6] == {(6, True), (6, False)} and by[7] == {(6, False)}
    kept = neardup.keep_one(docs(ODD))
    assert kept.columns == docs([]).columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert neardup.near_duplicates(docs([])).count() == 0
    assert classes(docs([(1, ""), (2, ""), (3, None), (4, None), (5, " ")])) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_near_duplicates_of_short_texts_and_repeated_ids(spark, docs):
    rows = [(1, "hello there my friend today"), (2, "hello there my friend today ok"), (3, "quite another text of seven words here"), (4, "a b"), (5, "a b c")]
    assert classes(docs(rows)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    # one id for two texts: the texts stay apart, and a copy of either finds its group
    a, b = prose(90), prose(90)
    got = {(r["doc_id"], r["text"]) for r in neardup.keep_one(docs([(1, a), (1, b), (2, edited(b, 40)), (1, a), (3, prose(50))])).collect()}
    assert {(k, t) for k, t in got if k == 1} == {(1, a), (1, b)} and {k for k, _ in got} == {1, 3} and len(got) == 3
    kept = neardup.near_duplicates(docs([(1, a), (1, a), (2, a)])).where("kept").collect()
    assert [r["doc_id"] for r in kept] == [1]
    named = neardup.near_duplicates(docs(rows).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert {r["doc_id"]: r["component_id"] for r in named} == {"d1": "d1", "d2": "d1", "d3": "d3", "d4": "d4", "d5": "d5"}


def test_recall_against_brute_force(spark, docs):
    rng = random.Random(21)
    rows = [(i, prose(rng.randrange(5, 160), rng)) for i in range(60)]
    for i in range(140):
        base = rng.choice(rows)[1]
        rows.append((100 + i, edited(base, rng.choice([9, 20, 45, 150, 150]), rng)))
    got, text = classes(docs(rows)), dict(rows)
    pairs = [(a, b) for a in text for b in text if a < b and neardup.similar(text[a].encode(), text[b].encode())]
    # of pairs that align, also those whose every shingle or two holds an edit
    assert len(pairs) > 200 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    close = [(a, b) for a, b in pairs if len(shingles(text[a]) & shingles(text[b])) >= 0.8 * len(shingles(text[a]) | shingles(text[b]))]
    assert len(close) > 20 and all(got[a] == got[b] for a, b in close)


def test_alignment():
    rng = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        b = a[:]
        for _ in range(rng.randrange(0, 12)):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randrange(len(b) + 1), rng.choice("abcd"))
        need = rng.randrange(0, max(len(a), len(b)) + 1)
        found, exact = neardup.aligned_words(a, b, need), lcs(a, b)
        assert found <= exact and (found >= need) == (exact >= need) and (exact < need or found == exact)


# -- licenses ---------------------------------------------------------------
def test_licenses_match_brute_force(spark, docs):
    rows = [*ODD, (20, "Code.\nReleased under the MIT License.\nmore"), (21, "under the MIT license under the mit-license"), (22, "Apache License, Version 2.0 and CC BY-NC"), (23, prose(40) + "\nThis work is licensed under the GNU General Public License, version 3.\n")]
    rows += [(24, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software without restriction"), (25, "This work is licensed under the General Public Licence, version 3."), (26, "ÀÉ license")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(rows)).collect()}
    assert (got[20]["labels"], got[20]["n_base"], got[20]["first_word"]) == ("mit", 1, 2)
    assert (got[21]["n_base"], got[21]["first_word"], got[21]["last_word"]) == (2, 0, 4)
    assert got[22]["base_labels"] == "apache-2,cc-by-nc" and got[23]["labels"] == "gpl-3" and got[23]["n_base"] == 0 and got[23]["first_word"] is None
    assert got[24]["labels"] == "mit" and got[2]["n_words"] == 0 and got[26]["n_words"] == 2
    index = licenses.Index(licenses.frequencies(docs(rows)))
    for _, text in rows:
        for block, paragraph in licenses.blocks(text or ""):
            plain = {}
            for label, _, whole, need in index.templates:
                shared = len(whole & block)
                if shared >= need and not (paragraph and len(whole) <= licenses.STATEMENT):
                    plain[label] = max(plain.get(label, 0), shared / len(whole))
            best = max(plain.values(), default=0)
            assert index.matches(block, paragraph) == {k: v for k, v in plain.items() if v == best}
    assert licenses.scan(docs([])).count() == 0


def test_licenses_beside_a_better_one_and_wrapped(spark, docs):
    notice = "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    rows = [(1, "Licensed under the Apache License, Version 2.0. " + notice), (2, "This work is licensed under the GNU General Public\nLicense, version 3."), (3, "This work is\nlicensed under\nthe GNU General\nPublic License,\nversion 2."), (4, "Licensed under CC BY-NC 4.0."), (5, "This work is licensed under the GNU General Public\n\nLicense, version 3.")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs(rows)).collect()}
    assert got == {1: "apache-2,mit", 2: "gpl-3", 3: "gpl-2", 4: "cc-by-nc", 5: ""}


# -- mixing -----------------------------------------------------------------
def test_mixing(spark, docs):
    rows = [(i, prose(RNG.randrange(0, 60))) for i in range(120)] + [(500, None), (None, "a b c"), (501, "q"), (501, "q"), (None, "d e"), (502, prose(4000))]
    sources = [["a", "b", "c", None][min(3, i // 31)] for i in range(120)] + ["a", "b", "tiny", "tiny", "b", "c"]
    df = docs(rows, sources)
    plan = mixing.assign(df).collect()
    assert len(plan) == len(rows)
    total, size, target, longest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in plan:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["copies"])
        total[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
    for s in target:  # whole copies: off by half of a document at most
        assert abs(total[s] - target[s]) <= longest[s] / 2 + 1 and target[s] <= 3 * size[s] + 1e-6
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    again = {(r["doc_id"], r["source"], r["taken"]) for r in mixing.assign(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["source"], r["taken"]) for r in plan}
    positions = [r["first_position"] for r in mixing.in_order(mixing.assign(df)).collect() if r["first_position"] is not None]
    assert positions == sorted(positions)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = mixed.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == sum((collections.Counter({(r["doc_id"], text): len(r["copies"])}) for r, text in zip(sorted(plan, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"])), [t for _, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").split())))], strict=True)), collections.Counter())
    assert {(r["size"], r["tid"]) for r in got} == {(7, "x")}  # the columns of docs, not the operator's own
    assert mixing.assign(docs([])).count() == 0 and mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 0


def test_positions_invert_the_schedule(spark):
    grid = spark.range(0, 101).select((F.col("id") / 100.0).alias("u"))
    for slope in mixing.SLOPES:
        for r in grid.select("u", mixing.position_at(F.col("u") * 50, F.lit(50.0), F.lit(slope)).alias("t")).collect():
            assert abs(slope * r["t"] ** 2 + (1 - slope) * r["t"] - r["u"]) < 1e-9


# -- lines ------------------------------------------------------------------
def brute_lines(rows, t=0.8):
    """(index of the row, line) of each line that goes; ``rows`` in the order of documents."""
    seen, gone = [], set()
    for k, (_, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(re.findall(r"[^\x20\x09-\x0d]+", line.lower()))
            if words:
                if any(len(words & w) >= t * len(words | w) - 1e-9 for w in seen):
                    gone.add((k, i))
                seen.append(words)
    return gone


def cleaned(rows):
    gone = brute_lines(rows)
    return [None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if (k, i) not in gone) for k, (_, text) in enumerate(rows)]


def test_lines_match_brute_force(spark, docs):
    pool = [prose(n) for n in (1, 2, 4, 5, 9, 14, 20, 40)]
    rows = [(None, pool[-1]), (-1, prose(30) + "  x\t\ty \r")]
    for i in range(60):
        part = [edited(RNG.choice(pool), RNG.choice([6, 11, 30])) if RNG.random() < 0.6 else prose(RNG.randrange(1, 20)) for _ in range(4)]
        rows.append((i, "\n".join(part)))
    rows += [(70, None), (71, ""), (72, "\n \n"), (73, "É é\tx y z w\né É x  y z w"), (74, prose(5000)), (75, "   ")]
    df = docs(rows)
    got = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert {k: got[k]["text"] for k, _ in rows} == dict(zip([k for k, _ in rows], cleaned(rows), strict=True))
    assert all(got[k]["n_chars"] == (None if got[k]["text"] is None else len(got[k]["text"])) for k in got)
    assert lines.dedup_lines(df).columns == df.columns
    assert lines.dedup_lines(docs([])).count() == 0
    assert collections.Counter(r["n_removed"] for r in lines.summary(df).collect()).total() == len(rows)


def test_lines_of_repeated_rows_and_ids(spark, docs):
    # two rows of one id are two documents
    rows = [(1, "shared text goes right here"), (2, "shared text goes right here\nkeep this one okay"), (2, "innocent unique line text\nkeep this two okay")]
    assert sorted(r["text"] for r in lines.dedup_lines(docs(rows)).collect()) == ["innocent unique line text\nkeep this two okay", "keep this one okay", "shared text goes right here"]
    # rows without an id share a line, and an equal row loses all its lines
    rows = [(None, "same line of several words\nfirst"), (None, "same line of several words\nsecond"), (5, "twice the same\n \nrow"), (5, "twice the same\n \nrow")]
    got = lines.dedup_lines(docs(rows)).collect()
    assert sum("same line" in r["text"] for r in got) == 1 and sorted(r["text"] for r in got if r["doc_id"] == 5) == [" ", "twice the same\n \nrow"]
    # ids that are no numbers
    got = lines.dedup_lines(docs(rows).withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))).collect()
    assert len(got) == 4 and {r["doc_id"] for r in got} == {None, "id-5"}


def test_lines_of_a_large_group_meet_few_of_it(spark, docs, monkeypatch):
    written = collections.Counter()

    def record(df, name, real=lines.materialise):
        out = real(df, name)
        written[name] += out.count()
        return out

    monkeypatch.setattr(lines, "materialise", record)
    monkeypatch.setattr(lines, "LEADERS", 1)
    rng = random.Random(7)
    base = [f"c{i}" for i in range(40)]
    # every line has two to four words of its own, the rarest of all, so the leaders explain only a part of the group
    rows = [(i, " ".join(w if k not in gone else f"u{i}x{k}" for k, w in enumerate(base))) for i in range(300) for gone in [rng.sample(range(40), 2 + i % 3)]]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(rows)).collect()}
    assert got == dict(zip([k for k, _ in rows], cleaned(rows), strict=True))
    assert written["line-pairs"] < 10 * len(rows)


def recorded(monkeypatch):
    """Rows written so far, by name, and how often each name was written."""
    rows, times = collections.Counter(), collections.Counter()

    def record(df, name, real=lines.materialise):
        out = real(df, name)
        rows[name] += out.count()
        times[name] += 1
        return out

    monkeypatch.setattr(lines, "materialise", record)
    return rows, times


def test_lines_of_hot_words_meet_a_bounded_table(spark, docs, monkeypatch):
    rows, _ = recorded(monkeypatch)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 64)
    monkeypatch.setattr(lines, "LEADERS", 1)
    rng = random.Random(11)
    base = [f"c{i}" for i in range(40)]
    texts = [(i, " ".join(w if k not in gone else f"u{i}x{k}" for k, w in enumerate(base))) for i in range(200) for gone in [rng.sample(range(40), 2 + i % 3)]]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(texts)).collect()}
    assert got == dict(zip([k for k, _ in texts], cleaned(texts), strict=True))
    assert 0 < rows["line-slots"] <= 64


def test_few_pairs_of_lines_are_verified_in_few_passes(spark, docs, monkeypatch):
    _, times = recorded(monkeypatch)
    rng = random.Random(12)
    pool = [[f"w{rng.randrange(900)}" for _ in range(20)] for _ in range(400)]
    texts = [(i, " ".join(w if rng.random() > 0.06 else f"e{i}" for w in pool[i % 400])) for i in range(600)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(texts)).collect()}
    assert got == dict(zip([k for k, _ in texts], cleaned(texts), strict=True))
    assert times["line-words"] <= 3  # a pass over the documents each


def test_lines_do_not_depend_on_the_rarity_table(spark, docs, monkeypatch):
    counted = []
    real = lines.rarity_levels
    monkeypatch.setattr(lines, "RARITY_ROWS", 5)
    monkeypatch.setattr(lines, "rarity_levels", lambda d: counted.append(real(d)) or counted[-1])
    rng = random.Random(13)
    pool = [[f"w{rng.randrange(300)}" for _ in range(15)] for _ in range(20)]
    texts = [(i, " ".join(w if rng.random() > 0.05 else f"e{i}" for w in rng.choice(pool))) for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(texts)).collect()}
    assert got == dict(zip([k for k, _ in texts], cleaned(texts), strict=True))
    assert (counted[0] > 0).sum() < 200  # of about 500 words


def test_lines_of_small_groups_are_moved_once(spark, docs, monkeypatch):
    rows, times = recorded(monkeypatch)
    monkeypatch.setattr(lines, "SAMPLE_ROWS", 1)
    rng = random.Random(14)
    pool = [[f"w{rng.randrange(2000)}" for _ in range(20)] for _ in range(120)]
    texts = [(i, " ".join([*pool[i % 120][:-1], f"e{i}"])) for i in range(240)]
    # stored from the last to the first: the earlier line of a pair is not the one that is read first
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(texts[::-1])).collect()}
    assert got == dict(zip([k for k, _ in texts], cleaned(texts), strict=True))
    assert times["line-classes"] + times["line-reps"] == 1 and rows["line-reps"] == 240
    assert rows["line-members"] < 120  # pairs of near copies need no leaders
    # a large group still has them
    base = [f"c{i}" for i in range(40)]
    texts = [(i, " ".join(w if k not in gone else f"u{i}x{k}" for k, w in enumerate(base))) for i in range(200) for gone in [rng.sample(range(40), 2 + i % 3)]]
    rows.clear()
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(texts[::-1])).collect()}
    assert got == dict(zip([k for k, _ in texts], cleaned(texts), strict=True))
    assert rows["line-members"] > 200 and rows["line-pairs"] < 10 * len(texts)


def test_rarity_table_stays_small_on_the_driver(spark, docs):
    df = docs([(i, " ".join(f"v{i}x{j}" for j in range(10_000))) for i in range(30)])
    tracemalloc.start()
    levels = lines.rarity_levels(df)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(1 for level in levels if level) > 150_000 and held < 16 << 20
    plan = lines._sets(df, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1_200_000  # one table of 2**18 small numbers, and the rest


# -- WARC -------------------------------------------------------------------
def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b/", "same"), (3, None, "same"), (9, "http://c/ x", "same"), (4, "u", None), (5, "u", ""), (6, "u", "y" * 200_000), (None, "n", "none"), (7, "u", "dup"), (7, "u", "dup")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("seq", F.lit(3)).withColumn("last", F.lit("x"))
    rows = warc.round_trip(df, payload=True).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["request"] is not None and r["metadata"] is not None
        text = next(p[2] for p in pages if p[0] == r["page_id"]) or ""
        s = r["response"]
        assert s["payload_bytes"] == len(text.encode()) and s["payload_digest"] == warc.digest32(text.encode())
        assert s["warc_type"] == "revisit" or bytes(s["payload"]) == text.encode()
    kinds = collections.defaultdict(set)
    for r in rows:
        kinds[r["page_id"]].add((r["response"]["warc_type"], r["response"]["refers_to"]))
    assert kinds[2] == {("revisit", "9")} and kinds[3] == {("revisit", "9")} and kinds[9] == {("response", None)}
    assert kinds[4] == {("revisit", "5")} and kinds[7] == {("response", None)}
    assert {r["response"]["warc_type"] for r in warc.round_trip(df, least_bytes=10).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


# -- token counts -----------------------------------------------------------
def test_edit_aware_counts(spark):
    encode = tokens.encoder(tokens.vocabulary())
    rng = random.Random(4)
    for text in [prose(200), "", "a", "  x  \n\n y", "don't\n\n" * 30, "日本語" * 60, prose(20) + "   " + prose(20)]:
        tree = tokens.SegmentTree(encode, text, 24)
        assert tree.total == len(encode(text))
        for _ in range(25):
            tree.edit(rng.randrange(0, len(tree.text) + 1), rng.choice([0, 1, 2, 9, 60]), rng.choice(["", " ", "  ", "a", "'s", " foo", "\n", "12", ".", "ll"]))
            assert tree.total == len(encode(tree.text))
            assert int(tree.chars[1]) == len(tree.text)
    big = tokens.SegmentTree(encode, prose(20_000))
    before = big.encoded_chars
    big.edit(50_000, 3, "xyz")
    assert big.encoded_chars - before < 2000
    rows = [(1, "hello world", [(0, 5, "bye"), (None, None, None), None]), (2, None, None), (None, "x", [(99, 99, "y")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<offset:long,removed:long,inserted:string>>")
    got = {r["doc_id"]: r for r in tokens.count_tokens(df).collect()}
    assert got[1]["n_tokens_edited"] == len(encode("bye world")) and got[2]["n_tokens"] == 0 and got[None]["n_chars_edited"] == 2
    assert tokens.count_tokens(df.limit(0)).count() == 0 and tokens.count_tokens(df.drop("edits")).count() == 3


# -- HTML -------------------------------------------------------------------
LONG = "This is a long sentence of the article, with enough words in it to count as text. "


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<body><nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p>{LONG}<b>bo</b>ld<br>end.</p><p>Short.</p></article><footer>&copy; me</footer>", f"Title & more {LONG}bold end. Short."),
        (f"<div class='site-header'>Logo</div><div id=content><p>{LONG}</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div><div class=sidebar>{LONG}</div>", f"{LONG.strip()} {LONG.strip()}"),
        (f"<main><div class='cookie-notice'>{LONG}</div><p>{LONG}</p><form>{LONG}<input></form><div class='ad'>{LONG}</div><script>var a='</p>'</script><style>p</style><p>Last.</p></main>", f"{LONG.strip()} Last."),
        ("", ""),
        (None, ""),
        ("<nav>menu only</nav>", ""),
        ("plain text without a tag at all", "plain text without a tag at all"),
        (f"<div class='layout has-sidebar'><p>{LONG}</p><div class=sidebar>x</div></div>", LONG.strip()),
        (f"<body class=page><div class='content-header'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=footer>{LONG}</div></body>", " ".join([LONG.strip()] * 3)),
        (f"<![foo[bar]]><p>{LONG}</p>", LONG.strip()),
        (f"<article><p>{LONG}</p></article><article><p>Second {LONG}</p></article><article class=comment><p>{LONG}</p></article>", f"{LONG.strip()} Second {LONG.strip()}"),
        (f"<h1>Title</h1><p>{LONG}</p><div><p>{LONG}</p><p>{LONG}</p></div><nav>{LONG}</nav>", "Title " + " ".join([LONG.strip()] * 3)),
    ],
)
def test_main_text(page, expected):
    assert html.main_text(page) == expected


def test_badly_nested_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert html.main_text("<span>" * 100_000 + f"<p>{LONG}<p>{LONG}") == f"{LONG.strip()} {LONG.strip()}"
    assert len(html.main_text(f"<div><p>{LONG}</b></i>" * 8000).split()) == 8000 * len(LONG.split())
    assert time.perf_counter() - began < 20


def brute_article(page):
    """Text of the only article element of a page of the driver's kind, by plain searches."""
    import html as references

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [re.sub(r"\s+", " ", references.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|h2|br|ul|ol|li|div|blockquote|pre|table|tr|td)\b[^>]*>", inner)]
    return " ".join(b for b in blocks if b)


@has_data
def test_articles_of_the_tables_pages(spark):
    got = registered.queries()["op10_html_text"](spark, DATA)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    plain = [(r["text"], brute_article(pages[r["page_id"]])) for r in got.collect() if "<article>" in (pages[r["page_id"]] or "") and not re.search(r"<(?:aside|form|nav|footer|header|script|style)\b", pages[r["page_id"]].split("<article>")[1].split("</article>")[0])]
    assert len(plain) > 10 and all(a == b for a, b in plain)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[1]["n_chars"] == len(LONG.strip()) and got[None]["text"] == ""
    assert html.extract(df.limit(0)).count() == 0


# -- pipeline ---------------------------------------------------------------
@has_data
def test_pipeline_against_plain_steps(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, None
    for name, stage in p.STAGES:
        before = docs
        docs = p.materialise(stage(spark, docs, DATA), name)
        if name == "quality_rules":
            good = {r["doc_id"] for r in quality.score(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == good
        if name == "line_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            rows.sort()
            expected = dict(zip([k for k, _ in rows], cleaned(rows), strict=True))
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected
        if name == "near_dedup":
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert len(kept) == docs.count() and set(kept) <= {r["doc_id"] for r in before.collect()}
        if name == "mix_sources":
            sizes = sum(len(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in kept.values())
            longest = max(len(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in kept.values())
            assert abs(sum(len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) for r in docs.collect()) - sizes) <= 7 * longest
            assert {r["text"] for r in docs.collect()} <= set(kept.values())
        if name != "pack_sequences":
            assert docs.columns == columns
    encode = tokens.encoder(tokens.vocabulary())
    assert docs.agg(F.sum("length")).first()[0] == sum(len(encode(r["text"])) + 1 for r in before.collect())
