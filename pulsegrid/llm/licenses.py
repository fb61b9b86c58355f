"""Operator 5: license scans by an exact set-similarity join with license templates.

Words are ordered by their frequency over the whole corpus, rarest first. A text
block (a line, a paragraph of several lines, for short statements adjacent lines) meets a template when it holds at
least ``CONTAINMENT`` of the template's distinct words. Any such block shares one of
the template's first ``n - need + 1`` words in that order (prefix filter), has at
least ``need`` words (length filter), and the first shared word stands early enough
for ``need`` more (positional filter); what passes is verified exactly. So nearly all
texts are settled by one look-up of their words among a few prefix words.

The frequencies are one small aggregate: only words of templates are counted, a
number fixed by the templates. Labels by fixed phrases stay beside the method's.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates: label and text of common public license statements, lines and notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
CONTAINMENT = 0.8
STATEMENT = 12

# A-Z to a-z, digits and everything beyond ASCII stay, the rest is a space
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LINES = bytes(10 if c == 10 else _TABLE[c] for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_TABLE).split()


class Index:
    """Templates with their words rarest first, and the prefix index over them."""

    def __init__(self, frequency: dict[bytes, int], templates=TEMPLATES, containment: float = CONTAINMENT):
        self.templates = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            ordered = sorted(set(words(text)), key=lambda w: (frequency.get(w, 0), w))
            need = -int(-containment * len(ordered) // 1)
            number = len(self.templates)
            self.templates.append((label, ordered, frozenset(ordered), need))
            for position, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((number, position))
        self.keys = frozenset(self.prefix)
        #: words of the longest short statement
        self.longest = max((len(words(text)) for _, text in templates if len(set(words(text))) <= STATEMENT), default=0)

    def reached(self, block: set[bytes], least: int = 0, most: int = 1 << 30) -> list[tuple[str, float, frozenset]]:
        """(label, containment, words found) of every template of more than ``least`` and up to ``most``
        words that the block meets."""
        out = []
        first: dict[int, int] = {}
        for w in block & self.keys:
            for number, position in self.prefix[w]:
                if position < first.get(number, 1 << 30):
                    first[number] = position
        for number, position in first.items():
            label, ordered, whole, need = self.templates[number]
            if len(block) < need or len(ordered) - position < need or not least < len(ordered) <= most:
                continue
            found = whole & block
            if len(found) >= need:
                out.append((label, len(found) / len(ordered), found))
        return out

    def matches(self, block: set[bytes], is_paragraph: bool = False) -> dict[str, float]:
        """label -> containment, for the templates that the block meets best."""
        out: dict[str, float] = {}
        for label, share, _ in self.reached(block, STATEMENT if is_paragraph else 0):
            out[label] = max(out.get(label, 0.0), share)
        best = max(out.values(), default=0.0)
        return {label: share for label, share in out.items() if share == best}

    def labels(self, text: str) -> dict[str, float]:
        """label -> containment, for all templates that a span of the text meets. Variants of a license share
        most words: one is left out if a better one of another label, in the same lines or around them,
        holds all its words that were found."""
        met = [(first, last, *x) for first, last, block, least, most in spans(text, self.longest) for x in self.reached(block, least, most)]
        out: dict[str, float] = {}
        for first, last, label, share, found in met:
            if not any(better > share and other != label and start <= first and last <= end and found <= held for start, end, other, better, held in met):
                out[label] = max(out.get(label, 0.0), share)
        return out


def vocabulary(templates=TEMPLATES) -> frozenset:
    return frozenset(w for _, text in templates for w in words(text))


def frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """In how many documents each word of the templates stands, over all documents."""
    wanted = vocabulary(templates)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total.update(wanted.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    rows = docs.select("text").mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r["w"]): r["n"] for r in rows.collect()}  # at most one row per word of the templates


def _phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices at which the phrase's words stand in `` w w w ``."""
    out, at, seen, words_before = [], joined.find(phrase), 0, 0
    while at >= 0:
        words_before += joined.count(b" ", seen, at)
        seen = at
        out.append(words_before)
        at = joined.find(phrase, at + 1)
    return out


def blocks(text: str):
    """(set of words, whether a paragraph): every line, and every run of non-blank lines."""
    lines = [set(x.split()) for x in text.encode("utf-8", "surrogatepass").translate(_LINES).split(b"\n")]
    paragraph: list[set] = []
    for line in [*lines, set()]:
        if line:
            yield line, False
            paragraph.append(line)
        else:
            if len(paragraph) > 1:
                yield set().union(*paragraph), True
            paragraph = []


def spans(text: str, longest: int):
    """(first line, last line, words, least, most): what is compared with the templates of more than
    ``least`` and up to ``most`` distinct words.

    Lines meet all templates and paragraphs the notices. A statement that is wrapped fills the lines
    between its first and its last, so spans of adjacent lines for it hold ``longest`` words there at most.
    """
    lines = [x.split() for x in text.encode("utf-8", "surrogatepass").translate(_LINES).split(b"\n")]
    start, whole = 0, set()
    for i, line in enumerate([*lines, []]):
        if not line:
            if i - start > 1:
                yield start, i - 1, whole, STATEMENT, 1 << 30
            start, whole = i + 1, set()
            continue
        whole = whole.union(line)
        block, inside, j = set(line), 0, i + 1
        yield i, i, block, 0, 1 << 30
        while j < len(lines) and lines[j] and inside <= longest:
            block = block.union(lines[j])
            yield i, j, block, 0, STATEMENT
            inside += len(lines[j])
            j += 1


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(text: str | None, index: Index, phrases=PHRASES) -> tuple:
    """The result columns of one text, without its id."""
    text = text or ""
    ws = words(text)
    places, labels, base = [], set(), set()
    joined = b" " + b" ".join(ws) + b" "
    for phrase, label in phrases.items():
        found = _phrase_places(joined, b" " + phrase.encode() + b" ")
        if found:
            base.add(label)
            places += found
    score = 1.0 if base else 0.0
    if not index.keys.isdisjoint(ws):
        found = index.labels(text)
        labels |= found.keys()
        score = max(score, *found.values(), 0.0)
    labels |= base
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest containment of a
    template that a block meets, else 0. Null text counts as empty; empty texts have
    no words and labels; null ids pass through; repeated rows are scanned alike;
    extra columns are not read; an empty table gives no rows.
    """
    index = Index(frequencies(docs, templates), templates, containment)

    def run(batches):
        for batch in batches:
            rows = [scan_text(t, index, phrases) for t in batch.column("text").to_pylist()]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, OUT)
