"""Operator 1: quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a cheap or dear test of one text. On a bounded sample (``SAMPLE_ROWS``
rows) the cost of each rule is timed and its rejection rate counted; the cascade is
then one CASE WHEN in order of rejection per cost, so that a document that an early
rule rejects never reaches the later ones. The order changes speed only: the
verdict is the conjunction of all rules. There is no shuffle: one narrow stage, in which a
very long text is one row's work.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, release, words_of

SAMPLE_ROWS = 512
SYMBOLS = "#*$%&|<>"
_POSITION_BITS = 24
_MASK = (1 << _POSITION_BITS) - 1


def _count(text: Column, characters: str) -> Column:
    """Occurrences of the characters, by plain byte searches."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.char_length(text) - F.char_length(left)).cast("long")


def _window(w: Column, p: Column) -> Column:
    return F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Positions whose window's hash occurs twice are candidates (a sort of plain
    longs, hash above position); of those the windows themselves are compared.
    """
    n = F.size(w)
    every = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    packed = F.transform(every, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long")))

    def twice(s: Column) -> Column:
        same = lambda x, y: F.shiftright(x.bitwiseXOR(y), _POSITION_BITS) == 0
        return F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1))), lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int"))

    candidates = F.when(n <= _MASK, let(F.sort_array(packed), twice)).otherwise(every)

    def equal(g: Column) -> Column:
        return F.transform(F.filter(g, lambda x, k: (x["t"] == F.get(g, k + 1)["t"]) | (x["t"] == F.get(g, k - 1)["t"])), lambda x: x["p"])

    exact = let(candidates, lambda c: F.when(F.size(c) == 0, c).otherwise(let(F.sort_array(F.transform(c, lambda p: F.struct(_window(w, p).alias("t"), p.alias("p")))), equal)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.sort_array(exact), start, lambda a, p: F.struct((a["n"] + (p + 3 - F.greatest(p, a["end"]))).cast("long").alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    return covered


def base_features(text: Column) -> Column:
    """Struct of the base counts and ``lines``; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


@dataclass(frozen=True)
class Rule:
    """``rejects(row)``: a boolean column over text and the base counts; never null."""

    name: str
    rejects: Callable[[], Column]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


#: Word lengths, symbols a word, exclamation marks a word, capitals a word character,
#: lines that repeat, and words without a letter: the usual limits for prose.
RULES = (
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("symbols", lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("dup_lines", lambda: 10 * F.col("n_dup_lines") > 3 * (1 + _count(_text(), "\n"))),
    Rule("exclamations", lambda: 10 * _count(_text(), "!") > 3 * F.col("n_words")),
    Rule("capitals", lambda: 2 * _count(_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ") > F.col("word_chars")),
    Rule("letters", lambda: 5 * F.size(F.filter(words_of(F.col("text")), lambda w: ~w.rlike(r"\p{L}"))) > F.col("n_words")),
)
BASE = Rule("base", lambda: F.col("base_failed"))


def with_base(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text, the base counts and base_failed; extra columns are not carried."""
    rows = docs.select("doc_id", "text").withColumn("__b", base_features(F.col("text"))).select("doc_id", "text", "__b.*")
    return rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def estimate(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejection rate, seconds) on a sample of at most ``rows`` rows drawn over the whole table.

    A rule's cost is the better of two runs over the written sample, less what a run without a rule takes.
    """
    share = min(1.0, 2 * rows / max(1, docs.count()))
    sample = materialise(with_base(docs.sample(share, seed=7).limit(rows)).coalesce(1), "quality-sample")
    counts = sample.agg(F.count("*").alias("n"), *[F.sum(r.rejects().cast("int")).alias(r.name) for r in rules]).first()

    def seconds(column: Column) -> float:
        taken = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.sum(column)).first()
            taken.append(time.perf_counter() - began)
        return min(taken)

    nothing = seconds(F.lit(1))
    out = [(r.name, (counts[r.name] or 0) / max(1, counts["n"]), max(1e-4, seconds(r.rejects().cast("int")) - nothing)) for r in rules]
    release(sample)
    return out


def order(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Rule names by rejection per cost, highest first; ties keep the given order."""
    return [x[0] for x in sorted(estimates, key=lambda x: -x[1] / max(x[2], 1e-6))]


def score(docs: DataFrame, rules=RULES, cascade: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_failed, kept.

    ``cascade``: the order of the rules; by default estimated on a sample of
    ``docs``. Null or empty text has no words and fails the base rule. Repeated
    rows are scored alike; an empty table gives no rows.
    """
    by_name = {r.name: r for r in rules}
    cascade = order(estimate(docs, rules)) if cascade is None else cascade
    rows = with_base(docs)
    verdict = F.when(F.col("base_failed"), False)
    for name in cascade:
        verdict = verdict.when(by_name[name].rejects(), False)
    return rows.withColumn("kept", verdict.otherwise(True)).drop("text")


def keep_good(docs: DataFrame, rules=RULES, cascade: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    by_name = {r.name: r for r in rules}
    cascade = order(estimate(docs, rules)) if cascade is None else cascade
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), "doc_id", "text")
    rows = held.withColumn("__b", base_features(F.col("text"))).select("__row", "doc_id", "text", "__b.*")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdict = F.when(F.col("base_failed"), False)
    for name in cascade:
        verdict = verdict.when(by_name[name].rejects(), False)
    return rows.where(verdict.otherwise(True)).select("__row.*")
