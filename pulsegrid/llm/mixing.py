"""Operator 6: mix sources to target weights by a time-varying curriculum.

Every source has a weight schedule w(t), t in [0, 1], whose integral is the number
of words that the mix takes from it. A source's documents, in a fixed hashed order
and repeated up to ``max_repeats`` times, form one stream of words; a copy that
starts ``a`` words into the stream is trained at the t at which the integrated
schedule reaches ``a``. Copies are taken whole: the one that reaches the target is in
if that brings the source's words nearer to it. The copies are range-sorted by position.

Distribution: the order within a source is that of md5(doc_id, text). The running word
count is built from (source, md5 prefix) buckets of two levels, so that neither a source
that holds most rows nor its buckets meet in one task. The table of sources itself, a row
each, is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slope of each weight class's schedule: w(t) is proportional to 1 + slope * (2t - 1).
SLOPES = (-0.5, 0.0, 0.5)
ROWS_PER_BUCKET = 256


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> also rank, weight and target.

    The whole size is shared by weight; a target stops at ``max_repeats`` times its
    source's size and the excess goes to the others by weight, until none is above.
    """
    n = len(weights)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(n))).cast("double"))
    ranked = ranked.withColumn("bound", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("settled", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    # the first settled level in order of ratio is the water level
    order = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return filled.withColumn("target", F.least(F.first("settled", ignorenulls=True).over(order) * F.col("weight"), F.col("bound"))).select(
        "source", "source_size", "rank", "weight", F.coalesce("target", F.lit(0.0)).alias("target")
    )


def position_at(start: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] at which the integrated schedule reaches ``start`` words."""
    u = F.when(target > 0, start / target).otherwise(F.lit(0.0))
    root = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope)
    return F.when(slope == 0, u).otherwise(root)


def _order() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def assign(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, slopes=SLOPES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, h, src, source_size, target, copies, taken.

    ``copies`` is an array of (copy, start, position), one for each copy that the mix takes, each the
    whole document. Null text counts no words, and documents without a word have no copies; a
    null source is a source of its own, last; null and repeated ids are told apart by the text, and
    equal rows are separate documents; empty input gives no rows.
    """
    rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _order().alias("h"), _source().alias("src"))
    rows = materialise(rows, "mix-sizes")
    n = rows.count()
    digits = 2
    while 16**digits * ROWS_PER_BUCKET < n and digits < 12:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    buckets = materialise(rows.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"), F.any_value("source").alias("source")), "mix-buckets")
    groups = buckets.groupBy("src", F.substring("bucket", 1, digits // 2).alias("coarse")).agg(F.sum("bucket_size").alias("group_size"))
    per_source = buckets.groupBy("src").agg(F.any_value("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    per_source = targets(per_source.select("source", "source_size"), weights, max_repeats).withColumn("src", _source()).drop("source")
    upto = lambda size, *keys: F.coalesce(F.sum(size).over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("src", "coarse", upto("group_size", "src", "coarse").alias("before")).join(per_source, "src")
    starts = buckets.withColumn("coarse", F.substring("bucket", 1, digits // 2)).select("src", "coarse", "bucket", upto("bucket_size", "src", "coarse", "bucket").alias("within"))
    starts = starts.join(groups, ["src", "coarse"]).withColumn("base", F.col("before") + F.col("within")).drop("coarse", "before", "within")
    starts = materialise(starts, "mix-starts")
    placed = rows.join(starts, ["src", "bucket"]).withColumn("at", F.col("base") + upto("size", "src", "bucket", "h"))
    slope = F.get(F.array(*map(F.lit, slopes)), F.pmod("rank", F.lit(len(slopes))))
    wanted = F.round(F.col("target")).cast("long")

    def one(copy: int) -> Column:
        start = F.col("at") + copy * F.col("source_size")
        taken = (F.col("size") > 0) & (start < wanted) & (2 * (wanted - start) >= F.col("size"))
        return F.when(taken, F.struct(F.lit(copy).alias("copy"), start.alias("start"), position_at(start.cast("double"), F.col("target"), slope).alias("position")))

    placed = placed.withColumn("copies", F.array_compact(F.array(*[one(k) for k in range(max_repeats)])))
    taken = (F.size("copies") * F.col("size")).alias("taken")
    return placed.select("doc_id", "size", "source", "h", "src", "source_size", "target", "copies", taken)


def in_order(plan: DataFrame) -> DataFrame:
    """The rows of ``assign`` range-sorted by the position of their first copy; rows without one come last."""
    first = F.get("copies", F.lit(0))["position"]
    rows = plan.withColumn("first_position", first).withColumn("__at", F.coalesce(first, F.lit(2.0)))
    return rows.repartitionByRange("__at", "h").sortWithinPartitions("__at", "h").drop("__at")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents in training order: the columns of ``docs``, a row per copy that the mix takes.

    Rows are range-partitioned and sorted by position. Documents without a word are not in the mix.
    Equal rows (by doc_id, text and source) are one row here, with the copies of all of them.
    """
    plan = materialise(assign(docs, **how), "mix-plan")
    copies = plan.select("h", "src", F.explode("copies").alias("c")).select("h", "src", F.col("c.position").alias("position"), F.col("c.start").alias("start"))
    again = materialise(plan.groupBy("h", "src").agg(F.count("*").alias("n")).where("n > 1").select("h", "src"), "mix-again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), _order().alias("h"), _source().alias("src"))
    if not again.isEmpty():
        one = rows.join(again, ["h", "src"], "left_semi").dropDuplicates(["h", "src"])
        rows = rows.join(again, ["h", "src"], "left_anti").unionByName(one)
    rows = rows.join(copies, ["h", "src"])
    return rows.repartitionByRange("position", "start", "h").sortWithinPartitions("position", "start", "h").select("r.*")
