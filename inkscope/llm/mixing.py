"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget: a share of the total by weight, never above
``most`` times what it holds, the excess shared again among the others.  Complete
epochs of a source come first; the rest is a weighted sample without
replacement: each document draws the exponential key ``-ln(u) / w`` with its
quality weight ``w``, documents are taken by rising key, and the running sum of
their words is cut at the budget (the document at the cut gives its part).

Running sums are not taken over a whole source: keys are dealt to ordered
buckets, bucket sums give offsets, and only rows of one bucket are sorted
together.  Bounds are quantiles of the keys, known from the shares of the three
weights, so buckets are even whatever the weights.  ``u`` is a hash of the id (of
the text where there is none), so reruns agree.

Null texts count no words; a null source is a source, ordered last; repeated rows
count as often as they occur (same key: they follow each other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Weights by the quality label: good, unlabelled, poor.
QUALITY = (2.0, 1.0, 0.5)
BUCKET_ROWS = 4_096


def _quality(labels: DataFrame, key: str) -> DataFrame:
    """(id, quality) of the labelled keys: the best label of each."""
    return labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max("quality").alias("quality"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.expr(f"cast((n - 1) % {len(weights)} + 1 as int)"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        sizes.withColumn("n", F.row_number().over(ordered))
        .withColumn("w", pick)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap") / F.col("w"))
        .withColumn("below", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("above_w", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("rate", (F.col("budget") - F.col("below")) / F.col("above_w"))
        .withColumn("open_rate", F.min(F.when(F.col("fill") > F.col("rate"), F.struct("fill", "rate"))).over(everything)["rate"])
    )
    return filled.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("open_rate"), F.col("cap").cast("double"))).alias("target")
    )


def mix(
    df: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: int = MOST, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(key, size, source_size, target, taken) of every row, and its columns ``keep``.

    ``labels`` (key, quality) gives the quality weights; without it all are 1.
    Texts are measured before anything is shuffled.
    """
    told = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.col(text)), F.lit(""))
    u = (F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = df.select(
        F.col(key).alias("id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).alias("source"),
        u.alias("u"),
        *keep,
    )
    w = F.lit(1.0)
    if labels is not None:
        good, none, poor = QUALITY
        w = F.when(F.col("quality") >= 1, good).when(F.col("quality") < 1, poor).otherwise(none)
        rows = rows.join(_quality(labels, key), "id", "left")
    rows = cut(rows.select("id", "size", "source", (-F.log("u") / w).alias("draw"), w.alias("w"), *keep))
    shares = {r.w: r["count"] for r in rows.groupBy("w").count().collect()}  # three weights at most
    count = sum(shares.values())
    buckets = max(1, -(-count // BUCKET_ROWS))
    below = sum((F.lit(n / count) * (1 - F.exp(-F.col("draw") * v)) for v, n in sorted(shares.items())), F.lit(0.0))
    rows = rows.withColumn("part", F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("int")).drop("w")
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    of_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(of_source), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = before.join(goals, same(before, goals)).select(before["source"], "part", "before", "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    plan = plan.withColumn("epochs", whole.cast("long")).withColumn("rest", rest)
    running = Window.partitionBy("source", "part").orderBy("draw", "id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(running), F.lit(0)))
    joined = placed.join(plan, same(placed, plan) & (placed["part"] == plan["part"]))
    left = F.col("rest") - F.col("before") - F.col("ahead")
    return joined.select(
        F.col("id").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))).cast("long").alias("taken"),
        *keep,
    )
