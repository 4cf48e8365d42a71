"""Stable identities of reported items, and the baseline of accepted ones.

An identity is the first 16 hex digits of the SHA-256 of path, key and the
0-based occurrence of that key in its path.  Numbering is one window per (path,
key); nothing else in a report needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import Options
from ..tables import char_class
from .lines import marker_class


def identity(path: Column, key: Column, occurrence: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    parts = F.concat(F.to_binary(path, F.lit("utf-8")), zero, F.to_binary(key, F.lit("utf-8")), zero, F.to_binary(occurrence.cast("string"), F.lit("utf-8")))
    return F.substring(F.sha2(parts, 256), 1, 16)


def items(findings: DataFrame, payloads: DataFrame, words: DataFrame, path: str = "path") -> DataFrame:
    """(path, key, rank, ord, line, column) of everything that has an identity.

    Findings in document order (those inside a payload have none), payloads by
    scheme, then place, mixed words in document order.
    """
    p = F.col(path).alias("path")
    scheme = F.when(F.col("scheme") == "tag-ascii", 0).when(F.col("scheme") == "variation-selector", 1).otherwise(2)
    cast = lambda c: c.cast("long").alias("ord")
    return (
        findings.where("not in_payload").select(p, F.col("codepoint").alias("key"), F.lit(0).alias("rank"), cast(F.col("offset")), "line", "column")
        .unionByName(payloads.select(p, F.lit("payload").alias("key"), (scheme + 1).alias("rank"), cast(F.col("start")), "line", "column"))
        .unionByName(words.select(p, F.concat(F.lit("mixed:"), "word").alias("key"), F.lit(4).alias("rank"), cast(F.col("start")), "line", "column"))
    )


def with_identity(found: DataFrame) -> DataFrame:
    """``items`` with ``occurrence`` and ``id``."""
    order = Window.partitionBy("path", "key").orderBy("rank", "ord")
    numbered = found.withColumn("occurrence", F.row_number().over(order) - 1)
    return numbered.withColumn("id", identity(F.col("path"), F.col("key"), F.col("occurrence")))


def escape_markers(text: Column, options: Options = Options()) -> Column:
    """Markers as U+XXXX, so that a baseline itself holds none."""
    pattern = marker_class(Options(typographic=True, ivs=True))
    from ..functions.text import chars, codepoint_label

    spelled = F.array_join(F.transform(chars(text), lambda c: F.when(c.rlike(pattern), codepoint_label(c)).otherwise(c)), "")
    return F.when(text.rlike(pattern), spelled).otherwise(text)


def baseline_entries(identified: DataFrame) -> DataFrame:
    """(id, path, codepoint) to accept, sorted by path and id."""
    word = F.expr("substring(key, 7)")
    shown = F.when(F.startswith("key", F.lit("mixed:")), F.concat(F.lit("mixed-script "), escape_markers(word))).otherwise(F.col("key"))
    return identified.select("id", escape_markers(F.col("path")).alias("path"), shown.alias("codepoint")).orderBy("path", "id")


def new_items(identified: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items whose identity the baseline does not accept."""
    return identified.join(baseline.select("id"), "id", "left_anti")


def accepted_items(identified: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items whose identity the baseline accepts."""
    return identified.join(baseline.select("id"), "id", "left_semi")


def stale_entries(identified: DataFrame, baseline: DataFrame) -> DataFrame:
    """Accepted entries that nothing matches any more, sorted by path and id."""
    return baseline.join(identified.select("id"), "id", "left_anti").orderBy("path", "id")


def report_items(reports: DataFrame) -> DataFrame:
    """``items`` of nested reports, with the array (``part``) and the place in it (``at``) each stands at."""

    def of(part: str, key: Column, rank: Column, order: str, where: str = "true"):
        return (
            reports.select("path", F.posexplode(part).alias("at", "x")).where(where)
            .select("path", key.alias("key"), rank.alias("rank"), F.col(f"x.{order}").cast("long").alias("ord"), F.lit(part).alias("part"), "at")
        )

    return (
        of("findings", F.col("x.codepoint"), F.lit(0), "offset", "not x.in_payload")
        .unionByName(of("payloads", F.lit("payload"), F.col("x.rank") + 1, "start"))
        .unionByName(of("mixed_script", F.concat(F.lit("mixed:"), F.col("x.word")), F.lit(4), "start"))
    )


def without_accepted(reports: DataFrame, baseline: DataFrame) -> DataFrame:
    """``reports`` without the items that the baseline accepts; ``baselined`` counts them."""
    accepted = accepted_items(with_identity(report_items(reports)), baseline.dropDuplicates(["id"]))
    held = accepted.groupBy("path").agg(F.collect_set(F.struct("part", "at")).alias("__gone"))
    out = reports.join(held, "path", "left")

    def left(part: str) -> Column:
        gone = lambda i: F.array_contains("__gone", F.struct(F.lit(part).alias("part"), i.alias("at")))
        return F.when(F.col("__gone").isNull(), F.col(part)).otherwise(F.filter(part, lambda x, i: ~gone(i)))

    out = out.withColumns({part: left(part) for part in ("findings", "payloads", "mixed_script")})
    return out.withColumn("baselined", F.coalesce(F.size("__gone"), F.lit(0))).drop("__gone")
