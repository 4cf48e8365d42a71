"""What an editor shows of a report: problems, their fixes, and counts by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import quoted

INVISIBLE = ("hidden", "tag", "ideographic-vs")


def _listed(parts: Column) -> Column:
    """a, b and c."""
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", ")
    return F.when(F.size(parts) < 2, F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))


def problems(findings: DataFrame, payloads: DataFrame, words: DataFrame, path: str = "path") -> DataFrame:
    """One row a problem: place, width, severity, code, message, and the text that fixes it.

    ``new_text`` is null where nothing is offered; ``rewritable`` marks findings
    that only a lookalike rewrite can change.
    """
    p = F.col(path).alias("path")
    name = F.concat("name", F.lit(" ("), "codepoint", F.lit("). "))
    act = F.col("actionable")
    message = (
        F.when(~act, F.concat(name, F.lit("Reported, not changed.")))
        .when(F.col("replacement") == "", F.concat(name, F.lit("Cleaning removes this character.")))
        .otherwise(F.concat(name, F.lit("Cleaning replaces it with "), quoted(F.col("replacement")), F.lit(".")))
    )
    found = findings.where("not in_payload").select(
        p, "line", "column", F.lit(1).alias("width"), F.when(act, "warning").otherwise("information").alias("severity"), F.col("codepoint").alias("code"),
        message.alias("message"), F.col("kind").isin(*INVISIBLE).alias("invisible"), (~act).alias("rewritable"), F.when(act, F.col("replacement")).alias("new_text"),
    )
    what = F.when(F.col("printable"), F.concat(F.lit("Hidden message: "), quoted(F.col("decoded")), F.lit("."))).otherwise("Hidden data, not printable text.")
    noun = F.concat(F.col("runes").cast("string"), F.when(F.col("runes") == 1, " invisible character").otherwise(" invisible characters"))
    pay = payloads.select(
        p, "line", "column", F.col("runes").alias("width"), F.lit("warning").alias("severity"), F.col("scheme").alias("code"),
        F.concat(what, F.lit(" Encoded in "), noun, F.lit(" as "), "scheme", F.lit(".")).alias("message"), F.lit(True).alias("invisible"), F.lit(False).alias("rewritable"), F.lit("").alias("new_text"),
    )
    mixed = words.select(
        p, "line", "column", F.length("word").alias("width"), F.lit("warning").alias("severity"), F.lit("mixed-script").alias("code"),
        F.concat(quoted(F.col("word")), F.lit(" mixes "), _listed(F.col("scripts")), F.lit(".")).alias("message"), F.lit(False).alias("invisible"), F.lit(False).alias("rewritable"), F.lit(None).cast("string").alias("new_text"),
    )
    return pay.unionByName(found).unionByName(mixed)


def with_rewrites(shown: DataFrame, rewritten: DataFrame, path: str = "path") -> DataFrame:
    """``shown`` with ``rewrite``: what a run that rewrites lookalikes would put there."""
    offers = rewritten.where("actionable and replacement <> ''").select(F.col(path).alias("path"), "line", "column", F.col("replacement").alias("offer"))
    joined = shown.join(offers, ["path", "line", "column"], "left")
    return joined.withColumn("rewrite", F.when(F.col("rewritable"), F.col("offer"))).drop("offer")


def edits(shown: DataFrame, scope: str = "all") -> DataFrame:
    """(path, line, column, width, new_text) to apply: ``off``, only ``hidden`` ones, or ``all``."""
    wanted = {"off": F.lit(False), "hidden": F.col("invisible"), "all": F.lit(True)}[scope]
    return shown.where(F.col("new_text").isNotNull() & wanted).select("path", "line", "column", "width", "new_text")


def touching(shown: DataFrame, first: int, last: int) -> DataFrame:
    """Problems on the lines of a cursor range."""
    return shown.where(F.col("line").between(first, last))


def by_file(shown: DataFrame) -> DataFrame:
    """(path, problems, removable) for each file with problems."""
    return shown.groupBy("path").agg(F.count(F.lit(1)).alias("problems"), F.count_if(F.col("new_text").isNotNull()).alias("removable"))


def not_open(reports: DataFrame, open_files: DataFrame) -> DataFrame:
    """Reports of files that no editor holds open."""
    return reports.join(open_files.select("path"), "path", "left_anti")
