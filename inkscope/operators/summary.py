"""Reports per document and sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from .detect import reported_payloads, reported_words, verdicts


def file_reports(df: DataFrame, options: Options = Options(), text: str = "text", path: str = "path") -> DataFrame:
    """One nested report a document: findings, payloads, mixed words, counters.

    ``df`` has one row a path.  Clean documents have a report too; only what was
    found is shuffled.
    """
    held = df.select(F.col(path).alias("path"), F.col(text).alias("text"))
    seen = verdicts(held, options)
    place = F.struct("offset", "line", "column", "codepoint", "name", "kind", "action", "replacement", "applied", "in_payload", "actionable")
    found = seen.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "finding", place))).alias("findings"),
        F.count_if(F.col("verdict") == "suppressed").alias("n_chars"),
        F.count_if(F.col("verdict").isin("letter", "context", "typography")).alias("legitimate"),
    )
    pay = reported_payloads(held, options)
    rank = F.when(F.col("scheme") == "tag-ascii", 0).when(F.col("scheme") == "variation-selector", 1).otherwise(2)
    one = F.struct(rank.alias("rank"), "start", "end", "scheme", "runes", F.col("decoded").alias("text"), "printable", "line", "column")
    pay = pay.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(~F.col("suppressed"), one))).alias("payloads"), F.count_if("suppressed").alias("n_pay")
    )
    words = reported_words(held, options).groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(~F.col("suppressed"), F.struct("start", "line", "column", "word", "scripts")))).alias("mixed_script"),
        F.count_if("suppressed").alias("n_words"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = held.select("path", T.format_of(F.col("path")).alias("format")).join(found, "path", "left").join(pay, "path", "left").join(words, "path", "left")
    return whole.select(
        "path", "format",
        F.coalesce("findings", F.array()).alias("findings"),
        F.coalesce("payloads", F.array()).alias("payloads"),
        F.coalesce("mixed_script", F.array()).alias("mixed_script"),
        (zero("n_chars") + zero("n_pay") + zero("n_words")).alias("suppressed"),
        zero("legitimate").alias("legitimate"),
    )


def totals(marked: Column) -> list[Column]:
    """The sums over reports, given how marked files are counted."""
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    chosen = lambda c: F.coalesce(F.sum(F.size(F.filter("findings", lambda f: f[c]))), F.lit(0))
    return [
        F.count(F.lit(1)).alias("files_scanned"),
        marked,
        n("findings").alias("markers_detected"),
        chosen("actionable").alias("markers_actionable"),
        chosen("applied").alias("markers_applied"),
        n("payloads").alias("payloads_decoded"),
        n("mixed_script").alias("mixed_script_words"),
        F.coalesce(F.sum("suppressed"), F.lit(0)).alias("suppressed"),
    ]


def summary(reports: DataFrame) -> DataFrame:
    """One row of sums over ``file_reports``; a file counts as marked if it has findings."""
    return reports.agg(*totals(F.count_if(F.size("findings") > 0).alias("files_with_markers")))


def exit_code(total: DataFrame, errors: int = 0, fail: bool = True) -> DataFrame:
    """2 after an error, 1 if ``fail`` and something calls for action, else 0."""
    act = F.col("markers_actionable") + F.col("payloads_decoded") + F.col("mixed_script_words")
    return total.select(F.when(F.lit(errors > 0), 2).when(F.lit(fail) & (act > 0), 1).otherwise(0).alias("exit_code"))


def actionable(reports: DataFrame) -> DataFrame:
    """(path, actionable): a payload, a mixed word, or a finding that can be rewritten."""
    yes = (F.size("payloads") > 0) | (F.size("mixed_script") > 0) | F.exists("findings", lambda f: f["actionable"])
    return reports.select("path", yes.alias("actionable"))


def by_dimension(found: DataFrame, *columns: str) -> DataFrame:
    """Findings rolled up over ``columns`` (an extension)."""
    return found.rollup(*columns).agg(F.count(F.lit(1)).alias("n"))
