"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``ratio`` of the host's pages
contain it and it is on two pages at least (else a host's only page would be
nothing but boilerplate); such lines are dropped from the host's pages.  A page
counts once however often it repeats a line.

Lines travel as (host, md5); counts combine before they are shuffled.  Both
joins are salted, by line and by page, with salts that grow with the number of
shuffle partitions, so neither a host nor a line on a third of all pages is one
task.  Texts are shuffled once, to meet the lines that their page loses; a page
is known by the md5 of its key, host and text.

Null texts and hosts are empty ones.  Blank lines are never boilerplate.  A text
without boilerplate comes back unchanged, byte for byte.  The expression that
cuts pages has no repeated group, so pages of any length and number of tags
take linear time and constant stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.2
#: A line that does not repeat is no boilerplate, whatever its ratio.
REPEATS = 2


def host_of(url: str = "url"):
    """Lower-case host of a URL column; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: What stands between lines of a page, one at a time: a script, a style, a comment, a tag, a line
#: end.  What is never closed runs to the end of the page, so that no character is looked at twice.
BREAK = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*(?:>|\z)|[\r\n]"


def visible_lines(html: str = "html"):
    """Text of an HTML column: a line for each run of text between tags, trimmed."""
    lines = F.transform(F.split(F.coalesce(F.col(html), F.lit("")), BREAK), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _salts(df: DataFrame) -> int:
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def boilerplate(rows: DataFrame, ratio: float, least: int) -> DataFrame:
    """(host, line) that are boilerplate, from ``rows`` (host, lines: distinct keys)."""
    salts = _salts(rows)
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    held = rows.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    dealt = held.withColumn("salt", F.pmod(F.hash("line"), F.lit(salts)))
    return dealt.join(pages, ["host", "salt"]).where(F.col("n") > ratio * F.col("pages")).select("host", "line")


def drop_boilerplate(df: DataFrame, host, key: str = "page_id", text: str = "text", ratio: float = RATIO, least: int = REPEATS) -> DataFrame:
    """``df`` with ``text`` rid of boilerplate, plus ``n_lines`` and ``n_dropped``.

    ``least`` is the number of pages a line must be on to be judged at all.
    """
    blank = lambda x: F.trim(x) != ""
    held = df.withColumn("__host", F.coalesce(host, F.lit("")))
    parts = [F.col(key).cast("string"), F.col("__host"), F.col(text)]
    known = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts], *[p.isNull().cast("string") for p in parts], F.length("__host").cast("string"))
    held = held.withColumn("__id", F.md5(known))
    cut = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = held.select(
        F.col("__host").alias("host"), "__id", F.array_distinct(F.transform(F.filter(cut, blank), lambda x: F.md5(x))).alias("lines")
    )
    salts = _salts(df)
    found = boilerplate(rows, ratio, least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = (
        rows.select("__id", "host", F.explode("lines").alias("line"))
        .withColumn("salt", F.pmod(F.hash("__id"), F.lit(salts)))
        .join(found, ["host", "line", "salt"], "left_semi")
        .groupBy("__id").agg(F.collect_set("line").alias("__drop"))
    )
    gone = lambda x: F.array_contains(F.col("__drop"), F.md5(x))
    kept = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(F.filter(cut, lambda x: ~gone(x)), "\n"))
    return (
        held.join(hits, "__id", "left")
        .withColumn("n_lines", F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(cut)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("__drop").isNull(), 0).otherwise(F.size(F.filter(cut, gone))).cast("long"))
        .withColumn(text, kept)
        .drop("__host", "__id", "__drop")
    )
