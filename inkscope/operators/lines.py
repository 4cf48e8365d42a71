"""From documents to the lines and characters that can matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from ..tables import char_class


def marker_class(options: Options) -> str:
    """Class of all markers; ASCII and Latin letters fail its first, cheap test."""
    return r"[[^\x{0}-\x{9F}\x{C0}-\x{1C2}]&&" + char_class(m.code for m in options.markers()) + "]"


#: Numbers that are summed together.
BLOCK = 256


def sums_before(numbers: Column) -> Column:
    """ARRAY<INT>: for each of an array of numbers, the sum of those before it.

    Sums run within blocks and over blocks, so that no long array is copied for
    each of its elements.
    """
    count = F.greatest(F.floor((F.size(numbers) - 1) / BLOCK), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK)))

    def running(part: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("next"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["next"] + x).alias("next"), F.concat(acc["out"], F.array(acc["next"])).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    starts = lambda bs: running(F.transform(bs, total), F.lit(0))
    return T.let(blocks, lambda bs: T.let(starts(bs), lambda at: F.flatten(F.transform(bs, lambda part, b: running(part, F.get(at, b))))))


def line_offsets(lines: Column) -> Column:
    """ARRAY<INT>: where each line of a split text begins."""
    return sums_before(F.transform(lines, lambda x: F.length(x) + 1))


def marked(content: Column, pattern: str) -> Column:
    """ARRAY<STRUCT(ch, i, prev, next)> of the characters of a line that are in class ``pattern``.

    The line is cut into such characters and the runs between them, which are
    never looked at one character at a time.
    """

    def found(parts: Column) -> Column:
        one = lambda x: (F.length(x) == 1) & x.rlike(pattern)
        beside = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        each = lambda at: F.transform(
            parts, lambda x, k: F.when(one(x), F.struct(x.alias("ch"), F.get(at, k).alias("i"), F.right(beside(k - 1), F.lit(1)).alias("prev"), F.left(beside(k + 1), F.lit(1)).alias("next")))
        )
        return F.filter(T.let(sums_before(F.transform(parts, lambda x: F.length(x))), each), lambda x: x.isNotNull())

    return T.let(F.regexp_extract_all(content, F.lit(f"{pattern}|[^{pattern}]+"), F.lit(0)), found)


def with_lines(df: DataFrame, text: str, pattern: str, extra: dict | None = None) -> DataFrame:
    """A row for each line that matches ``pattern``: ``line`` (from 1), ``offset``, ``content``.

    Documents without a match are dropped before they are split.  ``extra`` names
    further texts of equal shape that are split alongside.  Linear in the text and
    in the number of its lines.
    """
    extra = extra or {}
    keep = [c for c in df.columns if c != text and c not in extra]
    cut = lambda ls: F.filter(
        F.arrays_zip(
            ls.alias("content"), line_offsets(ls).alias("offset"), F.sequence(F.lit(1), F.size(ls)).alias("line"), *[F.split(c, "\n").alias(n) for n, c in extra.items()]
        ),
        lambda x: x["content"].rlike(pattern),
    )
    out = df.where(F.col(text).rlike(pattern)).select(*keep, F.explode(T.let(F.split(text, "\n"), cut)).alias("__l"))
    return out.select(*keep, *[F.col(f"__l.{n}").alias(n) for n in ("line", "offset", "content", *extra)])


def marker_positions(df: DataFrame, options: Options, text: str = "text") -> DataFrame:
    """(..., line, column, offset, ch) of every marker character."""
    pattern = marker_class(options)
    lines = with_lines(df, text, pattern)
    found = marked(F.col("content"), pattern)
    return lines.withColumn("__c", F.explode(found)).select(
        *[c for c in lines.columns if c not in ("content", "offset")],
        (F.col("__c.i") + 1).alias("column"),
        (F.col("offset") + F.col("__c.i")).alias("offset"),
        F.col("__c.ch").alias("ch"),
    )


def marker_dimension(spark, options: Options) -> DataFrame:
    """The markers in force as a table; its size is fixed (525 rows at most)."""
    rows = [(m.char, m.code, m.label, m.name, m.kind, m.replacement, m.can_clean, m.letter) for m in options.markers()]
    return spark.createDataFrame(
        rows, "ch string, code int, codepoint string, name string, kind string, replacement string, can_clean boolean, letter boolean"
    )


def lookup(df: DataFrame, options: Options, text: str = "text") -> DataFrame:
    """Marker occurrences with their names and kinds: one broadcast join."""
    return marker_positions(df, options, text).join(F.broadcast(marker_dimension(df.sparkSession, options)), "ch")
