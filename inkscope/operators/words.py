"""Words that mix scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import with_lines

#: A mixed word needs a character of a script other than Latin.
FOREIGN = r"[[^\x{0}-\x{2DF}]&&[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]]"


def line_words(content: Column) -> Column:
    """ARRAY<STRUCT(start, stop, word, scripts, minority)> of a line's mixed words.

    ``minority`` holds the places (in the line) of the rarest script's letters; ties
    go to the first name.  Japanese, Korean and Taiwanese mixtures with Latin
    are no mixed words.
    """

    def word(arr, s):
        part = T.cut(arr, s["start"], s["stop"])
        return T.let(
            F.transform(part, T.script_of),
            lambda sc: T.let(
                F.array_sort(F.array_distinct(F.filter(sc, lambda x: x != ""))),
                lambda names: F.struct(
                    s["start"].alias("start"),
                    s["stop"].alias("stop"),
                    F.array_join(part, "").alias("word"),
                    names.alias("scripts"),
                    _places(sc, names, s["start"]).alias("minority"),
                ),
            ),
        )

    def judge(arr):
        foreign = F.filter(T.runs(arr, lambda c: c.rlike(T.WORD_CHAR)), lambda s: F.array_join(T.cut(arr, s["start"], s["stop"]), "").rlike(FOREIGN))
        allowed = lambda w: F.lit(False)
        for group in T.AUGMENTED:
            allowed = (lambda before, g: lambda w: before(w) | (F.size(F.array_except(w["scripts"], F.array(*map(F.lit, g)))) == 0))(allowed, group)
        return F.filter(F.transform(foreign, lambda s: word(arr, s)), lambda w: (F.size(w["scripts"]) >= 2) & ~allowed(w))

    return T.let(T.chars(content), judge)


def _places(scripts: Column, names: Column, start: Column) -> Column:
    count = F.transform(names, lambda n: F.size(F.filter(scripts, lambda x: x == n)))
    rarest = F.get(names, F.array_position(count, F.array_min(count)).cast("int") - 1)
    return F.filter(F.transform(scripts, lambda x, i: F.when(x == rarest, start + i)), lambda x: x.isNotNull())


def mixed_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(..., word, scripts, minority, start, end, line, column), one row a mixed word."""
    lines = with_lines(df, text, FOREIGN)
    keep = [c for c in lines.columns if c not in ("content", "offset", "line")]
    found = lines.withColumn("__w", F.explode(line_words(F.col("content"))))
    return found.select(
        *keep,
        F.col("__w.word").alias("word"),
        F.col("__w.scripts").alias("scripts"),
        F.transform("__w.minority", lambda x: x + F.col("offset")).alias("minority"),
        (F.col("offset") + F.col("__w.start")).alias("start"),
        (F.col("offset") + F.col("__w.stop")).alias("end"),
        "line",
        (F.col("__w.start") + 1).alias("column"),
    )
