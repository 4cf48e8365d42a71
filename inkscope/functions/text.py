"""Column expressions over texts, lines and characters.

Positions are code points.  Regular expressions are Java's; every class is built
from code points.  ``let`` binds a value inside an expression, so that arrays are
computed once a row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import EXTENSIONS, PROSE_NAMES, SCRIPT_PUNCTUATION, char_class

#: Stand-ins for characters found to be legitimate; private use, one each.
FLAG_TAG, NATIVE_MARK = "\ue000", "\ue001"
TAG = char_class(range(0xE0000, 0xE0080))
FLAG = r"\x{1F3F4}"
GROUPS = {
    "cjk": r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}",
    "arabic": r"\p{IsArabic}\p{IsSyriac}\p{IsThaana}",
    "greek": r"\p{IsGreek}",
}
JOINING = (
    "Arabic Syriac Thaana Mongolian Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Myanmar "
    "Khmer Tibetan Javanese Balinese"
).split()
JOINING_CLASS = "[" + "".join(rf"\p{{Is{s}}}" for s in JOINING) + "]"
IDEOGRAPH = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
RTL = r"[\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}]"
CURLY = char_class((0x2018, 0x2019, 0x201C, 0x201D))
DASH = char_class((0x2013, 0x2014))
WORD_CHAR = r"[\p{L}\p{Nd}\p{M}]"
#: The scripts that are tried first, and those that may be mixed.
COMMON_SCRIPTS = "Latin Cyrillic Greek Han Hiragana Katakana Hangul Arabic Hebrew Devanagari Thai Armenian Georgian".split()
AUGMENTED = (("Han", "Hiragana", "Katakana", "Latin"), ("Han", "Hangul", "Latin"), ("Han", "Bopomofo", "Latin"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(text: Column) -> Column:
    return F.split(text, "")


def codepoint_label(ch: Column) -> Column:
    """U+%04X of a character."""
    digits = F.hex(F.ascii(ch))
    return F.concat(F.lit("U+"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")))


def extension(path: Column) -> Column:
    """From the last dot of the base name on; empty without one."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def format_of(path: Column) -> Column:
    """Format by extension, else by base name, else source."""
    pairs = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    ext = extension(path)
    by_name = F.when(F.upper(base_name(path)).isin(PROSE_NAMES), "prose").otherwise("source")
    return F.when(ext != "", F.coalesce(F.element_at(pairs, F.lower(ext)), F.lit("source"))).otherwise(by_name)


# -- censuses -------------------------------------------------------------------


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def group_letters(text: Column, group: str) -> Column:
    return F.regexp_count(text, F.lit(rf"[\p{{L}}&&[{GROUPS[group]}]]"))


def native(text: Column, group: str) -> Column:
    """Whether a tenth or more of the letters belong to the group."""
    n = group_letters(text, group)
    return (n > 0) & (n.cast("double") >= letters(text).cast("double") * 0.1)


def lines_with(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)))


def established(text: Column, form: str, other: str) -> Column:
    """Whether a typographic form is the document's habit: 20 in all, 3 lines, over a tenth."""
    n, m = F.regexp_count(text, F.lit(form)), F.regexp_count(text, F.lit(other))
    return (n + m >= 20) & (lines_with(text, form) >= 3) & (n / (n + m) > 0.1)


def curly_established(text: Column) -> Column:
    return established(text, CURLY, "['\"]")


def dash_established(text: Column) -> Column:
    return established(text, DASH, "-")


# -- suppressions and regions -----------------------------------------------------


def _directive(line: Column, token: str) -> Column:
    at = F.locate(token, line)
    rest = F.substring(line, at + F.lit(len(token)), F.length(line))
    return (at > 0) & ~rest.rlike(r"[^ \t\r*/\->}\])\"'`]")


def suppression(text: Column, directive: str) -> Column:
    """STRUCT(whole_file, lines) of the inline directives."""
    lines = F.split(text, "\n")
    whole = F.exists(lines, lambda x: _directive(x, f"{directive}-file"))
    hit = F.transform(
        lines,
        lambda x, i: F.when(_directive(x, f"{directive}-next-line"), i + 2).when(_directive(x, directive), i + 1).otherwise(F.lit(0)),
    )
    found = F.struct(whole.alias("whole_file"), F.filter(hit, lambda n: n > 0).alias("lines"))
    none = F.struct(F.lit(False).alias("whole_file"), F.array().cast("array<int>").alias("lines"))
    return F.when(F.contains(text, F.lit(directive)), found).otherwise(none)


def code_lines(text: Column) -> Column:
    """1-based lines inside Markdown fences, fences included."""
    lines = F.split(text, "\n")
    start = F.struct(F.lit("").alias("fence"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("n"))

    def step(acc, line):
        mark = F.regexp_extract(line, r"^[ \t]*(`{3,}|~{3,})", 1)
        opens = (acc["fence"] == "") & (mark != "")
        closes = (acc["fence"] != "") & (mark != "") & (F.substring(mark, 1, 1) == F.substring(acc["fence"], 1, 1)) & (F.length(mark) >= F.length(acc["fence"]))
        inside = opens | (acc["fence"] != "")
        return F.struct(
            F.when(opens, mark).when(closes, F.lit("")).otherwise(acc["fence"]).alias("fence"),
            F.when(inside, F.concat(acc["at"], F.array(acc["n"] + 1))).otherwise(acc["at"]).alias("at"),
            (acc["n"] + 1).alias("n"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["at"])


# -- masks: legitimate characters found by one pass of a regular expression ------------


def mask_flag_tags(text: Column) -> Column:
    """Tags that continue a subdivision flag become stand-ins."""
    masked = F.regexp_replace(text, rf"(?:({FLAG})|(?!^)\G)({TAG})", "$1" + FLAG_TAG)
    return F.when(F.contains(text, F.lit(chr(0x1F3F4))), masked).otherwise(text)


def mask_script_marks(text: Column) -> Column:
    """Script punctuation whose nearest letter on either side is of its script becomes stand-ins."""
    for group, letter_class in GROUPS.items():
        marks = char_class(c for c, g in SCRIPT_PUNCTUATION.items() if g == group)
        letter = rf"[\p{{L}}&&[{letter_class}]]"
        between = rf"[^\p{{L}}{marks[1:-1]}]*+"
        masked = F.regexp_replace(text, rf"({letter}{between}|(?!^)\G{between}){marks}", "$1" + NATIVE_MARK)
        masked = F.regexp_replace(masked, rf"{marks}(?=\P{{L}}*+{letter})", NATIVE_MARK)
        text = F.when(text.rlike(marks), masked).otherwise(text)
    return text


# -- runs within a line ---------------------------------------------------------------


def runs(arr: Column, inside) -> Column:
    """ARRAY<STRUCT(start, stop)> of maximal runs of characters for which ``inside`` holds."""
    flag = F.transform(arr, inside)
    return let(
        flag,
        lambda f: F.arrays_zip(
            F.filter(F.transform(f, lambda x, i: F.when(x & ~F.coalesce(F.get(f, i - 1), F.lit(False)), i)), lambda x: x.isNotNull()).alias("start"),
            F.filter(F.transform(f, lambda x, i: F.when(x & ~F.coalesce(F.get(f, i + 1), F.lit(False)), i + 1)), lambda x: x.isNotNull()).alias("stop"),
        ),
    )


def cut(arr: Column, start: Column, stop: Column) -> Column:
    return F.slice(arr, start + 1, stop - start)


# -- scripts -----------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def other_scripts() -> tuple[str, ...]:
    """Names of all further scripts the JVM knows, in order."""
    spark = SparkSession.getActiveSession()
    values = spark.sparkContext._jvm.java.lang.Class.forName("java.lang.Character$UnicodeScript").getEnumConstants()
    special = {"SIGNWRITING": "SignWriting"}
    names = {special.get(str(v), "_".join(p.capitalize() for p in str(v).split("_"))) for v in values}
    return tuple(sorted(names - {*COMMON_SCRIPTS, "Common", "Inherited", "Unknown"}))


def script_of(ch: Column) -> Column:
    """Unicode script of a character; empty for common, inherited and unknown ones."""
    out = F.when(ch.rlike("^[A-Za-z]$"), "Latin").when((F.ascii(ch) < 128) | ch.rlike(r"[\p{IsCommon}\p{IsInherited}]"), "")
    for name in COMMON_SCRIPTS:
        out = out.when(ch.rlike(rf"\p{{Is{name}}}"), name)
    rest = F.when(F.lit(False), "")
    for name in other_scripts():
        rest = rest.when(ch.rlike(rf"\p{{Is{name.upper()}}}"), name)
    return out.otherwise(F.when(ch.rlike(f"[{GROUPS['cjk']}]"), "Bopomofo").otherwise(rest.otherwise("")))
