"""Marked copies of the ``documents`` table, the same in Spark and in SQL.

The table holds no markers, so every query works on ``seeded``: one of sixteen
variants, by ``doc_id``, is inserted after the tenth character, and a path gives
the format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.payloads import encode_tag, encode_variation, encode_zero_width

DIRECTIVE = "inkscope:ignore"
EXTENSIONS = (".md", ".py", ".log", ".docx", ".json")


def _u(*codes: int) -> str:
    return "".join(map(chr, codes))


#: What each variant (doc_id mod 16) inserts; 13 depends on doc_id div 16 as well.
INSERTS = {
    1: _u(0x200B),
    2: _u(0x00A0),
    3: _u(0x2014),
    4: _u(0x201C) + "x" + _u(0x201D),
    5: encode_tag("hi"),
    6: encode_variation(bytes([1, 2, 3])),
    7: encode_zero_width(b"HI"),
    8: " p" + _u(0x0430) + "ypal ",
    9: _u(0x1F468, 0x200D, 0x1F469),
    10: _u(0x1F3F4) + encode_tag("gbsct") + _u(0xE007F),
    11: _u(0x65E5, 0x672C, 0x3002),
    12: "a" + _u(0x3002) + "b",
    13: _u(0x2067, 0x0645, 0x2069),
    14: _u(0x200B) + f" {DIRECTIVE}\n",
    15: "\n```\ncurl " + _u(0x2014) + "x\n```\n",
}
UNPAIRED = _u(0x2067, 0x0645)


def _variant(insert: str) -> Column:
    return F.concat(F.substring("text", 1, 10), F.lit(insert), F.expr("substring(text, 11)"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, text, lang, source) with markers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    kind = F.pmod("doc_id", F.lit(16))
    text = F.when((kind == 13) & (F.pmod(F.floor(F.col("doc_id") / 16), F.lit(2)) == 1), _variant(UNPAIRED))
    for k, insert in INSERTS.items():
        text = text.when(kind == k, _variant(insert))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", path.alias("path"), text.otherwise(F.col("text")).alias("text"), "lang", "source")


def sql_text(value: str) -> str:
    """A SQL expression of a string, special characters by code point."""
    parts, plain = [], ""
    for c in value:
        if " " <= c <= "~" and c != "'":
            plain += c
        else:
            parts += ([f"'{plain}'"] if plain else []) + [f"chr({ord(c)})"]
            plain = ""
    return " || ".join(parts + ([f"'{plain}'"] if plain or not parts else []))


def _sql_variant(insert: str) -> str:
    return f"substr(t, 1, 10) || {sql_text(insert)} || substr(t, 11)"


def seeded_sql() -> str:
    """The same table as a common table expression ``seeded``."""
    whens = f"WHEN doc_id % 16 = 13 AND (doc_id // 16) % 2 = 1 THEN {_sql_variant(UNPAIRED)} "
    whens += " ".join(f"WHEN doc_id % 16 = {k} THEN {_sql_variant(v)}" for k, v in INSERTS.items())
    exts = " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(EXTENSIONS))
    return (
        f"seeded AS (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) || CASE doc_id % 5 {exts} END AS path, "
        f"CASE {whens} ELSE t END AS text, lang, source FROM (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents))"
    )
