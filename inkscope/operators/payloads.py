"""Data encoded in runs of invisible characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import char_class
from .lines import with_lines

VARIATION = char_class([*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
ZERO_WIDTH = char_class((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
CARRIER = "[" + T.TAG[1:-1] + VARIATION[1:-1] + ZERO_WIDTH[1:-1] + "]"
#: A run must be this long to be worth a look: tags 1, selectors 2, bits 8.
SCHEMES = ("tag-ascii", "variation-selector", "zero-width-binary")


def _printable(raw: Column) -> Column:
    text = raw.cast("string")
    fine = F.is_valid_utf8(text) & ~text.rlike(r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\t\r]") & text.rlike(r"[^ \n\t\r]")
    return F.when(fine, text)


def _tag_bytes(run: Column) -> Column:
    shown = F.filter(run, lambda c: c.rlike(char_class(range(0xE0020, 0xE007F))))
    return F.unhex(F.array_join(F.transform(shown, lambda c: F.lpad(F.hex(F.ascii(c) - F.lit(0xE0000)), 2, "0")), ""))


def _variation_bytes(run: Column) -> Column:
    value = lambda c: F.when(F.ascii(c) < 0xE0100, F.ascii(c) - 0xFE00).otherwise(F.ascii(c) - 0xE0100 + 16)
    return F.unhex(F.array_join(F.transform(run, lambda c: F.lpad(F.hex(value(c)), 2, "0")), ""))


def _bits(run: Column) -> Column:
    return F.transform(F.filter(run, lambda c: c.rlike(char_class((0x200B, 0x200C)))), lambda c: F.when(c == "\u200c", "1").otherwise("0"))


def _zero_width_bytes(run: Column) -> Column:
    def pack(bits):
        octets = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(bits) / 8).cast("int") - 1),
            lambda k: F.lpad(F.conv(F.array_join(F.slice(bits, k * 8 + 1, F.lit(8)), ""), 2, 16), 2, "0"),
        )
        return F.when(F.size(bits) >= 8, F.unhex(F.array_join(octets, "")))

    return T.let(_bits(run), pack)


_DECODE = {SCHEMES[0]: (T.TAG, _tag_bytes), SCHEMES[1]: (VARIATION, _variation_bytes), SCHEMES[2]: (ZERO_WIDTH, _zero_width_bytes)}


def line_payloads(content: Column) -> Column:
    """ARRAY<STRUCT(scheme, start, stop, bytes)> of one line, by scheme, then place."""

    def scheme(arr, name):
        pattern, decode = _DECODE[name]
        spans = T.runs(arr, lambda c: c.rlike(pattern))
        if name == SCHEMES[0]:
            spans = F.filter(spans, lambda s: F.coalesce(F.get(arr, s["start"] - 1), F.lit("")) != "\U0001f3f4")
        if name == SCHEMES[1]:
            spans = F.filter(spans, lambda s: s["stop"] - s["start"] >= 2)
        decoded = F.transform(
            spans,
            lambda s: F.struct(F.lit(name).alias("scheme"), s["start"].alias("start"), s["stop"].alias("stop"), decode(T.cut(arr, s["start"], s["stop"])).alias("bytes")),
        )
        return F.when(content.rlike(pattern), F.filter(decoded, lambda p: F.octet_length(p["bytes"]) > 0)).otherwise(F.lit(None))

    empty = F.array().cast("array<struct<scheme:string,start:int,stop:int,bytes:binary>>")
    return T.let(T.chars(content), lambda arr: F.concat(*[F.coalesce(scheme(arr, n), empty) for n in SCHEMES]))


def payloads(df: DataFrame, text: str = "text") -> DataFrame:
    """(..., scheme, start, end, runes, bytes, text, printable, line, column), one row a payload.

    Spans are half open, in code points of the document.
    """
    lines = with_lines(df, text, CARRIER)
    keep = [c for c in lines.columns if c not in ("content", "offset", "line")]
    found = lines.withColumn("__p", F.explode(line_payloads(F.col("content"))))
    shown = _printable(F.col("__p.bytes"))
    return found.select(
        *keep,
        F.col("__p.scheme").alias("scheme"),
        (F.col("offset") + F.col("__p.start")).alias("start"),
        (F.col("offset") + F.col("__p.stop")).alias("end"),
        (F.col("__p.stop") - F.col("__p.start")).alias("runes"),
        F.col("__p.bytes").alias("bytes"),
        F.coalesce(shown, F.lit("")).alias("decoded"),
        shown.isNotNull().alias("printable"),
        "line",
        (F.col("__p.start") + 1).alias("column"),
    )


# -- encoders, the inverse ------------------------------------------------------------


def encode_tag(text: str) -> str:
    return "".join(chr(0xE0000 + b) for b in text.encode("ascii"))


def encode_variation(data: bytes) -> str:
    return "".join(chr(0xFE00 + b) if b < 16 else chr(0xE0100 + b - 16) for b in data)


def encode_zero_width(data: bytes) -> str:
    return "".join("\u200c" if b >> k & 1 else "\u200b" for b in data for k in range(7, -1, -1))
