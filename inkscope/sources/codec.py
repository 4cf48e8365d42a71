"""Bytes to text and back: BOMs, UTF-8, UTF-16, UTF-32, Latin-1, and the binary test.

Errors are data: a row that cannot be decoded has an ``error``, no task fails.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

#: Byte order marks, the longer before its prefix.
BOMS = (
    (b"\xff\xfe\x00\x00", "utf-32le"),
    (b"\x00\x00\xfe\xff", "utf-32be"),
    (b"\xff\xfe", "utf-16le"),
    (b"\xfe\xff", "utf-16be"),
    (b"\xef\xbb\xbf", "utf-8"),
)
_MARK = {name: mark for mark, name in BOMS}
_CONTROL = bytes(b for b in range(32) if b not in b"\t\n\r\f\x1b")
_SHOWN = bytes([9, 10, 13, *range(32, 127)])


def sniff(data: bytes) -> tuple[str, int]:
    """(encoding, length of the mark) by byte order mark; UTF-8 without one."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return name, len(mark)
    return "utf-8", 0


def decode(data: bytes) -> tuple[str | None, str, bool, str]:
    """(text, encoding, had a mark, error)."""
    name, skip = sniff(data)
    body = data[skip:]
    try:
        return body.decode(name), name, skip > 0, ""
    except UnicodeDecodeError as problem:
        if name == "utf-8":
            return body.decode("latin-1"), "latin-1", skip > 0, ""
        return None, name, skip > 0, f"invalid {name[:-2]}: {problem.reason}"


def encode(text: str, name: str, mark: bool) -> tuple[bytes | None, str]:
    """(bytes, error) in the encoding the text came in."""
    lead = _MARK.get(name, _MARK["utf-8"]) if mark else b""
    try:
        return lead + text.encode(name, "strict"), ""
    except UnicodeEncodeError as problem:
        return None, f"cannot encode U+{ord(text[problem.start]):04X} as {name}"


def is_binary(data: bytes) -> bool:
    name, skip = sniff(data)
    if (skip and name != "utf-8") or not data:
        return False
    if b"\0" in data:
        return True
    if len(data) - len(data.translate(None, _CONTROL)) > 0.1 * len(data):
        return True
    try:
        data.decode("utf-8")
        return False
    except UnicodeDecodeError:
        return len(data) - len(data.translate(None, _SHOWN)) <= 0.75 * len(data)


_DECODED = StructType(
    [StructField("text", StringType()), StructField("encoding", StringType()), StructField("had_bom", BooleanType()), StructField("error", StringType())]
)


@F.pandas_udf(_DECODED)
def decode_bytes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(c or b"")) for c in content], columns=["text", "encoding", "had_bom", "error"])


@F.pandas_udf(BooleanType())
def binary_test(content: pd.Series) -> pd.Series:
    return pd.Series([is_binary(bytes(c or b"")) for c in content])


@F.pandas_udf(BinaryType())
def encode_text(text: pd.Series, encoding: pd.Series, mark: pd.Series) -> pd.Series:
    return pd.Series([encode(t, e, bool(m))[0] if t is not None else None for t, e, m in zip(text, encoding, mark)], dtype=object)


def image_format(content: Column) -> Column:
    """Image container by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(F.startswith(head, F.lit("FFD8")), "jpeg")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
        .when(head.rlike("^(49492A00|4D4D002A)"), "tiff")
        .when(head.rlike("^474946383[79]61"), "gif")
    )


def maybe_container(content: Column) -> Column:
    """PDF or zip by the first bytes."""
    return F.hex(F.substring(content, 1, 5)).rlike("^(255044462D|504B0304)")


def scannable(content: Column) -> Column:
    """What a scan keeps, judged by the first 4096 bytes."""
    head = F.substring(content, 1, 4096)
    return (F.octet_length(content) == 0) | image_format(content).isNotNull() | maybe_container(content) | ~binary_test(head)


def decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with text, encoding, had_bom and error."""
    return df.withColumn("__d", decode_bytes(F.col(content))).select("*", "__d.*").drop("__d")
