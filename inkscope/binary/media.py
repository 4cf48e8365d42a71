"""Metadata in images: PNG, JPEG, WebP, TIFF, GIF and SVG.

Every container is cut into ``Part``s, each a byte span with its content; one
reading of a part (``read_part``) serves all of them, and stripping is leaving
spans out.  TIFF and SVG are the exceptions: a TIFF value is overwritten in
place, an SVG element keeps its tags.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from .provenance import AIGC, aigc_label, generator, strips


class Damaged(ValueError):
    """The container ends early or contradicts itself."""


@dataclass(frozen=True)
class Record:
    kind: str
    label: str
    value: str
    bytes: int


@dataclass(frozen=True)
class Part:
    kind: str  # c2pa, xmp, exif, png-text, jpeg-comment
    start: int
    stop: int
    content: bytes
    name: str = ""  # chunk name, where reading depends on it


def shown(raw: bytes) -> str:
    """Trimmed text of a value, at most 120 bytes; empty if it holds control characters."""
    text = raw.decode("utf-8", "replace").strip()
    data = text.encode()
    if len(data) > 120:
        text = data[:120].decode("utf-8", "ignore") + "..."
    return "" if any(ord(c) < 32 and c not in "\t\n" for c in text) else text


def manifest_generator(raw: bytes) -> str:
    """Generator named in a printable run of four bytes or more."""
    return next((n for run in re.findall(rb"[\x20-\x7e]{4,}", raw) if (n := generator(run.decode("ascii"), True))), "")


def is_manifest(raw: bytes) -> bool:
    return b"c2pa" in raw or b"jumb" in raw


def software_span(tiff: bytes) -> tuple[str, int, int] | None:
    """(value, offset, size) of the Software tag of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return None
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return None
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for entry in range(at + 2, min(at + 2 + 12 * count, len(tiff) - 11), 12):
        tag, _, size, where = struct.unpack_from(order + "HHII", tiff, entry)
        if tag == 0x0131:
            where = entry + 8 if size <= 4 else where
            return (shown(tiff[where : where + size].rstrip(b"\0")), where, size) if where + size <= len(tiff) else None
    return None


def creator_tool(raw: bytes) -> str | None:
    m = re.search(rb"xmp:CreatorTool>([^<]*)<", raw)
    return shown(m[1]) if m and raw.find(b"xmp:CreatorTool>") == m.start() else None


def read_part(part: Part) -> Record | None:
    """What a part says; None if it says nothing worth a record."""
    label = value = ""
    raw = part.content
    if part.kind == "c2pa":
        value = manifest_generator(raw)
    elif part.kind == "png-text":
        key, nul, rest = raw.partition(b"\0")
        if nul:
            label, value = key.decode("latin-1"), shown(rest) if part.name == "tEXt" else ""
    elif part.kind == "jpeg-comment":
        value = shown(raw)
    elif part.kind == "exif":
        if found := software_span(raw.removeprefix(b"Exif\0\0")):
            label, value = "Software", found[0]
    elif (tool := creator_tool(raw)) is not None:
        label, value = "CreatorTool", tool
    if part.name != "gif-comment" and (producer := aigc_label(raw)) is not None:
        label, value = AIGC, producer or value
    if part.name.startswith("gif") and not value:
        return None
    return Record(part.kind, label, value, len(raw))


# -- containers -----------------------------------------------------------------------


def _png(data: bytes) -> Iterator[Part]:
    kinds = {b"caBX": "c2pa", b"tEXt": "png-text", b"iTXt": "png-text", b"zTXt": "png-text", b"eXIf": "exif"}
    at = 8
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        stop = at + 12 + size
        if stop > len(data):
            raise Damaged(f"truncated png chunk at offset {at}")
        if name in kinds:
            yield Part(kinds[name], at, stop, data[at + 8 : stop - 4], name.decode())
        if name == b"IEND":
            return
        at = stop


def _jpeg(data: bytes) -> Iterator[Part]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        stop = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        if stop < at + 4 or stop > len(data):
            raise Damaged(f"truncated jpeg segment at offset {at}")
        raw, marker = data[at + 4 : stop], data[at + 1]
        kind = (
            "c2pa" if marker == 0xEB and is_manifest(raw)
            else "xmp" if marker == 0xE1 and raw.startswith(b"http://ns.adobe.com/xap/1.0/\0")
            else "exif" if marker == 0xE1 and raw.startswith(b"Exif\0\0")
            else "jpeg-comment" if marker == 0xFE
            else ""
        )
        if kind:
            yield Part(kind, at, stop, raw)
        at = stop


def _webp(data: bytes) -> Iterator[Part]:
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > len(data):
            raise Damaged(f"chunk at {at} overruns the file")
        raw = data[at + 8 : at + 8 + size]
        stop = min(at + 8 + size + size % 2, len(data))
        kind = {b"EXIF": "exif", b"XMP ": "xmp"}.get(name) or ("c2pa" if is_manifest(raw) else "")
        if kind:
            yield Part(kind, at, stop, raw, name.decode("latin-1"))
        at = stop


def _gif(data: bytes) -> Iterator[Part]:
    if len(data) < 13:
        raise Damaged("truncated gif header")
    at = 13 + (3 * (2 << (data[10] & 7)) if data[10] & 0x80 else 0)
    while at + 1 < len(data) and data[at] == 0x21:
        stop, raw = at + 2, []
        while stop < len(data) and data[stop]:
            raw.append(data[stop + 1 : stop + 1 + data[stop]])
            stop += 1 + data[stop]
        if stop >= len(data):
            raise Damaged(f"truncated gif extension at {at}")
        stop += 1
        if data[at + 1] in (0xFF, 0xFE):
            comment = data[at + 1] == 0xFE
            yield Part("jpeg-comment" if comment else "xmp", at, stop, b"".join(raw), "gif-comment" if comment else "gif-application")
        at = stop


def _tiff(data: bytes) -> Iterator[Part]:
    found = software_span(data)
    if found and found[0]:
        yield Part("exif", found[1], found[1] + found[2], data)


_CONTAINERS: dict[str, Callable[[bytes], Iterator[Part]]] = {"png": _png, "jpeg": _jpeg, "webp": _webp, "gif": _gif, "tiff": _tiff}


def detect(data: bytes) -> str:
    """png, jpeg, webp, tiff, gif, or empty."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return "png"
    if data.startswith(b"\xff\xd8"):
        return "jpeg"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(data) >= 8 and data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "gif" if data[:6] in (b"GIF87a", b"GIF89a") else ""


def _parts(data: bytes) -> tuple[list[tuple[Part, Record]], str]:
    """Parts that have a record, and the error at which reading stopped."""
    out = []
    try:
        for part in _CONTAINERS.get(detect(data), lambda d: iter(()))(data):
            if (record := read_part(part)) is not None:
                out.append((part, record))
    except Damaged as problem:
        return out, str(problem)
    return out, ""


def inspect(data: bytes) -> list[Record]:
    return [record for _, record in _parts(data)[0]]


def strip(data: bytes, mode: str) -> tuple[bytes, bool, str]:
    """(bytes, changed, error) with the records that ``mode`` selects removed."""
    kind = detect(data)
    parts, error = _parts(data)
    if error and (kind in ("png", "jpeg") or not parts):
        return data, False, error
    drop = [p for p, r in parts if strips(mode, r.label, r.value)]
    if not drop:
        return data, False, ""
    if kind == "tiff":
        p = drop[0]
        return data[: p.start] + b"\0" * (p.stop - p.start) + data[p.stop :], True, ""
    edges = [0, *(x for p in drop for x in (p.start, p.stop)), len(data)]
    out = bytearray(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
    if kind == "webp":
        struct.pack_into("<I", out, 4, len(out) - 8)
        flags = {"EXIF": 0x08, "XMP ": 0x04}
        at = out.find(b"VP8X", 12, 16)
        if at >= 0 and len(out) > at + 8:
            for p in drop:
                out[at + 8] &= ~flags.get(p.name, 0) & 0xFF
    return bytes(out), True, ""


# -- SVG ------------------------------------------------------------------------------

_SVG_OPEN = re.compile(r"<(metadata|x:xmpmeta)(?![-_:.0-9A-Za-z])[^>]*(?<!/)>")


def looks_like_svg(text: str) -> bool:
    return "<svg" in text.encode()[:4096].decode("utf-8", "ignore")


def svg_spans(text: str) -> list[tuple[int, int]]:
    """Outermost contents of metadata elements."""
    found = []
    for name in ("metadata", "x:xmpmeta"):
        at = 0
        while m := _SVG_OPEN.search(text, at):
            at = m.end()
            if m[1] != name:
                continue
            stop = text.find(f"</{name}>", at)
            if stop < 0:
                break
            found.append((at, stop))
            at = stop + len(name) + 3
    out: list[tuple[int, int]] = []
    for start, stop in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or stop > out[-1][1]:
            out.append((start, stop))
    return out


def _svg_record(content: str) -> Record | None:
    raw = content.encode()
    kind, label, value = "xmp", "", ""
    if (tool := creator_tool(raw)) is not None:
        label, value = "CreatorTool", tool
    elif (m := re.search(r"<dc:creator>(.*?)</dc:creator>", content, re.S)) and (author := shown(m[1].encode())):
        label, value = "creator", author
    elif is_manifest(raw) and (name := manifest_generator(raw)):
        kind, label, value = "c2pa", "claim_generator", name
    if (producer := aigc_label(raw)) is not None:
        label, value = AIGC, producer or value
    return Record(kind, label, value, len(raw)) if label or value else None


def inspect_svg(text: str) -> list[Record]:
    return [r for a, b in svg_spans(text) if (r := _svg_record(text[a:b])) is not None]


def strip_svg(text: str, mode: str) -> tuple[str, bool]:
    """Metadata elements stay, what ``mode`` selects of their contents goes."""
    out, at = [], 0
    for a, b in svg_spans(text):
        record = _svg_record(text[a:b]) or Record("xmp", "", "", 0)
        if strips(mode, record.label, record.value):
            out.append(text[at:a])
            at = b
    return "".join(out) + text[at:], at > 0


# -- columns ----------------------------------------------------------------------------

RECORDS = ArrayType(
    StructType([StructField("kind", StringType()), StructField("label", StringType()), StructField("value", StringType()), StructField("bytes", IntegerType())])
)
STRIPPED = StructType([StructField("content", BinaryType()), StructField("changed", BooleanType()), StructField("error", StringType())])


def _row(r: Record) -> dict:
    return {"kind": r.kind, "label": r.label, "value": r.value, "bytes": r.bytes}


@F.pandas_udf(RECORDS)
def media_records(content: pd.Series) -> pd.Series:
    return pd.Series([[_row(r) for r in inspect(bytes(c or b""))] for c in content], dtype=object)


@F.pandas_udf(RECORDS)
def svg_records(text: pd.Series) -> pd.Series:
    return pd.Series([[_row(r) for r in inspect_svg(t)] if t and looks_like_svg(t) else [] for t in text], dtype=object)


@F.pandas_udf(STRIPPED)
def strip_media(content: pd.Series, mode: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([strip(bytes(c or b""), m) for c, m in zip(content, mode)], columns=["content", "changed", "error"])


def media_reports(files: DataFrame, content: str = "content") -> DataFrame:
    """Image files with their records, signals and confidence."""
    from ..sources.codec import image_format
    from .provenance import confidence, signals

    out = files.withColumn("format", image_format(F.col(content))).where("format is not null")
    out = out.withColumn("metadata", media_records(F.col(content)))
    out = out.withColumn("provenance", signals(F.col("metadata")))
    return out.withColumn("confidence", confidence(F.col("provenance"))).drop(content)
