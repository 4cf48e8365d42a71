"""Properties and text of documents: OOXML, ODF, EPUB and PDF.

Archives are read with the zip directory; a fix rewrites the entries it must and
copies every other entry's bytes as they stand, compressed data and all.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType, StructField, StructType

from .provenance import strips

#: Which entries hold properties, and which text.
PARTS = {
    "ooxml": (("docProps/core.xml", "docProps/app.xml"), ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml", "xl/sharedStrings.xml", "ppt/slides/", "word/header", "word/footer")),
    "odf": (("meta.xml",), ("content.xml",)),
    "epub": ((".opf",), (".xhtml", ".html", ".htm")),
}
ENTRY_LIMIT = 32 << 20
_INFO = re.compile(rb"/(Producer|Creator|Author|Title|Subject)\s*\(([^)]{0,200})\)")


def _open(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError):
        return None


def detect(data: bytes) -> str:
    """pdf, ooxml, odf, epub, or empty; an archive by its first telling entry."""
    if data.startswith(b"%PDF-"):
        return "pdf"
    if not data.startswith(b"PK\x03\x04") or (archive := _open(data)) is None:
        return ""
    for name in archive.namelist():
        if name.startswith(("docProps/", "word/", "xl/", "ppt/")):
            return "ooxml"
        if name in ("meta.xml", "content.xml"):
            return "odf"
        if name == "META-INF/container.xml":
            return "epub"
    return ""


def _belongs(kind: str, name: str, part: int) -> bool:
    return name.endswith(PARTS[kind][part]) if kind == "epub" else name.startswith(PARTS[kind][part])


def short(text: str) -> str:
    data = text.encode()
    return text if len(data) <= 120 else data[:120].decode("utf-8", "ignore") + "..."


def _entry(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes | None:
    try:
        with archive.open(info) as file:
            return file.read(ENTRY_LIMIT)
    except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError, EOFError):
        return None


class _Walk:
    """Start, end and text events of an XML document with their byte spans.

    Stops at the first error and keeps what came before it.
    """

    def __init__(self, content: bytes, start=None, end=None, text=None):
        parser = expat.ParserCreate()
        parser.buffer_text = False
        self.parser = parser
        local = lambda name: name.rsplit(":", 1)[-1]
        parser.StartElementHandler = lambda name, attrs: start and start(local(name), {local(k): v for k, v in attrs.items()}, parser.CurrentByteIndex)
        parser.EndElementHandler = lambda name: end and end(local(name), parser.CurrentByteIndex)
        parser.CharacterDataHandler = lambda data: text and text(data, parser.CurrentByteIndex)
        try:
            parser.Parse(content, True)
        except expat.ExpatError:
            pass


def _meta_pair(name: str, attrs: dict[str, str]) -> tuple[str, str] | None:
    if name != "meta":
        return None
    label = value = ""
    for k, v in attrs.items():
        if k in ("name", "property"):
            label = v
        elif k == "content":
            value = v
    return (label, value) if label and value else None


def leaf_values(content: bytes) -> list[tuple[str, str]]:
    """(label, value) of every leaf element, and of named meta elements."""
    out: list[tuple[str, str]] = []
    state = {"name": "", "text": []}

    def start(name, attrs, _):
        if pair := _meta_pair(name, attrs):
            out.append((pair[0], short(pair[1])))
        state.update(name=name, text=[])

    def end(name, _):
        value = "".join(state["text"]).strip()
        if name == state["name"] and value:
            out.append((name, short(value)))
        state.update(name="", text=[])

    _Walk(content, start, end, lambda data, _: state["text"].append(data))
    return out


def xml_text(content: bytes) -> str:
    out: list[str] = []
    _Walk(content, text=lambda data, _: out.append(data))
    return "".join(out)


def _pdf_value(raw: bytes) -> str:
    text = re.sub(r"\\([()\\])", r"\1", raw.decode("utf-8", "replace"))
    return "" if any(ord(c) < 32 and c != "\t" for c in text) else text.strip()


def read(data: bytes) -> tuple[str, list[tuple[str, str]], str]:
    """(format, (label, value) records, text of the body)."""
    kind = detect(data)
    if kind == "pdf":
        found = dict.fromkeys((m[1].decode(), _pdf_value(m[2])) for m in _INFO.finditer(data))
        records = [(label, short(value)) for label, value in found if value]
        return kind, records + [("XMP", "present")] * (b"<x:xmpmeta" in data), ""
    if not kind:
        return "", [], ""
    archive = _open(data)
    records, body = [], []
    for info in archive.infolist():
        part = 0 if _belongs(kind, info.filename, 0) else 1 if _belongs(kind, info.filename, 1) else None
        if part is None or (content := _entry(archive, info)) is None:
            continue
        if part == 0:
            records += leaf_values(content)
        else:
            body.append(xml_text(content) + "\n")
    return kind, records, "".join(body)


# -- fixing -----------------------------------------------------------------------------


def fix_pdf(data: bytes, mode: str) -> tuple[bytes, bool]:
    """Blank the selected properties without moving a byte; escaped values stay."""

    def blank(m: re.Match) -> bytes:
        raw = m[2]
        value = b"" if b"\\" in raw else _pdf_value(raw)
        if not value or not strips(mode, m[1].decode(), value):
            return m[0]
        return m[0][: m.start(2) - m.start() - 1] + b"()" + b" " * len(raw)

    out = _INFO.sub(blank, data)
    return out, out != data


def _splice(content: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for start, stop, new in sorted(edits):
        out += [content[at:start], new]
        at = stop
    return b"".join([*out, content[at:]])


_TEXT_RUN = re.compile(rb"<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<[^>]*>|([^<]+)", re.S)


def fix_text(content: bytes, replace: Callable[[str], str]) -> bytes:
    """Rewrite the character data between tags; markup and entities stay as written."""
    edits = []
    for m in _TEXT_RUN.finditer(content):
        if m[1] is not None:
            try:
                old = m[1].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if (new := replace(old)) != old:
                edits.append((m.start(1), m.end(1), new.encode()))
    return _splice(content, edits)


_CONTENT = re.compile(rb"(?<![-_:.0-9A-Za-z])content[ \t]*=[ \t]*(?:\"([^\"]*)\"|'([^']*)')")


def blank_properties(content: bytes, mode: str) -> bytes:
    """Empty the selected leaf values and ``content`` attributes."""
    edits = []
    element = [""]

    def start(name, attrs, at):
        element[0] = name
        pair = _meta_pair(name, attrs)
        if pair and strips(mode, *pair) and (m := _CONTENT.search(content, at, content.find(b">", at))):
            k = 1 if m[1] is not None else 2
            edits.append((m.start(k), m.end(k), b""))

    def end(name, at):
        element[0] = ""

    def text(data, at):
        if element[0] and data.strip() and strips(mode, element[0], data.strip()):
            stop = content.find(b"<", at)
            edits.append((at, len(content) if stop < 0 else stop, b""))

    _Walk(content, start, end, text)
    merged = {e[0]: e for e in edits}
    return _splice(content, list(merged.values()))


def _copy(data: bytes, info: zipfile.ZipInfo, out: bytearray) -> tuple[int, int, int, int, int]:
    """Append an entry's local header and data unchanged; (offset, crc, sizes, flags)."""
    name, extra = struct.unpack_from("<HH", data, info.header_offset + 26)
    begin = info.header_offset + 30 + name + extra
    offset = len(out)
    header = bytearray(data[info.header_offset : begin])
    struct.pack_into("<III", header, 14, info.CRC, info.compress_size, info.file_size)
    flags = info.flag_bits & ~0x08  # sizes stand in the header, no descriptor follows
    struct.pack_into("<H", header, 6, flags)
    out += header + data[begin : begin + info.compress_size]
    return offset, info.CRC, info.compress_size, info.file_size, flags


def fix_archive(data: bytes, kind: str, mode: str, replace: Callable[[str], str] | None) -> tuple[bytes, bool]:
    """Rewrite body text and blank properties; other entries keep their bytes."""
    archive = _open(data)
    out, directory, changed = bytearray(), bytearray(), False
    for info in archive.infolist():
        new = None
        if replace is not None and _belongs(kind, info.filename, 1):
            old = _entry(archive, info)
            new = fix_text(old, replace) if old is not None else None
        elif mode != "none" and _belongs(kind, info.filename, 0):
            old = _entry(archive, info)
            new = blank_properties(old, mode) if old is not None else None
        if new is None or new == old:
            offset, crc, packed, size, flags = _copy(data, info, out)
            method = info.compress_type
        else:
            changed = True
            method = info.compress_type if info.compress_type in (0, 8) else 8
            squeeze = zlib.compressobj(-1, zlib.DEFLATED, -15)
            body = squeeze.compress(new) + squeeze.flush() if method == 8 else new
            offset, crc, packed, size, flags = len(out), zlib.crc32(new), len(body), len(new), info.flag_bits & ~0x08
            name = info.orig_filename.encode("utf-8" if flags & 0x800 else "cp437", "replace")
            out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 20, flags, method, *_dos_time(info), crc, packed, size, len(name), 0) + name + body
        name = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace")
        directory += struct.pack(
            "<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", info.create_system << 8 | info.create_version, info.extract_version, flags, method, *_dos_time(info), crc, packed, size,
            len(name), len(info.extra), len(info.comment), 0, info.internal_attr, info.external_attr, offset,
        )
        directory += name + info.extra + info.comment
    if not changed:
        return data, False
    count = len(archive.infolist())
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, count, count, len(directory), len(out), len(archive.comment))
    return bytes(out + directory + end + archive.comment), True


def _dos_time(info: zipfile.ZipInfo) -> tuple[int, int]:
    y, mo, d, h, mi, s = info.date_time
    return h << 11 | mi << 5 | s // 2, (y - 1980) << 9 | mo << 5 | d


def fix(data: bytes, mode: str = "none", replace: Callable[[str], str] | None = None) -> tuple[bytes, bool]:
    """(bytes, changed) with properties stripped by ``mode`` and body text rewritten."""
    kind = detect(data)
    if kind == "pdf":
        return fix_pdf(data, mode)
    return fix_archive(data, kind, mode, replace) if kind else (data, False)


def residue(data: bytes, values: list[str]) -> list[str]:
    """Stripped values whose bytes are still in the file."""
    return [v for v in values if v and v.encode() in data]


def text_runs(data: bytes) -> list[str]:
    """Distinct character data of the body parts, as written between tags."""
    kind = detect(data)
    if not kind or kind == "pdf":
        return []
    archive, out = _open(data), {}
    for info in archive.infolist():
        if _belongs(kind, info.filename, 1) and (content := _entry(archive, info)) is not None:
            for m in _TEXT_RUN.finditer(content):
                if m[1] is not None:
                    out[m[1].decode("utf-8", "replace")] = None
    return list(out)


# -- columns ----------------------------------------------------------------------------

DOCUMENT = StructType(
    [
        StructField("format", StringType()),
        StructField("metadata", ArrayType(StructType([StructField("label", StringType()), StructField("value", StringType())]))),
        StructField("text", StringType()),
    ]
)


@F.pandas_udf(DOCUMENT)
def read_document(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        kind, records, text = read(bytes(c or b""))
        rows.append((kind, [{"label": a, "value": b} for a, b in records], text))
    return pd.DataFrame(rows, columns=["format", "metadata", "text"])


@F.pandas_udf(ArrayType(StringType()))
def runs_of(content: pd.Series) -> pd.Series:
    return pd.Series([text_runs(bytes(c or b"")) for c in content], dtype=object)


FIXED = StructType([StructField("content", BinaryType()), StructField("changed", BooleanType()), StructField("residue", ArrayType(StringType()))])


@F.pandas_udf(FIXED)
def fix_content(content: pd.Series, mode: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for c, m, a, b in zip(content, mode, old, new):
        data = bytes(c or b"")
        edits = dict(zip(a, b)) if a is not None else {}
        out, changed = fix(data, m, (lambda s, e=edits: e.get(s, s)) if edits else None)
        gone = [v for label, v in read(data)[1] if m != "none" and strips(m, label, v)]
        rows.append((out, changed, residue(out, gone) if changed else []))
    return pd.DataFrame(rows, columns=["content", "changed", "residue"])


def fix_documents(files: DataFrame, options, mode: str = "none", path: str = "path", content: str = "content") -> DataFrame:
    """(path, content, changed, residue) of the containers among ``files``, cleaned.

    Character data is taken out, cleaned as texts of that path, and put back; each
    run is judged by itself.  ``residue`` lists stripped values that the new bytes still hold.
    """
    from ..operators.detect import clean_text
    from ..sources.codec import maybe_container

    held = files.where(maybe_container(F.col(content))).select(F.col(path).alias("path"), F.col(content).alias("content"))
    runs = held.select("path", F.explode(runs_of(F.col("content"))).alias("text")).withColumn("run", F.struct("path", "text"))
    done = clean_text(runs, options, "run").where("changed").groupBy("path").agg(F.collect_list(F.struct("text", "clean_text")).alias("e"))
    joined = held.join(done, "path", "left")
    fixed = fix_content(F.col("content"), F.lit(mode), F.col("e.text"), F.col("e.clean_text"))
    return joined.select("path", fixed.alias("f")).select("path", "f.*")


def document_reports(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, format, metadata, text) of the containers among ``files``."""
    from ..sources.codec import maybe_container
    from .provenance import confidence, signals

    out = files.where(maybe_container(F.col(content))).withColumn("__d", read_document(F.col(content)))
    out = out.select("path", "__d.*").where("format <> ''")
    kind = F.concat(F.col("format"), F.lit("-property"))
    records = F.transform("metadata", lambda m: F.struct(kind.alias("kind"), m["label"].alias("label"), m["value"].alias("value"), F.lit(0).alias("bytes")))
    out = out.withColumn("metadata", records).withColumn("provenance", signals(F.col("metadata")))
    return out.withColumn("confidence", confidence(F.col("provenance")))
