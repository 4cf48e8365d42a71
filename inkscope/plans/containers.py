"""Registered queries of image, document and text containers, built from ``documents``."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ..binary import document, media
from ..operators import detect, summary
from ..options import Options
from ..sinks import reports as sinks
from ..sources import codec
from .queries import BASE, _pdf, _tools, query
from .seeding import seeded


def _exif(value: bytes) -> bytes:
    """A directory whose one entry names the software."""
    return b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x0131, 2, len(value) + 1, 26, 0) + value + b"\0"


def _xmp(value: bytes) -> bytes:
    return b"<x><xmp:CreatorTool>" + value + b"</xmp:CreatorTool></x>"


def _jpeg(value: bytes) -> bytes:
    bodies = ((0xFE, value), (0xE1, b"Exif\0\0" + _exif(value)), (0xE1, b"http://ns.adobe.com/xap/1.0/\0" + _xmp(value)), (0xEB, b"jumb c2pa\0" + value + b"\0"))
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body for marker, body in bodies) + b"\xff\xda\0\0\xff\xd9"


def _webp(value: bytes) -> bytes:
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = b"WEBP" + part(b"VP8X", b"\x0c" + b"\0" * 9) + part(b"EXIF", _exif(value)) + part(b"XMP ", _xmp(value))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _gif(value: bytes) -> bytes:
    block = lambda body: bytes([len(body)]) + body
    return b"GIF89a" + b"\1\0\1\0\0\0\0" + b"\x21\xfe" + block(value) + b"\0\x21\xff" + block(b"XMP DataXMP") + block(_xmp(value)) + b"\0;"


def _zip(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in entries:
            archive.writestr(name, body)
    return out.getvalue()


def _office(value: bytes, said: bytes) -> bytes:
    return _zip([("docProps/app.xml", b"<Properties><Application>" + value + b"</Application><Pages>1</Pages></Properties>"), ("word/document.xml", b"<d><t>" + said + b"</t></d>")])


def _open_document(value: bytes, said: bytes) -> bytes:
    return _zip([("meta.xml", b"<m><generator>" + value + b"</generator></m>"), ("content.xml", b"<c><p>" + said + b"</p></c>")])


def _book(value: bytes, said: bytes) -> bytes:
    opf = b'<p><meta name="generator" content="' + value + b'"/></p>'
    return _zip([("META-INF/container.xml", b"<c/>"), ("a.opf", opf), ("b.xhtml", b"<html><p>" + said + b"</p></html>")])


def _built(make) -> Column:
    """Bytes that ``make`` builds from the column ``value``."""

    @F.pandas_udf(BinaryType())
    def run(value: pd.Series) -> pd.Series:
        return pd.Series([make(v.encode()) for v in value], dtype=object)

    return run(F.col("value"))


def _images(spark, sf_dir, make):
    return _tools(spark, sf_dir).select("doc_id", "value", _built(make).alias("content"))


def _records(spark, sf_dir, make):
    seen = media.media_reports(_images(spark, sf_dir, make).drop("value"))
    return seen.select("doc_id", "confidence", F.explode("metadata").alias("m")).select("doc_id", "m.kind", "m.label", "m.value", F.col("m.bytes").cast("long").alias("bytes"), "confidence")


def _stripped(spark, sf_dir, make):
    """Bytes lost under each mode, and whether reading again finds anything."""
    mode = F.when(F.col("doc_id") % 2 == 0, "ai").otherwise("all")
    done = _images(spark, sf_dir, make).withColumn("s", media.strip_media(F.col("content"), mode))
    left = F.size(F.filter(media.media_records(F.col("s.content")), lambda r: r["value"] != ""))
    return done.select("doc_id", F.col("s.changed").alias("changed"), (F.octet_length("content") - F.octet_length("s.content")).cast("long").alias("bytes_removed"), left.cast("long").alias("n_left"))


@query
def jpeg_records(spark, sf_dir):
    return _records(spark, sf_dir, _jpeg)


@query
def jpeg_strip(spark, sf_dir):
    return _stripped(spark, sf_dir, _jpeg)


@query
def webp_records(spark, sf_dir):
    return _records(spark, sf_dir, _webp)


@query
def webp_strip(spark, sf_dir):
    return _stripped(spark, sf_dir, _webp)


@query
def gif_records(spark, sf_dir):
    return _records(spark, sf_dir, _gif)


@query
def gif_strip(spark, sf_dir):
    return _stripped(spark, sf_dir, _gif)


@query
def tiff_records(spark, sf_dir):
    return _records(spark, sf_dir, _exif)


@query
def tiff_strip(spark, sf_dir):
    return _stripped(spark, sf_dir, _exif)


@query
def aigc_labels(spark, sf_dir):
    """Labels of AI content in a text chunk, by doc_id: with a producer, a provider only, no provider, not closed."""
    k, v = F.col("doc_id") % 4, F.col("value")
    label = (
        F.when(k == 0, F.concat(F.lit('AIGC:{"ContentProducer":"'), v, F.lit('","ServiceProvider":"p"}')))
        .when(k == 1, F.concat(F.lit('"AIGC": {"x":{}, "ServiceProvider" : "'), v, F.lit('"}')))
        .when(k == 2, F.lit('AIGC:{"ContentProducer":"x"}'))
        .otherwise(F.lit('AIGC:{"ServiceProvider":"x"'))
    )
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0" * 4
    made = _built(lambda text: b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"note\0" + text) + chunk(b"IEND", b""))
    seen = media.media_reports(_tools(spark, sf_dir).withColumn("value", label).select("doc_id", made.alias("content")))
    return seen.select("doc_id", F.explode("metadata").alias("m"), "confidence").select("doc_id", "m.label", F.when(F.col("m.label") == "AIGC", F.col("m.value")).otherwise("").alias("value"), "confidence")


@query
def image_damage(spark, sf_dir):
    """Containers cut short: records before the damage are read, stripping leaves the bytes alone."""
    whole = F.when(F.col("doc_id") % 2 == 0, _built(_jpeg)).otherwise(_built(_gif))
    held = _tools(spark, sf_dir).withColumn("content", whole)
    held = held.withColumn("content", F.substring("content", F.lit(1), F.octet_length("value") + 30))
    done = held.withColumn("s", media.strip_media(F.col("content"), F.lit("all"))).withColumn("m", media.media_records(F.col("content")))
    return done.select("doc_id", F.size("m").cast("long").alias("n_records"), (F.octet_length("content") - F.octet_length("s.content")).cast("long").alias("bytes_removed"))


def _svg(value: Column) -> Column:
    inner = F.concat(F.lit("<metadata><x:xmpmeta><xmp:CreatorTool>"), value, F.lit("</xmp:CreatorTool></x:xmpmeta></metadata>"))
    return F.concat(F.lit("<svg>"), inner, F.lit("<metadata/><g/><metadata><dc:creator>"), value, F.lit("</dc:creator></metadata></svg>"))


@query
def svg_spans(spark, sf_dir):
    """Nested metadata gives one record, of the outermost element; texts without the root give none."""
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("<metadata><xmp:CreatorTool>x</xmp:CreatorTool></metadata>")).otherwise(_svg(F.col("value")))
    seen = _tools(spark, sf_dir).select("doc_id", F.explode(media.svg_records(text)).alias("m"))
    return seen.select("doc_id", "m.label", "m.value", F.col("m.bytes").cast("long").alias("bytes"))


@F.pandas_udf(StringType())
def _svg_stripped(text: pd.Series, mode: pd.Series) -> pd.Series:
    return pd.Series([media.strip_svg(t, m)[0] for t, m in zip(text, mode)])


@query
def svg_strip(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 2 == 0, "ai").otherwise("all")
    return _tools(spark, sf_dir).select("doc_id", F.sha2(_svg_stripped(_svg(F.col("value")), mode), 256).alias("svg_sha256"))


# -- documents ----------------------------------------------------------------------------------


def _archives(spark, sf_dir):
    """An office document, an open document or a book by doc_id; the body says "body of n", with a marker in each seventh."""

    @F.pandas_udf(BinaryType())
    def made(doc_id: pd.Series, value: pd.Series) -> pd.Series:
        kinds = (_office, _open_document, _book)
        return pd.Series([kinds[k % 3](v.encode(), f"body of {k}{chr(0x200B) if k % 7 == 0 else ''}".encode()) for k, v in zip(doc_id, value)], dtype=object)

    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".docx"))
    return _tools(spark, sf_dir).select("doc_id", path.alias("path"), "value", made("doc_id", "value").alias("content"))


@query
def archive_records(spark, sf_dir):
    seen = document.document_reports(_archives(spark, sf_dir).select("path", "content"))
    return seen.select("path", "format", F.explode("metadata").alias("m"), "confidence").select("path", "format", "m.label", "m.value", "confidence")


@query
def archive_text(spark, sf_dir):
    seen = document.document_reports(_archives(spark, sf_dir).select("path", "content"))
    return seen.select("path", "text")


@query
def archive_fix(spark, sf_dir):
    """Fixing strips AI tools and markers; what is read again, and stripped values still in the bytes."""
    options = Options(clean=True)
    done = document.fix_documents(_archives(spark, sf_dir).select("path", "content"), options, "ai")
    again = document.document_reports(done.select("path", "content"))
    return done.join(again, "path").select(
        "path", "changed", F.size("residue").cast("long").alias("n_residue"), "text", F.size(F.filter("metadata", lambda m: m["label"].isin("Application", "generator"))).cast("long").alias("n_tools")
    )


@query
def pdf_fix(spark, sf_dir):
    """Blanking keeps every byte in place."""
    files = _pdf(spark, sf_dir)
    done = document.fix_documents(files, Options(), "all").withColumnRenamed("content", "fixed")
    again = document.document_reports(done.select("path", F.col("fixed").alias("content"))).select("path", F.size("metadata").cast("long").alias("n_left"))
    both = files.join(done, "path").join(again, "path")
    return both.select("doc_id", "changed", (F.octet_length("content") == F.octet_length("fixed")).alias("same_size"), "n_left")


# -- text containers ----------------------------------------------------------------------------


@query
def decode_errors(spark, sf_dir):
    """UTF-32, UTF-16 cut within a unit, and bytes that are no UTF-8 behind its mark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    k = F.col("doc_id") % 4
    raw = lambda digits: F.unhex(F.lit(digits))
    content = (
        F.when(k == 0, F.concat(raw("0000FEFF"), F.encode("t", "UTF-32")))
        .when(k == 1, F.concat(raw("FFFE"), F.encode("t", "UTF-16LE"), raw("41")))
        .when(k == 2, F.concat(raw("FEFF"), F.encode("t", "UTF-16BE"), raw("00")))
        .otherwise(F.concat(raw("EFBBBF"), F.encode("t", "UTF-8"), raw("FF")))
    )
    seen = codec.decoded(docs.select("doc_id", content.alias("content")))
    return seen.select("doc_id", "encoding", "had_bom", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"), (F.col("error") != "").alias("failed"))


@query
def scannable_files(spark, sf_dir):
    """What a scan keeps, judged by the first 4,096 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    heads = [b"plain text\n", b"ab\0c", b"\x89PNG\r\n\x1a\n\0\0", b"", b"a" * 4096 + b"\0", bytes(range(1, 9))]
    content = F.unhex(F.element_at(F.array(*[F.lit(h.hex()) for h in heads]), (F.col("doc_id") % 6 + 1).cast("int")))
    return docs.select("doc_id", codec.scannable(content).alias("kept"))


#: (extension, text): curly quotes where the grammar of the format decides what may stand for them.
QUOTED = (
    (".toml", "a = \"x“y”z\""), (".toml", "a = 'x“y”z'"), (".toml", "# x“y”z"), (".yaml", "a: \"x“y”z\""),
    (".yaml", "a: 'x“y”z'"), (".json", "{\"a\": \"x“y”z\"}"), (".ini", "a = x“y”z"), (".py", "a = 'x“y”z'"),
)


def _cases(spark, sf_dir, cases):
    """(doc_id, path, text): one of the cases (extension, text) by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    at = (F.col("doc_id") % len(cases) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cases]), at)
    return docs.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), pick(0)).alias("path"), pick(1).alias("text"))


@query
def quoting_rewrites(spark, sf_dir):
    done = detect.clean_text(_cases(spark, sf_dir, QUOTED), Options(clean=True))
    return done.select("doc_id", "clean_text", "changed")


#: (extension, text): a marker that its surroundings need, and the same one where they do not.
CONTEXTS = (
    (".md", "﻿abc"), (".md", "a﻿b"), (".md", "©️"), (".md", "a️"), (".md", "می‌خو"), (".md", "ab‌cd"),
    (".md", "ᠮ᠋"), (".md", "m᠋"), (".md", "日\U000e0100"), (".md", "x\U000e0100"), (".md", "م‍م"), (".md", "a‍b"),
)


@query
def legit_context(spark, sf_dir):
    seen = detect.verdicts(_cases(spark, sf_dir, CONTEXTS), Options())
    return seen.select("doc_id", "column", "codepoint", "verdict")


@query
def json_rows(spark, sf_dir):
    """The JSON report's rows, read back."""
    reports = summary.file_reports(seeded(spark, sf_dir), BASE)
    at = lambda p: F.get_json_object("j", p)
    return sinks.json_rows(reports).select(
        "path", at("$.format").alias("format"), F.json_array_length(at("$.findings")).cast("long").alias("n_findings"), F.json_array_length(at("$.payloads")).cast("long").alias("n_payloads"),
        F.json_array_length(at("$.mixed_script")).cast("long").alias("n_mixed"),
    )


@query
def text_lines(spark, sf_dir):
    """Lines of the plain report, by their first word."""
    lines = sinks.text_rows(summary.file_reports(seeded(spark, sf_dir), BASE)).select("path", F.explode("lines").alias("line"))
    what = F.when(F.startswith("line", F.lit("  !!")), "payload").when(F.contains("line", F.lit("  mixed-script  ")), "mixed").when(F.startswith("line", F.lit("  (")), "inside").otherwise("finding")
    return lines.groupBy("path", what.alias("what")).agg(F.count(F.lit(1)).alias("n"))
