"""A whole scan: text, images and documents in one table of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..binary.document import document_reports
from ..binary.media import media_reports, svg_records
from ..binary.provenance import confidence, signals
from ..operators import summary as sums
from ..options import Options
from ..sources.codec import decoded, image_format, maybe_container

_RECORD = "array<struct<kind:string,label:string,value:string,bytes:int>>"
_SIGNAL = "array<struct<source:string,detail:string,ai:boolean>>"


def scan_files(files: DataFrame, options: Options = Options()) -> DataFrame:
    """One report a file of (path, content): what was found in it, or its error.

    Text is decoded and judged; SVG, images and documents add metadata records,
    signals and a confidence; the text of a document is judged as text of its path.
    """
    c = F.col("content")
    image = image_format(c).isNotNull()
    texts = decoded(files.where(~image & ~maybe_container(c))).drop("content")
    good = texts.where("error = ''")
    bad = texts.where("error <> ''").select("path", "encoding", "error")
    judged = sums.file_reports(good, options).join(
        good.select("path", "encoding", svg_records(F.col("text")).alias("metadata")), "path"
    )
    media = media_reports(files).select("path", "format", F.lit("binary").alias("encoding"), F.col("metadata").cast(_RECORD).alias("metadata"))
    containers = document_reports(files.where(~image))
    inner = sums.file_reports(containers.select("path", "text"), options).drop("format")
    documents = containers.select("path", "format", F.lit("container").alias("encoding"), F.col("metadata").cast(_RECORD).alias("metadata")).join(inner, "path")
    out = judged.unionByName(documents, True).unionByName(media, True).unionByName(bad, True)
    empty = lambda name: F.coalesce(name, F.array())
    out = out.withColumn("provenance", signals(F.coalesce("metadata", F.array().cast(_RECORD))).cast(_SIGNAL))
    return out.select(
        "path", F.coalesce("format", F.lit("source")).alias("format"), "encoding", empty("findings").alias("findings"), empty("payloads").alias("payloads"),
        empty("mixed_script").alias("mixed_script"), F.coalesce("metadata", F.array().cast(_RECORD)).alias("metadata"), "provenance",
        confidence(F.col("provenance")).alias("confidence"), F.coalesce("suppressed", F.lit(0)).alias("suppressed"), F.coalesce("error", F.lit("")).alias("error"),
    )


def scan_summary(reports: DataFrame) -> DataFrame:
    """Sums over whole reports; a file with metadata counts as marked."""
    marked = F.count_if((F.size("findings") > 0) | (F.size("metadata") > 0)).alias("files_with_markers")
    records = F.coalesce(F.sum(F.size("metadata")), F.lit(0)).alias("metadata_records")
    return reports.agg(*sums.totals(marked), records, F.count_if(F.col("error") != "").alias("errors"))
