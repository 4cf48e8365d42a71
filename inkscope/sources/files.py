"""Directory trees and single documents as DataFrames."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ignore import Pattern, ignored, name_matches
from ..tables import IGNORED_DIRS
from .codec import decoded, image_format, maybe_container, scannable


def scan_tree(
    spark: SparkSession, root: str, patterns: list[str] | None = None, ignore: list[Pattern] | None = None,
    ignore_dirs: tuple[str, ...] = (), default_ignores: bool = True, recursive: bool = True, largest: int | None = None,
) -> DataFrame:
    """(path, content) of the files a scan of ``root`` keeps; paths relative to it.

    Names and sizes are filtered before any content is looked at.  Spark's file
    source leaves out empty files, which hold nothing to find.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
    prefix = base if "://" in base or base.startswith("file:") else f"file:{base}"
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^\\Q" + prefix + "\\E/", "")
    dirs = (tuple(IGNORED_DIRS) if default_ignores else ()) + tuple(ignore_dirs)
    kept = raw.withColumn("path", rel).where(~ignored(F.col("path"), ignore or [], dirs) & name_matches(F.col("path"), patterns or []))
    if largest is not None:
        kept = kept.where(F.col("length") <= largest)
    return kept.select("path", "content").where(scannable(F.col("content")))


def text_documents(files: DataFrame) -> DataFrame:
    """(path, text, encoding, had_bom, error) of the files that are text."""
    return decoded(files.where(image_format(F.col("content")).isNull() & ~maybe_container(F.col("content")))).drop("content")


def single(spark: SparkSession, data: bytes, name: str = "") -> DataFrame:
    """A document handed over as bytes, as a one-row scan."""
    return spark.createDataFrame([(name, bytearray(data))], "path string, content binary")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, codepoint) of a baseline file of version 1."""
    whole = spark.read.schema("version int, entries array<struct<id:string,path:string,codepoint:string>>").option("multiLine", "true").json(path)
    checked = whole.withColumn("__ok", F.when(F.col("version") == 1, 1).otherwise(F.raise_error(F.lit("unsupported baseline version"))))
    return checked.where("__ok = 1").select(F.inline("entries"))
