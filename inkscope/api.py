"""Library entry points: text, bytes, and functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.detect import clean_text, findings, reported_payloads, reported_words, verdicts
from .operators.summary import actionable, exit_code, file_reports, summary
from .options import FormatPolicy, Options
from .sources.codec import binary_test, decoded, encode_text, image_format, maybe_container

__all__ = [
    "FormatPolicy", "Options", "actionable", "clean_text", "exit_code", "file_reports", "findings", "register", "reported_payloads",
    "reported_words", "scan_bytes", "scan_text", "summary", "verdicts",
]


def scan_text(df: DataFrame, options: Options = Options(), text: str = "text", path: str = "path") -> DataFrame:
    """File reports of a table of texts; a missing name means source code."""
    return file_reports(df, options, text, path)


def scan_bytes(df: DataFrame, options: Options = Options(), content: str = "content", path: str = "path") -> DataFrame:
    """``df`` with ``cleaned`` bytes, ``changed`` and ``error``.

    Images, documents and other binary content are errors; text comes back in its
    own encoding, and byte for byte if nothing changed.
    """
    c = F.col(content)
    reason = F.when(image_format(c).isNotNull() | maybe_container(c) | binary_test(c), "not text")
    seen = decoded(df, content).withColumn("error", F.coalesce(reason, F.nullif(F.col("error"), F.lit(""))))
    seen = seen.withColumn("__text", F.when(F.col("error").isNull(), F.col("text")).otherwise("")).drop("text")
    done = clean_text(seen, Options(**{**options.__dict__, "clean": True}), path, "__text", path)
    # not deterministic to the optimizer: else a later filter moves it into the join
    coded = encode_text.asNondeterministic()(F.col("clean_text"), F.col("encoding"), F.col("had_bom"))
    out = done.withColumn("__bytes", F.when(F.col("changed"), coded))
    lost = F.when(F.col("changed") & F.col("__bytes").isNull(), F.concat(F.lit("cannot encode as "), "encoding"))
    return out.withColumn("cleaned", F.coalesce("__bytes", c)).withColumn("error", F.coalesce("error", lost)).drop("__text", "clean_text", "__bytes")


def register(spark: SparkSession) -> None:
    """Make the generator test and the byte classifier callable from SQL."""
    from .binary.provenance import generator

    spark.udf.register("generator_name", generator, "string")
    spark.udf.register("is_binary", binary_test)
