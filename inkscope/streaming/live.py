"""Detection over streams.

The chain keeps no state between rows, so ``findings`` of a streaming DataFrame
is a stateless query in append mode.  What an editor does around it, keeping
only a document's newest version, is a watermark and a keyed maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import findings
from ..options import Options

SIZE_LIMIT = 5_120 * 1024


def stream_findings(stream: DataFrame, options: Options = Options(), largest: int = SIZE_LIMIT) -> DataFrame:
    """Findings of a stream of (path, text, ...); documents beyond the limit are left out."""
    return findings(stream.where(F.octet_length("text") <= largest), options)


def newest_versions(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """The newest (path, version, text) of each path per watermark window of ``ts``."""
    newest = F.max_by(F.struct("version", "text"), F.col("version")).alias("v")
    held = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 second"), "path").agg(newest)
    return held.select("path", "v.version", "v.text")


def write(found: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet, exactly once per micro-batch."""
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
