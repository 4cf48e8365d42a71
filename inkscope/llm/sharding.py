"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are shuffled by a seeded hash of their id and ranked within their source;
the fractional rank ``(rank - 1/2) / rows of the source`` spreads every source
evenly over (0, 1).  All rows sorted by it are cut into equal pieces, so each
shard holds every source in proportion and row counts differ by at most one
(law ``rows``).

No rank is taken over a whole source or table.  The hash and the fraction are
uniform, so their leading part deals rows to buckets of bounded size; counts of the buckets
are summed, and a row's rank is its bucket's offset plus its place there.  A
source that holds a third of all rows is split like any other.

Null texts have no bytes (size 1, crc32 of nothing); null sources are a source
of their own; repeated rows take places of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4_096
SEED = 20_240


def unit_hash(*columns):
    """Uniform double in [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def interleave(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    rows = df.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    held = F.coalesce(F.col(text), F.lit(""))
    dealt = df.select(
        F.col(key).alias("id"),
        (F.octet_length(held) + 1).cast("long").alias("size"),
        F.crc32(held).alias("crc"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        unit_hash(F.lit(seed), F.col(key)).alias("u"),
    ).withColumn("part", F.floor(F.col("u") * buckets).cast("int"))
    of_stratum = Window.partitionBy("stratum")
    offsets = (
        dealt.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(of_stratum.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("total", F.sum("n").over(of_stratum))
        .select("stratum", "part", F.coalesce("before", F.lit(0)).alias("before"), "total")
    )
    place = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("u", "id", "crc", "size"))
    ranked = (
        dealt.withColumn("place", place).join(offsets, ["stratum", "part"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .withColumn("fraction", (F.col("rank") - 0.5) / F.col("total"))
        .select("id", "size", "crc", "stratum", "rank", "fraction", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("int").alias("piece"))
    )
    starts = (
        ranked.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        .select("piece", F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    )
    at = F.row_number().over(Window.partitionBy("piece").orderBy("fraction", "stratum", "rank"))
    position = ranked.withColumn("at", at).join(starts, "piece").withColumn("position", F.col("start") + F.col("at") - 1)
    return position.withColumn("shard", F.expr(f"cast(position * {shards} div {max(rows, 1)} as int)")).select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        (F.col("position") - F.expr(f"(cast(shard as bigint) * {max(rows, 1)} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
