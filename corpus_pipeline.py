"""Training-corpus pipeline: each stage works on all that its predecessor kept.

language ID -> line dedup -> SimHash near-dedup -> mixing -> BPE.  A stage takes
(spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscope.llm import bpe, langid, linededup, mixing, neardup
from inkscope.llm.common import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words per shingle of the near-duplicate stage.
SHINGLE = 5
#: A source is no web host: on the tables its commonest line is on 13% of its documents.
SOURCE_RATIO = 0.01
#: Nor is a line on fewer documents judged: a few copies within a small source are no boilerplate.
SOURCE_LEAST = 5
#: Below this posterior a language is not accepted.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language cannot be told (null, no letters, or unsure).

    The model learns from the labelled documents of the input itself; the label
    of a document plays no part in its own fate beyond that.
    """
    model = langid.fit(docs)
    found = langid.predict(docs, model, keep=COLUMNS[1:])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines on over a hundredth, and five or more, of a source's documents; ``n_chars`` follows the text."""
    kept = linededup.drop_boilerplate(docs, F.col("source"), key="doc_id", ratio=SOURCE_RATIO, least=SOURCE_LEAST)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies over 5-word shingles.

    Links are pairs at a Jaccard similarity of 0.8 or more (``neardup``).  Of equal
    rows one stays; different texts of one id are documents of their own;
    documents without an id stay.
    """
    known = docs.where("doc_id is not null")
    found = neardup.survivors(known, SHINGLE)
    single = known.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])  # first: the join then finds its rows in place
    return single.join(found, ["doc_id", "h"], "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until sources stand in their target weights.

    A document that the mix takes in part is there as a whole; one taken for more
    than its size is there twice; one without words costs no budget and stays.  A row is known by all its columns, null or not:
    documents without an id and texts that share one each follow their own plan,
    equal rows come as often as their plans say together.
    """
    docs = docs.withColumn("row", F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plan = mixing.mix(docs, labels, keep=("row",))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size")))
    times = plan.groupBy("row").agg(F.sum(copies).cast("int").alias("times")).where("times > 0")
    single = docs.dropDuplicates(["row"])  # first: the join then finds its rows in place
    copies = single.join(times, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*COLUMNS)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding them gives the words back."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokenization),
]

#: Language models, fingerprints and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage outputs go to the shared folder."""
    base = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
