"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, linededup, mixing, pii, sharding, simhash, substrings, webp
from .common import table, written


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.host_of().alias("host"), linededup.visible_lines().alias("text"))
    return linededup.drop_boilerplate(written(pages), F.col("host")).select(
        "page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_simhash, op3_langid, op4_substrings, op5_line_dedup, op6_mixing, op7_ann, op8_bpe, op9_sharding, op10_webp)
}

_BREAK = linededup.BREAK.replace("'", "''")
_OP5 = f"""
WITH cut AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{_BREAK}'), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
each AS (SELECT page_id, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM cut),
totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
bad AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT page_id) AS n FROM each GROUP BY host, line) JOIN totals USING (host)
  WHERE n >= {linededup.REPEATS} AND n > {linededup.RATIO} * pages),
judged AS (SELECT e.*, b.line IS NOT NULL AS gone FROM each e LEFT JOIN bad b ON b.host = e.host AND b.line = e.line),
sums AS (
  SELECT page_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept
  FROM judged GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_dropped, 0) AS n_dropped,
  length(coalesce(s.kept, '')) AS kept_chars, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM cut c LEFT JOIN sums s USING (page_id)
"""

_GOOD, _NONE, _POOR = mixing.QUALITY
_OP6 = f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
      / (CASE WHEN b.q >= 1 THEN {_GOOD} WHEN b.q < 1 THEN {_POOR} ELSE {_NONE} END) AS draw
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w, source_size * 2 AS cap
  FROM sizes),
levels AS (
  SELECT *, cap / w AS fill,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed),
goals AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), coalesce(w * (SELECT arg_min(rate, fill) FROM levels WHERE fill > rate), CAST(cap AS DOUBLE))) AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM docs)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(p.epochs * d.size + greatest(0, least(d.size, CAST(round(p.target - p.epochs * p.source_size) AS BIGINT) - d.ahead)) AS BIGINT) AS taken
FROM placed d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source
"""

#: SQL where SQL can express the method; the others are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {"op5_line_dedup": _OP5, "op6_mixing": _OP6}
