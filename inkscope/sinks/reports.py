"""Reports as JSON, SARIF and text.

Rows are built as DataFrames; a driver-side writer only adds the envelope and
reads them in order through ``toLocalIterator``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.identity import with_identity

#: Fixed values of the interchange format.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
SARIF_LIMIT = 25_000
PREFIX = "inkscope"


def quoted(text: Column) -> Column:
    """A string in double quotes, control and non-printing characters escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def sarif_results(findings: DataFrame, payloads: DataFrame, words: DataFrame, path: str = "path") -> DataFrame:
    """One row a result: rule, level, message, region (end exclusive), identity.

    Order within a file: findings, payloads by scheme, mixed words.
    """
    p = F.col(path).alias("path")
    change = (
        F.when(F.col("actionable") & (F.col("replacement") == ""), "removed by cleaning")
        .when(F.col("actionable"), F.concat(F.lit("replaced with "), quoted(F.col("replacement")), F.lit(" by cleaning")))
        .otherwise("reported only, not changed by cleaning")
    )
    scheme = F.when(F.col("scheme") == "tag-ascii", 1).when(F.col("scheme") == "variation-selector", 2).otherwise(3)
    shown = F.when(F.col("printable"), F.col("decoded")).otherwise("not printable text")
    place = ["line", "column"]
    found = findings.where("not in_payload").select(
        p, F.col("codepoint").alias("key"), F.lit(0).alias("rank"), F.col("offset").cast("long").alias("ord"), *place,
        F.concat(F.lit(PREFIX + "/"), "codepoint").alias("rule_id"), F.when(F.col("actionable"), "warning").otherwise("note").alias("level"),
        F.concat(F.col("name"), F.lit(" ("), F.col("codepoint"), F.lit("), "), change).alias("message"), F.lit(1).alias("width"),
    )
    pay = payloads.select(
        p, F.lit("payload").alias("key"), scheme.alias("rank"), F.col("start").cast("long").alias("ord"), *place,
        F.lit(PREFIX + "/payload").alias("rule_id"), F.lit("error").alias("level"),
        F.concat(F.lit("Hidden payload decoding to "), quoted(shown), F.lit(", "), "scheme", F.lit(" scheme")).alias("message"), F.col("runes").alias("width"),
    )
    mixed = words.select(
        p, F.concat(F.lit("mixed:"), "word").alias("key"), F.lit(4).alias("rank"), F.col("start").cast("long").alias("ord"), *place,
        F.lit(PREFIX + "/mixed-script").alias("rule_id"), F.lit("warning").alias("level"),
        F.concat(F.lit("Mixed-script word "), quoted(F.col("word")), F.lit(", scripts: "), F.array_join("scripts", ", ")).alias("message"), F.length("word").alias("width"),
    )
    rows = with_identity(found.unionByName(pay).unionByName(mixed))
    return rows.select(
        "path", "rank", "ord", "rule_id", "level", "message", F.col("line").alias("start_line"), F.col("column").alias("start_column"),
        F.col("line").alias("end_line"), (F.col("column") + F.col("width")).alias("end_column"), F.col("id").alias("identity"),
    )


def sarif(results: DataFrame, rules: DataFrame, version: str = "1", limit: int = SARIF_LIMIT) -> tuple[str, int]:
    """(document, results left out): the first ``limit`` results by path and order."""
    total = results.count()
    rows = results.orderBy("path", "rank", "ord").limit(limit).toLocalIterator()
    listed = [
        {
            "ruleId": r.rule_id, "level": r.level, "message": {"text": r.message},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.path}, "region": {"startLine": r.start_line, "startColumn": r.start_column, "endLine": r.end_line, "endColumn": r.end_column}}}],
            "partialFingerprints": {f"{PREFIX}Identity/v1": r.identity},
        }
        for r in rows
    ]
    known = [{"id": r.rule_id, "name": r.name, "shortDescription": {"text": r.short}} for r in rules.orderBy("rule_id").toLocalIterator()]
    driver = {"name": PREFIX, "version": version, "rules": known}
    log = {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": listed}]}
    return json.dumps(log, indent=2, ensure_ascii=False), max(0, total - limit)


def sarif_rules(findings: DataFrame, results: DataFrame) -> DataFrame:
    """(rule_id, name, short): a rule for each code point found, and the two fixed ones if used."""
    chars = findings.where("not in_payload").select(
        F.concat(F.lit(PREFIX + "/"), "codepoint").alias("rule_id"), "name", F.concat("name", F.lit(" ("), "codepoint", F.lit(")")).alias("short")
    )
    fixed = results.where(F.col("rule_id").isin(PREFIX + "/payload", PREFIX + "/mixed-script")).select(
        "rule_id",
        F.when(F.endswith("rule_id", F.lit("payload")), "Hidden payload").otherwise("Mixed-script word").alias("name"),
        F.when(F.endswith("rule_id", F.lit("payload")), "A run of invisible characters encoding data").otherwise("A word mixing letters from more than one script").alias("short"),
    )
    return chars.unionByName(fixed).dropDuplicates(["rule_id"])


def json_rows(reports: DataFrame) -> DataFrame:
    """(path, j): each report as JSON."""
    return reports.select("path", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))


def json_report(reports: DataFrame, total: DataFrame) -> Iterator[str]:
    """The lines of a JSON report: version, files, summary."""
    yield '{"version": 1, "files": ['
    before = ""
    for row in json_rows(reports).orderBy("path").toLocalIterator():
        yield before + row.j
        before = ","
    yield '], "summary": ' + total.select(F.to_json(F.struct("*"))).first()[0] + "}"


def text_rows(reports: DataFrame) -> DataFrame:
    """(path, lines): what a plain report says of each file that has anything to report.

    Payloads, declared generators, metadata, mixed words, findings; those inside a
    payload are counted only.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def payload(p):
        what = F.when(p["printable"], text("decodes to ", quoted(p["text"]), " across ", p["runes"], " characters"))
        return text("  !! hidden payload (", p["scheme"], ") ", what.otherwise(text("of ", p["runes"], " characters, not printable text")))

    def record(m):
        marker = F.when(m["kind"] == "c2pa", "provenance").otherwise("metadata")
        label = F.when(m["label"] == "", m["kind"]).otherwise(F.concat_ws(" ", m["kind"], m["label"]))
        value = F.when(m["value"] == "", "").otherwise(text(" = ", quoted(m["value"])))
        return text("  ", marker, "  ", label, value, F.when(m["bytes"] > 0, text(" (", m["bytes"], " bytes)")).otherwise(""))

    def finding(f):
        arrow = F.when(f["applied"] & (f["replacement"] != ""), text(" -> ", quoted(f["replacement"]))).otherwise("")
        return text("  ", f["line"], ":", f["column"], "  ", f["action"], "  ", f["codepoint"], " ", f["name"], arrow, " (", f["kind"], ")")

    word = lambda w: text("  ", w["line"], ":", w["column"], "  mixed-script  ", quoted(w["word"]), " mixes ", F.array_join(w["scripts"], " and "))
    parts = [F.transform("payloads", payload)]
    if "metadata" in reports.columns:
        declared = F.filter("provenance", lambda s: s["ai"])
        parts += [F.transform(declared, lambda s: text("  ai-declared  ", s["source"], " names ", quoted(s["detail"]))), F.transform("metadata", record)]
    inside = F.size(F.filter("findings", lambda f: f["in_payload"]))
    parts += [F.transform("mixed_script", word), F.transform(F.filter("findings", lambda f: ~f["in_payload"]), finding)]
    parts.append(F.when(inside > 0, F.array(text("  (", inside, " character(s) in the payload above)"))).otherwise(F.array().cast("array<string>")))
    return reports.select("path", F.concat(*parts).alias("lines")).where(F.size("lines") > 0)


def text_report(reports: DataFrame, total: DataFrame, baselined: int = 0) -> Iterator[str]:
    """The lines of a plain report; clean files are left out."""
    for r in text_rows(reports).orderBy("path").toLocalIterator():
        yield ""
        yield r.path
        yield from r.lines
    s = total.first().asDict()
    records = s.get("metadata_records", 0)
    if not (s["markers_detected"] or s["mixed_script_words"] or records):
        more = [(s["suppressed"], "suppressed"), (baselined, "baselined")]
        yield ", ".join([f"clean: {s['files_scanned']} file(s) scanned", *(f"{n} {what}" for n, what in more if n)])
        return
    more = [
        (records, "metadata record(s)"), (s["mixed_script_words"], "mixed-script word(s)"), (s["payloads_decoded"], "decoded payload(s)"),
        (s["markers_applied"], "fixed"), (s["suppressed"], "suppressed"), (baselined, "baselined"),
    ]
    yield ""
    yield ", ".join([f"found: {s['markers_detected']} marker(s) in {s['files_with_markers']} of {s['files_scanned']} file(s)", *(f"{n} {what}" for n, what in more if n)])


def write_baseline(entries: DataFrame, path: str) -> None:
    """A baseline of version 1: one JSON object; an empty one has an empty list."""
    whole = entries.agg(F.array_sort(F.collect_list(F.struct("path", "id", "codepoint"))).alias("e"))
    ordered = F.transform("e", lambda x: F.struct(x["id"].alias("id"), x["path"].alias("path"), x["codepoint"].alias("codepoint")))
    whole.select(F.lit(1).alias("version"), ordered.alias("entries")).coalesce(1).write.mode("overwrite").json(path)


def utf16_columns(found: DataFrame, content: str = "content", column: str = "column") -> DataFrame:
    """``found`` with its 0-based column counted in UTF-16 units, as editors do."""
    before = F.expr(f"substring({content}, 1, {column} - 1)")
    return found.withColumn("utf16_column", (F.length(before) + F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long"))
