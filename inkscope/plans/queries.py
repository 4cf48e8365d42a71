"""Registered queries of the marker engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..binary import document, media, provenance
from ..functions import text as T
from ..operators import detect, identity, ignore, lines, payloads, summary, words
from ..options import FormatPolicy, Options
from ..sinks import problems as editor
from ..sinks import reports as sinks
from ..sources import codec
from ..tables import SCRIPT_PUNCTUATION
from .seeding import DIRECTIVE, seeded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BASE = Options(directive=DIRECTIVE)
CLEAN = Options(directive=DIRECTIVE, clean=True)
EXCLUDED = frozenset({0x200B, 0x2014})


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- lookup and policy ------------------------------------------------------------------


@query
def marker_positions(spark, sf_dir):
    found = lines.lookup(seeded(spark, sf_dir), BASE)
    return found.select("doc_id", "line", "column", "offset", "codepoint", "name", "kind")


@query
def marker_summary_by_kind(spark, sf_dir):
    found = lines.lookup(seeded(spark, sf_dir), BASE)
    return found.groupBy("kind", "codepoint").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query
def marker_dimension(spark, sf_dir):
    return lines.marker_dimension(spark, BASE).select("code", "codepoint", "name", "kind", "replacement", "can_clean")


@query
def format_classify(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("docs/License"), F.lit(""))).when(F.col("doc_id") % 7 == 1, "a.b/.env").when(F.col("doc_id") % 7 == 2, "x/Page.HTML").otherwise(F.col("path"))
    return docs.select("doc_id", path.alias("path")).withColumn("format", T.format_of(F.col("path")))


@query
def policy_filter(spark, sf_dir):
    seen = detect.verdicts(seeded(spark, sf_dir), BASE)
    return seen.where("verdict = 'ignored'").groupBy("format", "codepoint").agg(F.count(F.lit(1)).alias("n"))


@query
def policy_configured(spark, sf_dir):
    options = Options(directive=DIRECTIVE, formats={"prose": FormatPolicy(typographic="report"), "source": FormatPolicy(hidden="ignore")})
    seen = detect.verdicts(seeded(spark, sf_dir), options)
    return seen.groupBy("format", "kind", "verdict", "actionable").agg(F.count(F.lit(1)).alias("n"))


@query
def exclude_chars(spark, sf_dir):
    found = lines.lookup(seeded(spark, sf_dir), Options(directive=DIRECTIVE, excluded=EXCLUDED))
    return found.groupBy("codepoint").agg(F.count(F.lit(1)).alias("n"))


@query
def codepoint_labels(spark, sf_dir):
    found = lines.marker_positions(seeded(spark, sf_dir), BASE)
    return found.select(T.codepoint_label(F.col("ch")).alias("codepoint")).distinct()


# -- payloads -----------------------------------------------------------------------------


def _payloads(spark, sf_dir, scheme):
    found = payloads.payloads(seeded(spark, sf_dir)).where(F.col("scheme") == scheme)
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    return found.select("doc_id", start.alias("start_at"), end.alias("end_at"), F.lower(F.hex("bytes")).alias("bytes_hex"), "decoded", "printable", F.col("line").cast("long").alias("line"))


@query
def payload_tag(spark, sf_dir):
    return _payloads(spark, sf_dir, "tag-ascii")


@query
def payload_variation(spark, sf_dir):
    return _payloads(spark, sf_dir, "variation-selector")


@query
def payload_zero_width(spark, sf_dir):
    return _payloads(spark, sf_dir, "zero-width-binary")


@query
def payload_membership(spark, sf_dir):
    seen = detect.verdicts(seeded(spark, sf_dir), BASE)
    return seen.where("in_payload").select("doc_id", "offset", "codepoint")


# -- words, scripts, censuses ---------------------------------------------------------------


@query
def mixed_words(spark, sf_dir):
    found = words.mixed_words(seeded(spark, sf_dir))
    return found.select("doc_id", "line", "column", "word", F.array_join("scripts", ",").alias("scripts"), F.array_join("minority", ",").alias("minority"))


@query
def script_of_marker(spark, sf_dir):
    found = lines.marker_positions(seeded(spark, sf_dir), BASE).select("ch").distinct()
    return found.select(F.ascii("ch").alias("code"), T.script_of(F.col("ch")).alias("script"))


@query
def script_census(spark, sf_dir):
    t = F.col("text")
    counts = [T.group_letters(t, g).cast("long").alias(g) for g in T.GROUPS]
    return seeded(spark, sf_dir).select("doc_id", T.letters(t).cast("long").alias("letters"), *counts)


@query
def native_script(spark, sf_dir):
    t = F.col("text")
    return seeded(spark, sf_dir).select("doc_id", *[T.native(t, g).alias(g) for g in T.GROUPS])


@query
def typography_census(spark, sf_dir):
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    return seeded(spark, sf_dir).select(
        "doc_id", n("['\"]").alias("straight_quotes"), n(T.CURLY).alias("curly_quotes"), n("-").alias("hyphens"), n(T.DASH).alias("dashes"),
        T.lines_with(t, T.CURLY).cast("long").alias("curly_lines"), T.lines_with(t, T.DASH).cast("long").alias("dash_lines"),
    )


def _typeset(spark, sf_dir):
    """Documents with every ', ' turned into a dash, so that dashes can be a habit."""
    dash = "\u2014"
    return seeded(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(", "), F.lit(dash))).otherwise(F.col("text")))


@query
def typography_established(spark, sf_dir):
    t = F.col("text")
    return _typeset(spark, sf_dir).select("doc_id", F.coalesce(T.curly_established(t), F.lit(False)).alias("curly"), F.coalesce(T.dash_established(t), F.lit(False)).alias("dash"))


@query
def typography_findings(spark, sf_dir):
    seen = detect.verdicts(_typeset(spark, sf_dir), BASE).where("codepoint = 'U+2014'")
    return seen.groupBy("format", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def fence_regions(spark, sf_dir):
    found = seeded(spark, sf_dir).where(T.format_of(F.col("path")).isin("prose", "notebook")).select("doc_id", F.explode(T.code_lines(F.col("text"))).alias("line"))
    return found.select("doc_id", F.col("line").cast("long").alias("line"))


@query
def suppressed_lines(spark, sf_dir):
    s = T.suppression(F.col("text"), DIRECTIVE)
    held = seeded(spark, sf_dir).where(F.contains("text", F.lit(DIRECTIVE))).withColumn("s", s)
    found = held.select("doc_id", F.col("s.whole_file").alias("whole_file"), F.explode_outer("s.lines").alias("line"))
    return found.withColumn("line", F.col("line").cast("long"))


# -- context --------------------------------------------------------------------------------


def _context(spark, sf_dir, codes):
    seen = detect.verdicts(seeded(spark, sf_dir), BASE).where(F.ascii("ch").isin(*codes))
    return seen.select("doc_id", "line", "column", "codepoint", (F.col("verdict") == "context").alias("legitimate"))


@query
def legit_emoji_joiner(spark, sf_dir):
    return _context(spark, sf_dir, [0x200D])


@query
def legit_flag_tags(spark, sf_dir):
    return _context(spark, sf_dir, list(range(0xE0000, 0xE0080)))


@query
def legit_variation(spark, sf_dir):
    return _context(spark, sf_dir, [*range(0xFE00, 0xFE10)])


@query
def legit_script_punct(spark, sf_dir):
    return _context(spark, sf_dir, list(SCRIPT_PUNCTUATION))


@query
def legit_isolate(spark, sf_dir):
    return _context(spark, sf_dir, list(range(0x2066, 0x206A)))


# -- the chain and what follows ---------------------------------------------------------------


@query
def verdict_chain(spark, sf_dir):
    seen = detect.verdicts(seeded(spark, sf_dir), BASE)
    return seen.select("doc_id", "line", "column", "codepoint", "verdict", "in_payload", "actionable", "replacement")


@query
def verdict_chain_strict(spark, sf_dir):
    seen = detect.verdicts(seeded(spark, sf_dir), Options(directive=DIRECTIVE, strict=True))
    return seen.groupBy("codepoint", "verdict", "actionable").agg(F.count(F.lit(1)).alias("n"))


@query
def verdict_counters(spark, sf_dir):
    seen = detect.verdicts(seeded(spark, sf_dir), BASE)
    return seen.groupBy("format", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def homoglyph_fixes(spark, sf_dir):
    options = Options(directive=DIRECTIVE, clean=True, fix_homoglyphs=True)
    seen = detect.findings(seeded(spark, sf_dir), options).where("kind = 'typographic'")
    return seen.groupBy("codepoint", "replacement", "action").agg(F.count(F.lit(1)).alias("n"))


@query
def clean_text(spark, sf_dir):
    done = detect.clean_text(seeded(spark, sf_dir), CLEAN)
    return done.select("doc_id", "changed", F.sha2("clean_text", 256).alias("clean_sha256"))


@query
def detect_only_text(spark, sf_dir):
    """Detection alone must leave the plan without any rewriting."""
    return detect.findings(seeded(spark, sf_dir), BASE).groupBy("action", "applied").agg(F.count(F.lit(1)).alias("n"))


def _items(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    pay = detect.reported_payloads(docs, BASE).where("not suppressed")
    mixed = detect.reported_words(docs, BASE).where("not suppressed")
    return identity.with_identity(identity.items(detect.findings(docs, BASE), pay, mixed))


@query
def occurrence_identity(spark, sf_dir):
    return _items(spark, sf_dir).select("path", "key", "occurrence", "id")


def _baseline(items):
    """A third of the items as accepted, and one entry that nothing matches."""
    held = identity.baseline_entries(items.where("path like '%1.%' or path like '%4.%'"))
    gone = items.sparkSession.createDataFrame([("0" * 16, "gone.md", "U+200B")], held.schema)
    return held.unionByName(gone)


@query
def baseline_new(spark, sf_dir):
    items = _items(spark, sf_dir)
    return identity.new_items(items, _baseline(items)).select("path", "key", "id")


@query
def baseline_accepted(spark, sf_dir):
    items = _items(spark, sf_dir)
    return identity.accepted_items(items, _baseline(items)).select("path", "key", "id")


@query
def baseline_stale(spark, sf_dir):
    items = _items(spark, sf_dir)
    return identity.stale_entries(items, _baseline(items)).select("id", "path", "codepoint")


@query
def baseline_entries(spark, sf_dir):
    return identity.baseline_entries(_items(spark, sf_dir))


def _reports(spark, sf_dir, options=BASE):
    return summary.file_reports(seeded(spark, sf_dir), options)


@query
def file_reports(spark, sf_dir):
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return _reports(spark, sf_dir).select("path", "format", size("findings"), size("payloads"), size("mixed_script"), "suppressed", "legitimate")


@query
def file_summary(spark, sf_dir):
    return summary.summary(_reports(spark, sf_dir))


@query
def exit_code(spark, sf_dir):
    return summary.exit_code(summary.summary(_reports(spark, sf_dir)))


@query
def file_actionable(spark, sf_dir):
    return summary.actionable(_reports(spark, sf_dir)).groupBy("actionable").agg(F.count(F.lit(1)).alias("n"))


@query
def findings_rollup(spark, sf_dir):
    found = detect.findings(seeded(spark, sf_dir), BASE)
    rolled = summary.by_dimension(found, "format", "kind")
    return rolled.select(F.coalesce("format", F.lit("*")).alias("format"), F.coalesce("kind", F.lit("*")).alias("kind"), "n")


@query
def sarif_results(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    pay = detect.reported_payloads(docs, BASE).where("not suppressed")
    mixed = detect.reported_words(docs, BASE).where("not suppressed")
    found = sinks.sarif_results(detect.findings(docs, BASE), pay, mixed)
    first = found.orderBy("path", "rank", "ord").limit(sinks.SARIF_LIMIT)
    return first.select("path", "rule_id", "level", "start_line", "start_column", "end_column", "identity")


@query
def sarif_rules(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    found = detect.findings(docs, BASE)
    pay = detect.reported_payloads(docs, BASE).where("not suppressed")
    mixed = detect.reported_words(docs, BASE).where("not suppressed")
    return sinks.sarif_rules(found, sinks.sarif_results(found, pay, mixed)).select("rule_id", "name")


@query
def utf16_columns(spark, sf_dir):
    pattern = lines.marker_class(BASE)
    held = lines.with_lines(seeded(spark, sf_dir).select("doc_id", "text"), "text", pattern)
    each = F.filter(F.transform(T.chars(F.col("content")), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("column"))), lambda x: x["c"].rlike(pattern))
    found = held.select("doc_id", "line", "content", F.explode(each).alias("o")).select("doc_id", "line", "content", "o.column")
    return sinks.utf16_columns(found).select("doc_id", "line", "column", "utf16_column")


# -- scans, configuration ----------------------------------------------------------------------


def _tree(spark, sf_dir):
    """Documents as files of a small tree."""
    folders = F.array(*map(F.lit, ["src", "docs/build", "node_modules/x", "docs", "a/tmp/b"]))
    docs = seeded(spark, sf_dir).select("doc_id", "path")
    return docs.withColumn("path", F.concat_ws("/", F.element_at(folders, (F.pmod(F.floor(F.col("doc_id") / 5), F.lit(5)) + 1).cast("int")), "path"))


IGNORE_FILE = "# built\nbuild/\n*.log\n!d1*.log\n/src/d2*.py\ntmp\n"


@query
def ignore_match(spark, sf_dir):
    patterns = ignore.parse_lines(IGNORE_FILE)
    return _tree(spark, sf_dir).select("doc_id", ignore.ignored(F.col("path"), patterns).alias("ignored"))


@query
def glob_filter(spark, sf_dir):
    return _tree(spark, sf_dir).where(ignore.name_matches(F.col("path"), ["*.m[a-e]", "d?.py"])).select("doc_id", "path")


CONFIG = """{"formats": {"prose": {"typographic": "report"}}, "overrides": [
 {"files": ["docs/**"], "formats": {"prose": {"hidden": "ignore"}}},
 {"files": ["*.py", "src/d3*"], "mixedScript": "ignore"}]}"""


@query
def config_override(spark, sf_dir):
    config = ignore.Config.load(CONFIG)
    p = F.col("path")
    none = F.lit("-")
    return _tree(spark, sf_dir).select(
        "doc_id", F.coalesce(config.setting(p, "prose", "hidden"), none).alias("hidden"),
        F.coalesce(config.setting(p, "prose", "typographic"), none).alias("typographic"), config.mixed_action(p).alias("mixed"),
    )


# -- bytes --------------------------------------------------------------------------------------


def _encoded(spark, sf_dir):
    """Documents as bytes in five encodings, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    k = F.col("doc_id") % 5
    mark = lambda h: F.unhex(F.lit(h))
    latin = F.encode(F.concat("t", F.lit("é")), "ISO-8859-1")
    content = (
        F.when(k == 0, F.encode("t", "UTF-8"))
        .when(k == 1, F.concat(mark("EFBBBF"), F.encode("t", "UTF-8")))
        .when(k == 2, F.concat(mark("FFFE"), F.encode("t", "UTF-16LE")))
        .when(k == 3, F.concat(mark("FEFF"), F.encode("t", "UTF-16BE")))
        .otherwise(latin)
    )
    return docs.select("doc_id", content.alias("content"))


@query
def decode_bytes(spark, sf_dir):
    seen = codec.decoded(_encoded(spark, sf_dir))
    return seen.select("doc_id", "encoding", "had_bom", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query
def encode_round_trip(spark, sf_dir):
    seen = codec.decoded(_encoded(spark, sf_dir))
    back = codec.encode_text(F.col("text"), F.col("encoding"), F.col("had_bom"))
    return seen.withColumn("same", back == F.col("content")).groupBy("encoding", "same").agg(F.count(F.lit(1)).alias("n"))


@query
def binary_sniff(spark, sf_dir):
    docs = _encoded(spark, sf_dir)
    zero = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.unhex(F.lit("00")))).otherwise(F.col("content"))
    return docs.select("doc_id", codec.binary_test(zero).alias("is_binary"))


@query
def container_sniff(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    heads = ["89504E470D0A1A0A00", "FFD8FFE0", "524946460000000057454250", "49492A0008000000", "474946383961", "255044462D312E34", "504B030414", "41"]
    content = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int")))
    return docs.select("doc_id", F.coalesce(codec.image_format(content), F.lit("")).alias("image"), codec.maybe_container(content).alias("container"))


TOOLS = ("Claude 3", "GIMP 2.10", "Midjourney v6", "ChatGPT-4o", "Microsoft Word", "Adobe Firefly 2", "Kimi", "SD XL", "x.ai", "Wanda", "wan 2")


def _tools(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("doc_id") % len(TOOLS) + 1).cast("int"))
    return docs.select("doc_id", F.concat_ws(" ", F.coalesce("source", F.lit("")), tool).alias("value"))


@query
def generator_match(spark, sf_dir):
    return _tools(spark, sf_dir).select("doc_id", F.coalesce(provenance.generator_of(F.col("value")), F.lit("")).alias("generator"))


def _pdf(spark, sf_dir):
    made = F.concat(F.lit("%PDF-1.4\n/Producer ("), "value", F.lit(")\n/Title (t)\n/Producer ("), "value", F.lit(")\n"))
    return _tools(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode(made, "UTF-8").alias("content"))


@query
def pdf_info(spark, sf_dir):
    seen = document.document_reports(_pdf(spark, sf_dir))
    return seen.select(F.col("path").cast("long").alias("doc_id"), F.explode("metadata").alias("m")).select("doc_id", "m.kind", "m.label", "m.value")


@query
def provenance_signals(spark, sf_dir):
    seen = document.document_reports(_pdf(spark, sf_dir))
    return seen.select(F.col("path").cast("long").alias("doc_id"), F.size("provenance").cast("long").alias("n_signals"), "confidence")


def _chunk(name, body):
    size = F.lpad(F.hex(F.octet_length(body)), 8, "0")
    return F.concat(F.unhex(size), F.encode(F.lit(name), "UTF-8"), body, F.unhex(F.lit("00000000")))


def _png(spark, sf_dir):
    text = F.encode(F.concat(F.lit("Software"), F.lit("\0"), F.col("value")), "UTF-8")
    made = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), _chunk("tEXt", text), _chunk("IDAT", F.encode(F.lit("xx"), "UTF-8")), _chunk("IEND", F.unhex(F.lit(""))))
    return _tools(spark, sf_dir).select("doc_id", "value", made.alias("content"))


@query
def png_records(spark, sf_dir):
    seen = media.media_reports(_png(spark, sf_dir).drop("value"))
    return seen.select("doc_id", F.explode("metadata").alias("m"), "confidence").select("doc_id", "m.kind", "m.label", "m.value", F.col("m.bytes").cast("long").alias("bytes"), "confidence")


@query
def png_strip(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 2 == 0, "ai").otherwise("all")
    done = _png(spark, sf_dir).withColumn("s", media.strip_media(F.col("content"), mode))
    lost = F.octet_length("content") - F.octet_length("s.content")
    return done.select("doc_id", F.col("s.changed").alias("changed"), lost.cast("long").alias("bytes_removed"))


@query
def svg_metadata(spark, sf_dir):
    made = F.concat(F.lit("<svg><metadata><xmp:CreatorTool>"), "value", F.lit("</xmp:CreatorTool></metadata></svg>"))
    seen = _tools(spark, sf_dir).select("doc_id", F.explode(media.svg_records(made)).alias("m"))
    return seen.select("doc_id", "m.kind", "m.label", "m.value")


# -- what an editor shows ---------------------------------------------------------------------


def _problems(spark, sf_dir):
    docs = seeded(spark, sf_dir)
    pay = detect.reported_payloads(docs, BASE).where("not suppressed")
    mixed = detect.reported_words(docs, BASE).where("not suppressed")
    return editor.problems(detect.findings(docs, BASE), pay, mixed)


@query
def editor_problems(spark, sf_dir):
    return _problems(spark, sf_dir).select("path", "line", "column", "width", "severity", "code", "invisible", "rewritable", F.coalesce("new_text", F.lit("-")).alias("new_text"))


@query
def editor_rewrites(spark, sf_dir):
    options = Options(directive=DIRECTIVE, fix_homoglyphs=True)
    done = editor.with_rewrites(_problems(spark, sf_dir), detect.findings(seeded(spark, sf_dir), options))
    return done.where("rewrite is not null").select("path", "line", "column", "code", "rewrite")


@query
def editor_edits(spark, sf_dir):
    return editor.edits(_problems(spark, sf_dir), "hidden")


@query
def editor_summary(spark, sf_dir):
    opened = seeded(spark, sf_dir).where("doc_id % 10 = 0").select("path")
    return editor.not_open(editor.by_file(_problems(spark, sf_dir)), opened)
