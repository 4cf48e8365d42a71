"""The detection chain: what each marker character is doing where it stands.

``verdicts`` gives every marker occurrence one verdict, decided in this order:

``letter``        a letter of another script outside a suspicious word
``context``       the script, emoji, bidi or text start beside it needs it
``typography``    a prose document's established quotes or dashes
``ignored``       the format's policy leaves it alone
``suppressed``    an inline directive covers its line
``finding``       anything else

Everything is decided from the character's own line plus a few document-level
booleans; only candidate characters become rows, and the marker table is the
one join (broadcast, 525 rows).  So the chain needs no shuffle and runs
unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.quoting import quoting_classes
from ..options import Options
from ..tables import FORMATS, SCRIPT_PUNCTUATION, char_class
from .lines import marked, marker_class, marker_dimension, with_lines
from .payloads import line_payloads, payloads
from .words import FOREIGN, line_words, mixed_words

ISOLATE = char_class(range(0x2066, 0x206A))
_PAYLOAD = "array<struct<scheme:string,start:int,stop:int,bytes:binary>>"
_WORD = "array<struct<start:int,stop:int,word:string,scripts:array<string>,minority:array<int>>>"


def _covered(suppress: Column, line: Column) -> Column:
    return suppress["whole_file"] | F.array_contains(suppress["lines"], line)


def _documents(df: DataFrame, options: Options, text: str, path: str) -> DataFrame:
    """Documents with markers, and what the chain needs to know of each as a whole."""
    t = F.col(text)
    out = df.where(t.rlike(marker_class(options))).withColumn("format", T.format_of(F.coalesce(F.col(path), F.lit(""))))
    out = out.withColumn("__suppress", T.suppression(t, options.directive))
    out = out.withColumn("__masked", T.mask_script_marks(T.mask_flag_tags(t)))
    marks = {g: char_class(c for c, x in SCRIPT_PUNCTUATION.items() if x == g) for g in T.GROUPS}
    native = F.concat(*[F.when(t.rlike(m), F.when(T.native(t, g), g).otherwise("")).otherwise("") for g, m in marks.items()])
    prose = F.col("format") == "prose"
    given = options.formats.get("prose")
    if given is not None and given.typographic is not None:
        prose = F.lit(False)
    settled = lambda form, test: F.when(prose & t.rlike(form), test(t)).otherwise(False)
    out = out.withColumn("__native", native)
    out = out.withColumn("__curly", settled(T.CURLY, T.curly_established)).withColumn("__dash", settled(T.DASH, T.dash_established))
    ext = F.lower(T.extension(F.coalesce(F.col(path), F.lit(""))))
    lexed = ext.isin(".toml", ".yaml", ".yml") & t.rlike(char_class((0x201C, 0x201D, 0x2033, 0x2036)))
    fixed = F.when(ext.isin(".json", ".jsonc", ".ipynb"), "e").when(ext.isin(".ini", ".cfg", ".conf"), "u").when(~ext.isin(".toml", ".yaml", ".yml"), "r")
    out = out.withColumn("__quote", fixed)
    plain = out.where(~lexed).withColumn("__quotes", t)
    return plain.unionByName(out.where(lexed).withColumn("__quotes", quoting_classes(ext, t)))


def _isolate_pairs(arr: Column) -> Column:
    """ARRAY<STRUCT(start, stop)> of matched isolates around right-to-left letters."""
    marks = F.filter(F.transform(arr, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].rlike(ISOLATE))
    start = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<start:int,stop:int>>").alias("pairs"))

    def step(acc, m):
        closes = (F.ascii(m["c"]) == 0x2069) & (F.size(acc["open"]) > 0)
        opens = F.ascii(m["c"]) != 0x2069
        pair = F.struct(F.element_at(acc["open"], -1).alias("start"), m["i"].alias("stop"))
        return F.struct(
            F.when(opens, F.concat(acc["open"], F.array(m["i"])))
            .when(closes, F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))))
            .otherwise(acc["open"])
            .alias("open"),
            F.when(closes, F.concat(acc["pairs"], F.array(pair))).otherwise(acc["pairs"]).alias("pairs"),
        )

    pairs = F.aggregate(marks, start, step, lambda acc: acc["pairs"])
    return F.filter(pairs, lambda p: F.array_join(T.cut(arr, p["start"], p["stop"]), "").rlike(T.RTL))


def _context(c: Column, prev: Column, following: Column, masked: Column, at_start: Column, native: Column, wraps: Column) -> Column:
    """Whether the surroundings need the character."""
    code = F.ascii(c)
    emoji = lambda x: (F.ascii(x).between(0x1F000, 0x1FAFF)) | (F.ascii(x) == 0xFE0F) | x.rlike(r"\p{So}")
    joins = prev.rlike(T.JOINING_CLASS) | following.rlike(T.JOINING_CLASS)
    own = F.lit(None).cast("string")
    for group in T.GROUPS:
        marks = char_class(x for x, g in SCRIPT_PUNCTUATION.items() if g == group)
        own = F.when(c.rlike(marks), group).otherwise(own)
    return (
        F.when(code == 0xFEFF, at_start)
        .when(code.isin(0xFE0E, 0xFE0F), prev.rlike(r"[\p{S}0-9#*]") | prev.rlike(T.IDEOGRAPH))
        .when(code.between(0xFE00, 0xFE0D) | code.between(0xE0100, 0xE01EF), prev.rlike(T.IDEOGRAPH))
        .when(code == 0x200D, (emoji(prev) & emoji(following)) | joins)
        .when(code == 0x200C, joins)
        .when(code.between(0x180B, 0x180D), prev.rlike(r"\p{IsMongolian}"))
        .when(code.between(0xE0000, 0xE007F), masked == T.FLAG_TAG)
        .when(own.isNotNull(), (masked == T.NATIVE_MARK) | F.contains(native, own))
        .when(code.between(0x2066, 0x2069), wraps)
        .otherwise(False)
    )


def _policy(options: Options) -> Column:
    """Action by format, kind and character, as one expression."""
    table = {f"{f}/{k}": options.action(f, k, 0) for f in FORMATS for k in ("hidden", "typographic", "ideographic-vs", "tag")}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    office = [m.char for m in options.markers() if options.action("office", m.kind, m.code) == "ignore" and options.action("office", m.kind, 0) != "ignore"]
    special = (F.col("format") == "office") & F.col("ch").isin(office)
    return F.when(special, "ignore").otherwise(F.element_at(pairs, F.concat_ws("/", "format", "kind")))


def verdicts(df: DataFrame, options: Options = Options(), text: str = "text", path: str = "path") -> DataFrame:
    """One row for each marker occurrence, with its verdict and, for findings, what to do.

    Columns of ``df`` other than the text are kept.
    """
    docs = _documents(df, options, text, path)
    lines = with_lines(docs, text, marker_class(options), {"__masked": F.col("__masked"), "__quotes": F.col("__quotes")})
    content = F.col("content")
    lines = lines.withColumn("__off", _covered(F.col("__suppress"), F.col("line")))
    from .payloads import CARRIER

    hidden = F.when(content.rlike(CARRIER) & ~F.col("__off"), line_payloads(content)).otherwise(F.array().cast(_PAYLOAD))
    lines = lines.withColumn("__payloads", hidden)
    if options.mixed_script == "ignore":
        words = F.array().cast(_WORD)
    else:
        words = F.when(content.rlike(FOREIGN) & ~F.col("__off"), line_words(content)).otherwise(F.array().cast(_WORD))
    lines = lines.withColumn("__minor", F.flatten(F.transform(words, lambda w: w["minority"])))
    lines = lines.withColumn(
        "__wraps", F.when(content.rlike(ISOLATE), T.let(T.chars(content), _isolate_pairs)).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    )
    pattern = marker_class(options)

    def occurrences(hits):
        # texts of equal shape are split only where they differ from the line
        other = lambda c: F.when(F.col(c) != content, T.chars(F.col(c)))
        return T.let(
            F.struct(other("__masked").alias("m"), other("__quotes").alias("q")),
            lambda o: F.transform(
                hits,
                lambda x: F.struct(
                    x["ch"].alias("ch"), x["i"].alias("i"), x["prev"].alias("prev"), x["next"].alias("next"),
                    F.coalesce(F.get(o["m"], x["i"]), x["ch"]).alias("masked"), F.coalesce(F.get(o["q"], x["i"]), x["ch"]).alias("quote"),
                ),
            ),
        )

    keep = [c for c in df.columns if c != text]
    helpers = ["__native", "__curly", "__dash", "__quote", "__off", "__payloads", "__minor", "__wraps", "line", "offset", "format"]
    occ = lines.select(*keep, *helpers, F.explode(occurrences(marked(content, pattern))).alias("__o"))
    i = F.col("__o.i")
    occ = occ.select(
        *keep, *helpers, F.col("__o.ch").alias("ch"), (i + 1).alias("column"),
        F.exists("__payloads", lambda p: (p["start"] <= i) & (i < p["stop"])).alias("in_payload"),
        F.array_contains("__minor", i).alias("__suspect"),
        _context(
            F.col("__o.ch"), F.col("__o.prev"), F.col("__o.next"), F.col("__o.masked"), (F.col("offset") + i) == 0, F.col("__native"),
            F.exists("__wraps", lambda p: (p["start"] == i) | (p["stop"] == i)),
        ).alias("__context"),
        F.coalesce(F.col("__quote"), F.col("__o.quote")).alias("__q"),
    )
    occ = occ.join(F.broadcast(marker_dimension(df.sparkSession, options)), "ch").withColumn("policy", _policy(options))
    lenient = F.lit(not options.strict)
    settled = (F.col("__curly") & F.col("ch").rlike(T.CURLY)) | (F.col("__dash") & F.col("ch").rlike(T.DASH))
    verdict = (
        F.when(lenient & (F.col("kind") == "typographic") & F.col("letter") & ~F.col("__suspect"), "letter")
        .when(lenient & ~F.col("in_payload") & F.col("__context"), "context")
        .when(lenient & settled, "typography")
        .when(F.col("policy") == "ignore", "ignored")
        .when(F.col("__off"), "suppressed")
        .otherwise("finding")
    )
    quoted = F.contains("replacement", F.lit('"'))
    homoglyph = (F.col("kind") == "typographic") & F.col("letter")
    actionable = (F.col("policy") == "clean") & F.col("can_clean") & (F.lit(options.fix_homoglyphs) | ~homoglyph) & (~quoted | (F.col("__q") != "u"))
    escaped = F.when(quoted & (F.col("__q") == "e"), F.replace("replacement", F.lit('"'), F.lit('\\"'))).otherwise(F.col("replacement"))
    occ = occ.withColumn("verdict", verdict).withColumn("actionable", (F.col("verdict") == "finding") & actionable)
    occ = occ.withColumn("replacement", F.when(F.col("actionable"), escaped).otherwise(""))
    applied = F.col("actionable") & F.lit(options.clean)
    return occ.select(
        *keep, "format", "line", "column", (F.col("offset") + F.col("column") - 1).alias("offset"), "ch", "codepoint", "name", "kind",
        "verdict", "in_payload", "actionable", "replacement", applied.alias("applied"),
        F.when(~applied, "detected").when(F.col("replacement") == "", "removed").otherwise("replaced").alias("action"),
    )


def findings(df: DataFrame, options: Options = Options(), text: str = "text", path: str = "path") -> DataFrame:
    """The occurrences to report."""
    return verdicts(df, options, text, path).where("verdict = 'finding'").drop("verdict")


def _split_suppressed(found: DataFrame, df: DataFrame, options: Options, text: str) -> DataFrame:
    return found.withColumn("suppressed", _covered(F.col("__suppress"), F.col("line"))).drop("__suppress")


def reported_payloads(df: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """Payloads, with ``suppressed`` for those a directive covers."""
    held = df.withColumn("__suppress", T.suppression(F.col(text), options.directive))
    return _split_suppressed(payloads(held, text), df, options, text)


def reported_words(df: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """Mixed-script words, with ``suppressed`` for those a directive covers."""
    held = df.withColumn("__suppress", T.suppression(F.col(text), options.directive))
    found = _split_suppressed(mixed_words(held, text), df, options, text)
    return found.where(F.lit(options.mixed_script != "ignore"))


def clean_text(df: DataFrame, options: Options = Options(), key: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """``df`` with markers rewritten: ``clean_text`` and ``changed``.

    A row is known by the hash of its key, path and text: rows that share a key,
    or have none, get their own edits; equal rows get equal ones.  Only findings
    are shuffled, to meet their document; texts without any pass through.  Pieces
    between findings are cut from one split of the text, so the work is linear in
    its length.
    """
    parts = [F.col(c).cast("string") for c in dict.fromkeys((key, path, text))]
    told = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts], *[F.coalesce(F.length(p), F.lit(-1)).cast("string") for p in parts])
    df = df.withColumn("__row", F.md5(told))
    hits = verdicts(df.select(*dict.fromkeys(("__row", path, text))), options, text, path).where("actionable")
    edits = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("offset", "replacement"))).alias("__edits"))

    def rebuild(arr):
        e = F.col("__edits")
        piece = F.transform(
            e,
            lambda x, k: F.concat(
                F.array_join(T.cut(arr, F.coalesce(F.get(e, k - 1)["offset"] + 1, F.lit(0)), x["offset"]), ""), x["replacement"]
            ),
        )
        return F.concat(F.array_join(piece, ""), F.array_join(T.cut(arr, F.element_at(e, -1)["offset"] + 1, F.size(arr)), ""))

    out = df.join(edits, "__row", "left").drop("__row")
    new = F.when(F.col("__edits").isNull(), F.col(text)).otherwise(T.let(T.chars(F.col(text)), rebuild))
    return out.withColumn("clean_text", new).withColumn("changed", F.col("__edits").isNotNull()).drop("__edits")
