import random

import pytest
from pyspark.sql import functions as F

from inkscope.functions import text as T
from inkscope.functions.quoting import toml_classes, yaml_classes
from inkscope.operators import detect, identity, payloads, summary, words
from inkscope.options import FormatPolicy, Options


def u(*codes):
    return "".join(map(chr, codes))


def frame(spark, rows):
    return spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string")


def seen(spark, path, text, options=Options()):
    got = detect.verdicts(frame(spark, [(path, text)]), options).orderBy("offset").collect()
    return [(r.line, r.column, r.codepoint, r.verdict, r.actionable, r.replacement) for r in got]


CONTEXT = [
    # (text, expected verdicts in order)
    (u(0x1F468, 0x200D, 0x1F469), ["context"]),
    ("a" + u(0x200D) + "b", ["finding"]),
    (u(0x0915, 0x200D), ["context"]),
    (u(0x0645, 0x200C, 0x0646), ["context"]),
    ("a" + u(0x200C), ["finding"]),
    (u(0xFEFF) + "a" + u(0xFEFF), ["context", "finding"]),
    ("1" + u(0xFE0F), ["context"]),
    ("a" + u(0xFE0F), ["finding"]),
    (u(0x845B, 0xE0100), ["context"]),
    ("a" + u(0xE0100), ["finding"]),
    (u(0x1820, 0x180B), ["context"]),
    ("a" + u(0x180B), ["finding"]),
    (u(0x1820, 0x180E), ["finding"]),
    (u(0x65E5, 0x672C, 0x3002), ["context"]),
    ("abc. " * 30 + "x" + u(0x3002), ["finding"]),
    ("abc. " * 30 + u(0x3042, 0x3002), ["context"]),
    ("abc. " * 30 + u(0x3002) + " 12\n" + u(0x3042), ["context"]),
    ("a" * 30 + u(0x060C), ["finding"]),
    (u(0x0645, 0x060C), ["context"]),
    (u(0x2067, 0x0645, 0x2069), ["context", "context"]),
    (u(0x2067) + "a" + u(0x2069), ["finding", "finding"]),
    (u(0x2067, 0x0645) + "\n" + u(0x2069), ["finding", "finding"]),
    (u(0x2067) + "a" + u(0x2068, 0x0645, 0x2069) + "b" + u(0x2069), ["context"] * 4),
    (u(0x202E) + "abc" + u(0x202C), ["finding", "finding"]),
    (u(0x0416, 0x0430), ["letter"]),
    ("p" + u(0x0430) + "ypal", ["finding"]),
    ("don" + u(0x2019) + "t", ["finding"]),
    ("e" + u(0x0301), ["finding"]),
    (u(0x02BC) + "a", ["letter"]),
]


def test_context(spark):
    rows = [("a.txt", t) for t, _ in CONTEXT]
    got = detect.verdicts(frame(spark, rows)).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "verdict"))), lambda x: x["verdict"]).alias("v"))
    found = {r.doc_id: r.v for r in got.collect()}
    for k, (text, want) in enumerate(CONTEXT):
        assert found.get(k) == want, (ascii(text), found.get(k), want)


def test_strict_reports_all(spark):
    got = seen(spark, "a.txt", u(0x1F468, 0x200D, 0x1F469) + u(0x0416, 0x0430), Options(strict=True))
    assert [(c, v, a) for _, _, c, v, a, _ in got] == [("U+200D", "finding", True), ("U+0430", "finding", False)]


def test_typography(spark):
    dash, quote = u(0x2014), u(0x201C)
    prose = "\n".join(["a " + dash + " b"] * 21)
    assert {x[3] for x in seen(spark, "a.md", prose)} == {"typography"}
    assert {x[3] for x in seen(spark, "a.py", prose)} == {"finding"}
    assert {x[3] for x in seen(spark, "a.md", prose.replace("\n", " "))} == {"finding"}  # one line
    assert [x[2:4] for x in seen(spark, "a.md", prose + quote)][-1] == ("U+201C", "finding")
    set_ = Options(formats={"prose": FormatPolicy(typographic="report")})
    assert {x[3:5] for x in seen(spark, "a.md", prose, set_)} == {("finding", False)}


def test_policy(spark):
    text = u(0x200B, 0x2014, 0xA0)
    assert {x[3] for x in seen(spark, "a.log", text)} == {"ignored"}
    assert [x[3] for x in seen(spark, "a.docx", text)] == ["finding", "ignored", "ignored"]
    assert [x[4] for x in seen(spark, "a.py", text, Options(formats={"source": FormatPolicy(hidden="report")}))] == [False, True, False]
    with pytest.raises(ValueError):
        Options(formats={"prose": FormatPolicy(hidden="nuke")})
    tags = Options(formats={"source": FormatPolicy("ignore", "ignore", "ignore")})
    assert [x[2:4] for x in seen(spark, "a.py", "x" + u(0xE0001, 0x200B), tags)] == [("U+E0001", "finding"), ("U+200B", "ignored")]


def test_suppression(spark):
    z = u(0x200B)
    text = f"a{z}\nb{z} # inkscope:ignore\nx # inkscope:ignore-next-line\nc{z}\nd{z} inkscope:ignore it\n"
    assert [(x[0], x[3]) for x in seen(spark, "a.py", text)] == [(1, "finding"), (2, "suppressed"), (4, "suppressed"), (5, "finding")]
    assert {x[3] for x in seen(spark, "a.py", text + "/* inkscope:ignore-file */")} == {"suppressed"}
    # the first occurrence decides
    assert [x[3] for x in seen(spark, "a.py", f"{z} inkscope:ignore x inkscope:ignore")] == ["finding"]
    hidden = payloads.encode_tag("hi")
    docs = frame(spark, [("a.py", f"{hidden} # inkscope:ignore")])
    report = summary.file_reports(docs).first()
    assert (len(report.payloads), report.suppressed, len(report.findings)) == (0, 3, 0)


def test_fences(spark):
    cases = ["a\n```\nb\n```\nc", "~~~~\nx\n~~~\n~~~~ info\ny", "  ```py\nopen", "``\nx", "```\n~~~\n```"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k long, t string")
    got = {r.k: r.c for r in df.select("k", T.code_lines(F.col("t")).alias("c")).collect()}
    assert got == {0: [2, 3, 4], 1: [1, 2, 3, 4], 2: [1, 2], 3: [], 4: [1, 2, 3]}


def test_payload_round_trip(spark):
    data = ["hi", "HELLO world 1", "x"]
    rows = [("a", "é\n" + payloads.encode_tag(d) + "z") for d in data]
    rows += [("a", "q" + payloads.encode_variation(d.encode() * 2) + "z") for d in data]
    rows += [("a", "q" + payloads.encode_zero_width(d.encode()) + "z") for d in data]
    got = {r.doc_id: (r.decoded, r.scheme, r.start, r.runes, r.line, r.column) for r in payloads.payloads(frame(spark, rows)).collect()}
    assert [got[k][0] for k in range(9)] == data + [d * 2 for d in data] + data
    assert got[0] == ("hi", "tag-ascii", 2, 2, 2, 1)
    assert got[6] == ("hi", "zero-width-binary", 1, 16, 1, 2)


def test_payload_rules(spark):
    rows = [
        ("a", u(0x1F3F4) + payloads.encode_tag("gbsct") + u(0xE007F)),  # a flag
        ("a", "x" + u(0xFE01)),  # one selector
        ("a", "x" + u(0x200B) * 7),  # seven bits
        ("a", "x" + u(0x200B, 0x200D) * 8),  # separators do not count
        ("a", "x" + u(0xE0001)),  # no printable tag
        ("a", "x" + payloads.encode_tag("  ")),  # blank
    ]
    got = {r.doc_id: (bytes(r.bytes), r.printable) for r in payloads.payloads(frame(spark, rows)).collect()}
    assert got == {3: (b"\0", False), 5: (b"  ", False)}


def test_mixed_words(spark):
    a = u(0x0430)
    rows = [("a", t) for t in (f"p{a}ypal", u(0x041F, 0x0440), f"x-{a}", "日本ab", f"{a}b", "한A漢", f"e{u(0x301)}", f"{u(0x3b1)}{a}bc")]
    got = {r.doc_id: (r.word, r.scripts, r.minority) for r in words.mixed_words(frame(spark, rows)).collect()}
    assert got == {
        0: (f"p{a}ypal", ["Cyrillic", "Latin"], [1]),
        4: (f"{a}b", ["Cyrillic", "Latin"], [0]),
        7: (f"{u(0x3b1)}{a}bc", ["Cyrillic", "Greek", "Latin"], [1]),
    }


def test_quoting():
    assert toml_classes('a="b"\n') == "uuueeu"
    assert toml_classes("'''x'''#c") == "uuurrrrur"
    assert toml_classes('"""a"b"""') == "uuueeeeee"
    assert toml_classes('"a\\"b"') == "ueeeee"
    assert yaml_classes('k: "a\\"b" # c') == "uuuueeeeeuurr"
    assert yaml_classes("k: 'it''s'") == "uuuurrrrrr"
    assert yaml_classes('"a\nb: c') == "ue" + "u" * 5
    assert yaml_classes("a: |\n  x") == "uuuu" + "u" + "rrr"


def test_clean_and_quotes(spark):
    q = u(0x201C)
    rows = [("a.json", f'{{"k": "{q}"}}'), ("a.ini", q), ("a.py", q + u(0x2033)), ("a.yaml", f"k: {q}"), ("a.toml", f"k = '{q}'"), ("a.txt", None)]
    got = {r.path: r.clean_text for r in detect.clean_text(frame(spark, rows)).collect()}
    assert got == {"a.json": '{"k": "\\""}', "a.ini": q, "a.py": '""', "a.yaml": f"k: {q}", "a.toml": "k = '\"'", "a.txt": None}


def test_properties(spark):
    """Cleaning is idempotent, keeps line counts, and touches nothing it does not report."""
    r = random.Random(4)
    pool = "ab \n\"'-.#:" + u(0x200B, 0x200C, 0x200D, 0xA0, 0x2014, 0x201C, 0x0430, 0x3002, 0x65E5, 0xFE0F, 0xE0041, 0x1F468, 0x2067, 0x2069, 0x0645, 0xFEFF)
    rows = [(f"f{k}{r.choice(['.md', '.py', '.json', '.docx', '.toml'])}", "".join(r.choices(pool, k=r.randint(0, 60)))) for k in range(300)]
    docs = frame(spark, rows)
    once = detect.clean_text(docs).select("doc_id", "path", "text", "clean_text", "changed").cache()
    found = {x.doc_id for x in detect.findings(docs).where("actionable").select("doc_id").distinct().collect()}
    for x in once.collect():
        assert x.changed == (x.doc_id in found)
        assert x.changed or x.clean_text == x.text
        assert x.clean_text.count("\n") == x.text.count("\n")
    again = detect.clean_text(once.select("doc_id", "path", F.col("clean_text").alias("text")), Options())
    # deleting a character may bring new neighbours together, so the second pass must shrink, and the third be still
    third = detect.clean_text(again.select("doc_id", "path", F.col("clean_text").alias("text")))
    assert again.where("changed").count() <= once.where("changed").count() // 10
    assert third.where("changed").count() <= again.where("changed").count()


def test_identity_anchor(spark):
    one = spark.range(1).select(identity.identity(F.lit("old.go"), F.lit("U+200B"), F.lit(0)).alias("id"))
    assert one.first().id == "4088ba54cd20a6b4"


def test_baseline_and_exit(spark):
    docs = frame(spark, [("a.py", "x" + u(0x200B) + "y" + u(0x200B)), ("b.py", "clean"), ("c.py", payloads.encode_tag("hey"))])
    none = detect.reported_words(docs)
    items = identity.with_identity(identity.items(detect.findings(docs), detect.reported_payloads(docs), none)).cache()
    assert sorted((r.path, r.key, r.occurrence) for r in items.collect()) == [("a.py", "U+200B", 0), ("a.py", "U+200B", 1), ("c.py", "payload", 0)]
    base = identity.baseline_entries(items.where("path = 'a.py'"))
    assert identity.new_items(items, base).count() == 1 and identity.accepted_items(items, base).count() == 2
    gone = identity.stale_entries(items.where("occurrence = 0"), base)
    assert gone.count() == 1
    total = summary.summary(summary.file_reports(docs))
    row = total.first()
    assert (row.files_scanned, row.files_with_markers, row.markers_detected, row.payloads_decoded) == (3, 2, 5, 1)
    assert [summary.exit_code(total, e, f).first().exit_code for e, f in ((0, True), (0, False), (1, True))] == [1, 0, 2]


def test_empty(spark):
    docs = frame(spark, [("a.py", None), (None, ""), (None, "x" + u(0x200B))])
    assert [r.verdict for r in detect.verdicts(docs).collect()] == ["finding"]
    assert summary.file_reports(docs.where("false")).count() == 0


def test_time_is_linear_in_marker_lines(spark):
    """Sixteen times the lines with markers take far less than sixteen times sixteen times as long."""
    import time

    def took(n):
        text = "\n".join(f"line {k} of\u200b text" for k in range(n))
        df = spark.createDataFrame([(1, text, "a.md")], "doc_id long, text string, path string")
        begin = time.time()
        seen = detect.verdicts(df).agg(F.count(F.lit(1)), F.max("offset"), F.max("line")).first()
        assert tuple(seen) == (n, text.rindex("\u200b"), n)
        return time.time() - begin

    took(10)
    small, large = took(4_000), took(64_000)
    assert large < 16 * small + 20


def test_clean_rows_that_share_a_key(spark):
    """Repeated and missing keys: each row has its own edits."""
    rows = [(1, "a\u200bb", "x.py"), (1, "\u200bcd\u200b", "x.py"), (None, "e\u200bf", "x.py"), (None, "gh", "x.py"), (1, "a\u200bb", "x.py")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = sorted((r.doc_id is None, r.clean_text, r.changed) for r in detect.clean_text(df, Options(clean=True)).collect())
    assert got == [(False, "ab", True), (False, "ab", True), (False, "cd", True), (True, "ef", True), (True, "gh", False)]
