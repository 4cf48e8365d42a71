import json

import pytest
from pyspark.sql import functions as F

from inkscope import api
from inkscope.operators import detect, identity, ignore, summary
from inkscope.sinks import reports
from inkscope.sources import codec, files
from inkscope.streaming import live

Z = chr(0x200B)


def test_codec():
    for name, mark in (("utf-8", True), ("utf-8", False), ("utf-16le", True), ("utf-16be", True), ("utf-32le", True), ("utf-32be", True)):
        text = "aé" + chr(0x1F468)
        data, error = codec.encode(text, name, mark)
        assert not error and codec.decode(data) == (text, name, mark, "")
    assert codec.decode(b"caf\xe9") == ("café", "latin-1", False, "")
    assert codec.decode(b"\xff\xfea")[3] and codec.decode(b"\xff\xfe\x00\xd8")[3]
    assert codec.decode(b"\xff\xfe\x00\x00\x00\xd8\x00\x00")[3]
    assert codec.encode("€", "latin-1", False)[1]
    assert codec.decode(b"\xef\xbb\xbf\xe9") == ("é", "latin-1", True, "")


def test_binary():
    cases = {b"": False, b"a\0": True, b"\xff\xfea\0": False, b"\x01" * 2 + b"a" * 9: True, b"\x01" + b"a" * 9: False, "é".encode(): False, b"\xe9" + b"a" * 9: False, b"\xe9" * 3 + b"a" * 9: True}
    assert {k: codec.is_binary(k) for k in cases} == cases


def test_sniff(spark):
    rows = [("p", bytearray(b"\x89PNG\r\n\x1a\n..")), ("d", bytearray(b"PK\x03\x04")), ("t", bytearray(b"text")), ("b", bytearray(b"a\0b")), ("e", bytearray(b""))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.i, r.s) for r in df.select("path", codec.image_format(F.col("content")).alias("i"), codec.scannable(F.col("content")).alias("s")).collect()}
    assert got == {"p": ("png", True), "d": (None, True), "t": (None, True), "b": (None, False), "e": (None, True)}


IGNORE = [
    # (patterns, path, is directory, excluded)
    ("*.log", "a/b.log", False, True),
    ("*.log\n!keep.log", "keep.log", False, False),
    ("build/", "build", False, False),
    ("build/", "build", True, True),
    ("build/", "build/x", False, True),
    ("/top", "top", False, True),
    ("/top", "a/top", False, False),
    ("a/**/z", "a/b/c/z", False, True),
    ("a/**/z", "a/z", False, True),
    ("**/z", "q/z", False, True),
    ("a/b", "a/b/c", False, True),
    ("a/b**", "a/bc", False, False),
    ("a/**", "a/x", False, True),
    ("x?[a-c].t", "xqb.t", False, True),
    ("[^a]x", "ax", False, False),
    ("[^a]x", "bx", False, True),
    ("[", "x", False, False),
    ("a\\*b", "a*b", False, True),
    ("# c\n\n  \nz  ", "z", False, True),
]


def test_patterns(spark):
    for text, path, is_dir, want in IGNORE:
        got = spark.range(1).select(ignore.excluded(F.lit(path), F.lit(is_dir), ignore.parse_lines(text)).alias("x")).first().x
        assert got == want, (text, path, is_dir)


def test_ignored_parents(spark):
    ps = ignore.parse_lines("tmp/\n!tmp/keep.txt")
    paths = ["tmp/keep.txt", "a/node_modules/x.js", "ok/x.js", ".git/config"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.i for r in df.select(ignore.ignored(F.col("p"), ps).alias("i")).collect()] == [True, True, False, True]
    assert [r.i for r in df.select(ignore.ignored(F.col("p"), [], ()).alias("i")).collect()] == [False, False, False, True]


def test_config(spark):
    for bad in ('{"nope": 1}', '{"formats": {"prose": {"typographic": "nuke"}}}', '{"overrides": [{"files": []}]}', '{"mixedScript": "x"}'):
        with pytest.raises(ValueError):
            ignore.Config.load(bad)
    c = ignore.Config.load('{"formats": {"prose": {"hidden": "report"}}, "overrides": [{"files": ["docs/**"], "formats": {"prose": {"ivs": "ignore"}}}]}')
    row = spark.range(1).select(c.setting(F.lit("docs/a.md"), "prose", "hidden").alias("a"), c.setting(F.lit("docs/a.md"), "prose", "ivs").alias("b"), c.setting(F.lit("a.md"), "prose", "hidden").alias("c")).first()
    assert tuple(row) == (None, "ignore", "report")  # the later object replaces the earlier whole


def test_scan_tree(spark, tmp_path):
    for name, data in {"a.py": f"x{Z}".encode(), "b.bin": b"\0\1", "node_modules/c.py": b"x", "sub/d.md": "café au lait".encode("latin-1"), "sub/e.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    tree = files.scan_tree(spark, str(tmp_path))
    assert sorted(r.path for r in tree.collect()) == ["a.py", "sub/d.md"]
    assert sorted(r.path for r in files.scan_tree(spark, str(tmp_path), patterns=["*.py"]).collect()) == ["a.py"]
    assert sorted(r.path for r in files.scan_tree(spark, str(tmp_path), recursive=False).collect()) == ["a.py"]
    docs = files.text_documents(tree)
    assert {r.path: (r.text, r.encoding) for r in docs.collect()}["sub/d.md"] == ("café au lait", "latin-1")
    assert detect.findings(docs).count() == 1


def test_scan_bytes(spark):
    rows = [("a.txt", b"caf\xe9 au\xa0lait"), ("b.txt", "x".encode("utf-16le")), ("c.png", b"\x89PNG\r\n\x1a\n"), ("d.txt", b"\xff\xfe" + f"a{Z}".encode("utf-16le")), ("e.txt", b"same")]
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path: (bytes(r.cleaned), r.error) for r in api.scan_bytes(df).collect()}
    assert got["a.txt"] == (b"caf\xe9 au lait", None)
    assert got["c.png"] == (b"\x89PNG\r\n\x1a\n", "not text") and got["b.txt"][1] == "not text"
    assert got["d.txt"] == (b"\xff\xfea\0", None) and got["e.txt"] == (b"same", None)


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a.py", f"x{Z}"), ("b.py", "clean"), ("c.md", "p" + chr(0x430) + "ypal")], "path string, text string")
    rep = summary.file_reports(docs)
    total = summary.summary(rep)
    whole = json.loads("\n".join(reports.json_report(rep, total)))
    assert [f["path"] for f in whole["files"]] == ["a.py", "b.py", "c.md"] and whole["summary"]["files_scanned"] == 3
    lines = list(reports.text_report(rep, total))
    assert "  1:2  detected  U+200B Zero Width Space (hidden)" in lines and lines[-1] == "found: 2 marker(s) in 2 of 3 file(s)"
    found = detect.findings(docs)
    results = reports.sarif_results(found, detect.reported_payloads(docs), detect.reported_words(docs))
    text, dropped = reports.sarif(results, reports.sarif_rules(found, results), limit=2)
    log = json.loads(text)["runs"][0]
    assert dropped == 1 and len(log["results"]) == 2 and [r["id"] for r in log["tool"]["driver"]["rules"]] == ["inkscope/U+0430", "inkscope/U+200B", "inkscope/mixed-script"]
    items = identity.with_identity(identity.items(found, detect.reported_payloads(docs), detect.reported_words(docs)))
    reports.write_baseline(identity.baseline_entries(items), str(tmp_path / "base"))
    back = files.load_baseline(spark, str(tmp_path / "base"))
    assert back.count() == 3 and identity.new_items(items, back).count() == 0
    assert not [r for r in back.collect() if Z in r.codepoint or chr(0x430) in r.codepoint]


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a.py", f"x{Z}"), ("b.py", "clean")], "path string, text string").write.parquet(src)
    stream = spark.readStream.schema("path string, text string").parquet(src)
    q = live.write(live.stream_findings(stream), out, str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert [(r.path, r.codepoint) for r in spark.read.parquet(out).collect()] == [("a.py", "U+200B")]


def test_plan_has_no_shuffle(spark):
    docs = spark.createDataFrame([("a.py", f"x{Z}")], "path string, text string")
    plan = detect.findings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
