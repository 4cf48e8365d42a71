import io
import json
import zipfile

from inkscope import cli
from inkscope.binary import document
from inkscope.options import Options
from inkscope.plans.scan import scan_files, scan_summary
from inkscope.sources import discovery, files
from pyspark.sql import functions as F

Z = chr(0x200B)


def docx(text, app="Claude"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/app.xml", f"<p><Application>{app}</Application></p>")
        z.writestr("word/document.xml", f"<w><t>{text}</t></w>")
    return out.getvalue()


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")


def test_scan_files(spark):
    rows = [
        ("a.py", f"x{Z}".encode()), ("b.docx", docx(f"a{Z}b")), ("c.pdf", b"%PDF-1.4 /Producer (GIMP)"), ("d.svg", b"<svg><metadata><xmp:CreatorTool>Sora</xmp:CreatorTool></metadata></svg>"),
        ("e.txt", b"\xff\xfea"), ("f.gif", b"GIF89a" + b"\0" * 7 + b"\x21\xfe\x02hi\0;"), ("g.txt", b"clean"),
    ]
    reports = scan_files(frame(spark, rows))
    got = {r.path: r for r in reports.collect()}
    assert set(got) == {p for p, _ in rows}
    assert len(got["a.py"].findings) == 1 and got["a.py"].encoding == "utf-8"
    assert [(m.kind, m.label, m.value) for m in got["b.docx"].metadata] == [("ooxml-property", "Application", "Claude")]
    assert len(got["b.docx"].findings) == 1 and got["b.docx"].confidence == "likely" and got["b.docx"].encoding == "container"
    assert got["c.pdf"].confidence == "" and len(got["c.pdf"].metadata) == 1
    assert got["d.svg"].confidence == "likely" and got["d.svg"].provenance[0].detail == "sora"
    assert got["e.txt"].error and got["f.gif"].metadata[0].value == "hi" and got["f.gif"].format == "gif"
    total = scan_summary(reports).first()
    assert (total.files_scanned, total.files_with_markers, total.metadata_records, total.errors) == (7, 5, 4, 1)


def test_fix_documents(spark):
    same = docx("same", "Word")
    done = document.fix_documents(frame(spark, [("b.docx", docx(f"a{Z}b")), ("c.docx", same), ("d.pdf", b"%PDF-1.4 /Producer (Claude) Claude")]), Options(), "ai").collect()
    got = {r.path: r for r in done}
    assert document.read(bytes(got["b.docx"].content)) == ("ooxml", [], "ab\n") and got["b.docx"].changed
    assert not got["c.docx"].changed and bytes(got["c.docx"].content) == same
    assert got["d.pdf"].residue == ["Claude"]


def test_discovery(spark, tmp_path):
    repo = tmp_path / "repo"
    sub = repo / "sub"
    sub.mkdir(parents=True)
    (repo / ".git" / "info").mkdir(parents=True)
    (repo / ".git" / "info" / "exclude").write_text("*.tmp\n")
    (repo / ".gitignore").write_text("/sub/top.py\nkeep.log\n")
    (sub / ".gitignore").write_text("own.py\n!keep.log\n")
    (repo / discovery.CONFIG_NAME).write_text('{"strict": true}')
    for name in ("a.tmp", "top.py", "own.py", "keep.log", "b.py"):
        (sub / name).write_text("x")
    assert discovery.repository_root(str(sub)) == repo
    config, where = discovery.find_config(str(sub))
    assert config.strict and where == repo / discovery.CONFIG_NAME
    kept = files.scan_tree(spark, str(sub), ignore=discovery.ignore_patterns(str(sub)))
    assert sorted(r.path for r in kept.where(~F.endswith("path", F.lit("ignore"))).collect()) == ["b.py", "keep.log"]


def test_cli(spark, tmp_path, capsys):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text(f"x{Z}y")
    (tree / "b.py").write_text("clean")
    run = lambda *a: cli.main([str(tree), *a], spark)
    assert run() == 0 and "U+200B" in capsys.readouterr().out
    assert run("--fail", "--quiet") == 1
    assert run("--json") == 0 and json.loads(capsys.readouterr().out)["summary"]["markers_detected"] == 1
    assert run("--sarif") == 0 and len(json.loads(capsys.readouterr().out)["runs"][0]["results"]) == 1
    base = str(tmp_path / "base")
    assert run("--baseline", base, "--write-baseline") == 0 and run("--baseline", base, "--fail") == 0
    assert run("--fix", "--out", str(tmp_path / "out"), "--quiet") == 0
    written = [p for p in (tmp_path / "out").rglob("*") if p.is_file()] or [p for p in tree.rglob("*") if p.read_text() == "xy"]
    assert run("--fix") == 2 and run("--config", str(tmp_path / "none")) == 2
    assert written
    assert run("--exclude-char", "U+200B", "--fail") == 0
