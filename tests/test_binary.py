import io
import struct
import zipfile
import zlib

from inkscope.binary import document, media
from inkscope.binary.provenance import aigc_label, fold, generator, strips


def test_generators():
    yes = {"Claude 3": "claude", "ChatGPT": "chatgpt", "chat gpt-4": "chatgpt", "DALL-E 3": "dalle", "Midjourney v6": "midjourney", "GPT-4o": "gpt", "Flux.1 dev": "flux.1", "Kimi": "kimi", "WAN 2.1": "wan", "Google AI": "google ai", "x.ai": "x.ai"}
    assert {k: generator(k) for k in yes} == yes
    assert [generator(v) for v in ("GIMP", "Wanda", "Adobe Firefly", "fluxbox", "Kimiko", "", "Microsoft Word")] == [None] * 7
    assert generator("prefixclaude") is None and generator("prefixclaude", True) == "claude"
    assert fold("  A--b\n9 ") == "a b 9"


def test_aigc():
    assert aigc_label(b'x AIGC": {"Label":"1","ServiceProvider":"p","ContentProducer":"q"}') == "q"
    assert aigc_label(b'AIGC {"ServiceProvider": "p"}') == "p"
    assert aigc_label(b'AIGC {"x": 1} "ServiceProvider"') is None
    assert aigc_label(b"http://www.tc260.org.cn/ns/AIGC/ <a:ContentProducer>me</a:ContentProducer>") == "me"
    assert aigc_label(b"http://www.tc260.org.cn/ns/AIGC/") == ""
    assert strips("ai", "AIGC", "me") and not strips("ai", "AIGC", "") and strips("all", "", "") and not strips("none", "", "claude")


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"0" * 13)


def test_png():
    data = PNG + chunk(b"tEXt", b"Software\0Midjourney") + chunk(b"tEXt", b"Author\0me") + chunk(b"zTXt", b"Comment\0\0zz") + chunk(b"IEND", b"") + b"tail"
    assert [(r.kind, r.label, r.value) for r in media.inspect(data)] == [("png-text", "Software", "Midjourney"), ("png-text", "Author", "me"), ("png-text", "Comment", "")]
    out, changed, error = media.strip(data, "ai")
    assert changed and not error and b"Midjourney" not in out and b"Author" in out and out.endswith(b"tail")
    out, _, _ = media.strip(data, "all")
    assert media.inspect(out) == [] and out == PNG + chunk(b"IEND", b"") + b"tail"
    assert media.strip(data, "none") == (data, False, "")
    assert media.strip(data[:60], "all")[2] and len(media.inspect(data[:80])) <= 1
    manifest = PNG + chunk(b"caBX", b"jumbc2pa\0\1claim by ChatGPT\0") + chunk(b"IEND", b"")
    assert [(r.kind, r.value) for r in media.inspect(manifest)] == [("c2pa", "chatgpt")]


def tiff(value, order="<"):
    size = len(value) + 1
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHII", 8, 1, 0x0131, 2, size, 26) + b"\0\0\0\0" + value + b"\0"


def test_tiff_and_jpeg():
    for order in "<>":
        data = tiff(b"Stable Diffusion", order)
        assert [(r.label, r.value) for r in media.inspect(data)] == [("Software", "Stable Diffusion")]
        out, changed, _ = media.strip(data, "ai")
        assert changed and len(out) == len(data) and media.inspect(out) == []
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    xmp = b"http://ns.adobe.com/xap/1.0/\0<x><xmp:CreatorTool>Firefly 2</xmp:CreatorTool>"
    data = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff(b"Camera")) + seg(0xE1, xmp) + seg(0xFE, b"note") + seg(0xEB, b"c2pa ChatGPT ") + b"\xff\xda rest"
    assert [(r.kind, r.label, r.value) for r in media.inspect(data)] == [("exif", "Software", "Camera"), ("xmp", "CreatorTool", "Firefly 2"), ("jpeg-comment", "", "note"), ("c2pa", "", "chatgpt")]
    out, _, _ = media.strip(data, "ai")
    assert [r.kind for r in media.inspect(out)] == ["exif", "jpeg-comment"] and out.endswith(b"\xff\xda rest")


def test_webp_and_gif():
    part = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    body = b"WEBP" + part(b"VP8X", b"\x0c" + b"\0" * 9) + part(b"VP8L", b"zz") + part(b"EXIF", tiff(b"Midjourney")) + part(b"XMP ", b"<xmp:CreatorTool>GIMP</x>")
    data = b"RIFF" + struct.pack("<I", len(body)) + body
    assert [(r.kind, r.value) for r in media.inspect(data)] == [("exif", "Midjourney"), ("xmp", "GIMP")]
    out, changed, _ = media.strip(data, "ai")
    assert changed and struct.unpack_from("<I", out, 4)[0] == len(out) - 8 and out[20] == 0x04
    gif = b"GIF89a" + b"\0" * 4 + b"\0\0\0" + b"\x21\xfe\x04note\0" + b"\x21\xff\x0bXMP DataXMP" + b"\x20<xmp:CreatorTool>Sora</xmp:Creato"[:33] + b"\0" + b"\x2c..."
    assert [(r.kind, r.value) for r in media.inspect(gif)] == [("jpeg-comment", "note"), ("xmp", "Sora")]
    out, changed, _ = media.strip(gif, "ai")
    assert changed and b"Sora" not in out and b"note" in out


def test_svg():
    text = "<svg><metadata><rdf><dc:creator>Ann</dc:creator></rdf></metadata><x:xmpmeta><xmp:CreatorTool>Claude</xmp:CreatorTool></x:xmpmeta><metadata/></svg>"
    assert [(r.label, r.value) for r in media.inspect_svg(text)] == [("creator", "Ann"), ("CreatorTool", "Claude")]
    assert media.strip_svg(text, "ai") == (text.replace("<xmp:CreatorTool>Claude</xmp:CreatorTool>", ""), True)
    assert media.strip_svg(text, "none") == (text, False)
    assert media.svg_spans("<metadata>a<x:xmpmeta>b</x:xmpmeta></metadata>") == [(10, 35)]
    assert media.detect(b"") == "" and media.inspect(b"zz") == []


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


DOCX = archive([("[Content_Types].xml", "<t/>"), ("docProps/app.xml", "<p:Properties xmlns:p='u'><p:Application>Claude</p:Application><p:Company>ACME</p:Company></p:Properties>"), ("word/document.xml", "<w><t>a​b</t><t>c &amp; d</t></w>"), ("word/media/x.bin", bytes(range(256)) * 9)])


def test_documents():
    assert document.read(DOCX) == ("ooxml", [("Application", "Claude"), ("Company", "ACME")], "a​bc & d\n")
    odt = archive([("mimetype", "x"), ("content.xml", "<a>t</a>"), ("meta.xml", "<m><generator>GPT 4</generator></m>")])
    assert document.read(odt) == ("odf", [("generator", "GPT 4")], "t\n")
    epub = archive([("META-INF/container.xml", "<c/>"), ("b.opf", '<p><meta name="generator" content="Sora"/></p>'), ("c.xhtml", "<h>hi</h>")])
    assert document.read(epub) == ("epub", [("generator", "Sora")], "hi\n")
    assert document.read(b"PK\x03\x04junk") == ("", [], "") and document.read(b"") == ("", [], "")
    fixed, changed = document.fix(epub, "ai")
    assert changed and document.read(fixed)[1] == [] and b'content=""' in zipfile.ZipFile(io.BytesIO(fixed)).read("b.opf")


def test_archive_fix():
    fixed, changed = document.fix(DOCX, "ai", lambda s: s.replace("​", ""))
    assert changed and document.read(fixed) == ("ooxml", [("Company", "ACME")], "abc & d\n")
    old, new = (zipfile.ZipFile(io.BytesIO(d)) for d in (DOCX, fixed))
    assert new.testzip() is None and new.namelist() == old.namelist()
    assert b"c &amp; d" in new.read("word/document.xml")
    a, b = old.getinfo("word/media/x.bin"), new.getinfo("word/media/x.bin")
    raw = lambda d, i: d[i.header_offset + 30 + len(i.filename) :][: i.compress_size]
    assert raw(DOCX, a) == raw(fixed, b)
    assert document.fix(DOCX, "none", lambda s: s) == (DOCX, False)


def test_pdf():
    data = b"%PDF-1.4 /Producer (Claude) /Title (x) /Producer (Claude) /Author (a\\)b) <x:xmpmeta>Claude"
    assert document.read(data)[1] == [("Producer", "Claude"), ("Title", "x"), ("Author", "a\\"), ("XMP", "present")]
    out, changed = document.fix(data, "ai")
    assert changed and len(out) == len(data) and document.residue(out, ["Claude", "zzz"]) == ["Claude"]
    assert b"/Producer ()      " in out
