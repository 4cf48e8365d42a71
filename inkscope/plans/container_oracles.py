"""SQL of the container queries: what was put in, stated without reading any bytes."""

from __future__ import annotations

from ..binary.provenance import GENERATORS
from .containers import CONTEXTS, QUOTED
from .oracles import ORACLE_SQL, REPORTS, TOOL, _with
from .seeding import sql_text


def _generator(value: str, bound: str = "\\b") -> str:
    folded = f"trim(regexp_replace(lower({value}), '[^a-z0-9]+', ' ', 'g'))"
    return "CASE " + " ".join(f"WHEN regexp_matches({folded}, '{bound}{p}') THEN '{n}'" for n, p in GENERATORS) + " ELSE '' END"


_G = f"g AS (SELECT doc_id, value, strlen(value) AS n, {_generator('value')} AS g, {_generator('value', '')} AS near FROM tools)"
_SURE = "CASE WHEN g <> '' THEN 'likely' ELSE '' END"
#: Whether a C2PA record's own name is one of a generator.
_NAMED = f"(near <> '' AND {_generator('near')} <> '')"
_FLAG = f"CASE WHEN g <> '' OR {_NAMED} THEN 'likely' ELSE 'possible' END"


def _union(parts: list[str], sure: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {p}, {sure} AS confidence FROM g" for p in parts)


_SOFTWARE = "'exif' AS kind, 'Software' AS label, value, n + {} AS bytes"
_TOOL_XMP = "'xmp' AS kind, 'CreatorTool' AS label, value, n + {} AS bytes"

ORACLE_SQL |= {
    "jpeg_records": _with(
        [TOOL, _G],
        _union(["'jpeg-comment' AS kind, '' AS label, value, n AS bytes", _SOFTWARE.format(33), _TOOL_XMP.format(71), "'c2pa' AS kind, '' AS label, near AS value, n + 11 AS bytes"], _FLAG),
    ),
    "jpeg_strip": _with(
        [TOOL, _G],
        "SELECT doc_id, all_ OR g <> '' OR own AS changed, CASE WHEN all_ OR g <> '' THEN 3 * n + 116 ELSE 0 END + CASE WHEN all_ OR own THEN n + 15 ELSE 0 END AS bytes_removed, "
        f"CASE WHEN all_ OR g <> '' THEN 0 ELSE 3 END + CASE WHEN all_ OR own OR near = '' THEN 0 ELSE 1 END AS n_left FROM (SELECT *, doc_id % 2 = 1 AS all_, {_NAMED} AS own FROM g)",
    ),
    "webp_records": _with([TOOL, _G], _union([_SOFTWARE.format(27), _TOOL_XMP.format(42)], _SURE)),
    "webp_strip": _with(
        [TOOL, _G],
        "SELECT doc_id, gone AS changed, CASE WHEN gone THEN 16 + n + 27 + (n + 27) % 2 + n + 42 + n % 2 ELSE 0 END AS bytes_removed, CASE WHEN gone THEN 0 ELSE 2 END AS n_left "
        "FROM (SELECT *, doc_id % 2 = 1 OR g <> '' AS gone FROM g)",
    ),
    "gif_records": _with([TOOL, _G], _union(["'jpeg-comment' AS kind, '' AS label, value, n AS bytes", _TOOL_XMP.format(53)], _SURE)),
    "gif_strip": _with(
        [TOOL, _G],
        "SELECT doc_id, gone AS changed, CASE WHEN gone THEN (n + 4) + (n + 58) ELSE 0 END AS bytes_removed, CASE WHEN gone THEN 0 ELSE 2 END AS n_left "
        "FROM (SELECT *, doc_id % 2 = 1 OR g <> '' AS gone FROM g)",
    ),
    "tiff_records": _with([TOOL, _G], _union([_SOFTWARE.format(27)], _SURE)),
    "tiff_strip": _with(
        [TOOL, _G], "SELECT doc_id, gone AS changed, 0 AS bytes_removed, CASE WHEN gone THEN 0 ELSE 1 END AS n_left FROM (SELECT *, doc_id % 2 = 1 OR g <> '' AS gone FROM g)"
    ),
    "aigc_labels": _with(
        [TOOL],
        "SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'AIGC' ELSE 'note' END AS label, CASE WHEN doc_id % 4 < 2 THEN trim(value) ELSE '' END AS value, "
        "CASE WHEN doc_id % 4 < 2 THEN 'likely' ELSE '' END AS confidence FROM tools",
    ),
    "image_damage": _with([TOOL], "SELECT doc_id, 1 AS n_records, CASE WHEN doc_id % 2 = 1 THEN strlen(value) + 4 ELSE 0 END AS bytes_removed FROM tools"),
    "svg_spans": _with(
        [TOOL],
        "SELECT doc_id, 'CreatorTool' AS label, value, strlen(value) + 58 AS bytes FROM tools WHERE doc_id % 5 <> 0 "
        "UNION ALL SELECT doc_id, 'creator', value, strlen(value) + 25 FROM tools WHERE doc_id % 5 <> 0",
    ),
    "svg_strip": _with(
        [TOOL, _G],
        "SELECT doc_id, sha256('<svg><metadata>' || CASE WHEN gone THEN '' ELSE '<x:xmpmeta><xmp:CreatorTool>' || value || '</xmp:CreatorTool></x:xmpmeta>' END || '</metadata><metadata/><g/><metadata>' || "
        "CASE WHEN gone THEN '' ELSE '<dc:creator>' || value || '</dc:creator>' END || '</metadata></svg>') AS svg_sha256 FROM (SELECT *, doc_id % 2 = 1 OR g <> '' AS gone FROM g)",
    ),
    "archive_records": _with(
        [TOOL, _G],
        "SELECT 'd' || doc_id || '.docx' AS path, CASE doc_id % 3 WHEN 0 THEN 'ooxml' WHEN 1 THEN 'odf' ELSE 'epub' END AS format, CASE doc_id % 3 WHEN 0 THEN 'Application' ELSE 'generator' END AS label, "
        f"trim(value) AS value, {_SURE} AS confidence FROM g UNION ALL SELECT 'd' || doc_id || '.docx', 'ooxml', 'Pages', '1', {_SURE} FROM g WHERE doc_id % 3 = 0",
    ),
    "archive_text": "SELECT 'd' || doc_id || '.docx' AS path, 'body of ' || doc_id || CASE WHEN doc_id % 7 = 0 THEN chr(8203) ELSE '' END || chr(10) AS text FROM documents",
    "archive_fix": _with(
        [TOOL, _G],
        "SELECT 'd' || doc_id || '.docx' AS path, g <> '' OR doc_id % 7 = 0 AS changed, 0 AS n_residue, 'body of ' || doc_id || chr(10) AS text, CASE WHEN g <> '' THEN 0 ELSE 1 END AS n_tools FROM g",
    ),
    "pdf_fix": "SELECT doc_id, true AS changed, true AS same_size, 0 AS n_left FROM documents",
    "decode_errors": (
        "SELECT doc_id, CASE k WHEN 0 THEN 'utf-32be' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'utf-16be' ELSE 'latin-1' END AS encoding, true AS had_bom, "
        "CASE k WHEN 0 THEN length(t) WHEN 3 THEN strlen(t) + 1 ELSE -1 END AS n_chars, k IN (1, 2) AS failed FROM (SELECT doc_id, doc_id % 4 AS k, coalesce(text, '') AS t FROM documents)"
    ),
    "scannable_files": "SELECT doc_id, doc_id % 6 NOT IN (1, 5) AS kept FROM documents",
}

_REWRITTEN = ('a = "x\\"y\\"z"', "a = 'x\"y\"z'", '# x"y"z', 'a: "x\\"y\\"z"', "a: 'x\"y\"z'", '{"a": "x\\"y\\"z"}', None, "a = 'x\"y\"z'")
_CONTEXT = ("context", "finding", "context", "finding", "context", "finding", "context", "finding", "context", "finding", "context", "finding")


def _case(values) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_MARKS = [(text.index(m) + 1, f"U+{ord(m):04X}") for _, text in CONTEXTS for m in text if ord(m) in (0xFEFF, 0xFE0F, 0x200C, 0x180B, 0xE0100, 0x200D)]
ORACLE_SQL |= {
    "quoting_rewrites": f"SELECT doc_id, {_case([sql_text(new or old) for (_, old), new in zip(QUOTED, _REWRITTEN)])} AS clean_text, {_case([str(n is not None).lower() for n in _REWRITTEN])} AS changed FROM documents",
    "legit_context": (
        f"SELECT doc_id, {_case([str(c) for c, _ in _MARKS])} AS \"column\", {_case([f"'{p}'" for _, p in _MARKS])} AS codepoint, {_case([f"'{v}'" for v in _CONTEXT])} AS verdict FROM documents"
    ),
    "json_rows": _with(REPORTS, "SELECT path, format, n_findings, n_payloads, n_mixed_script AS n_mixed FROM reports"),
    "text_lines": _with(
        [*REPORTS, "inside AS (SELECT path, count(*) FILTER (WHERE NOT in_payload) AS shown, count(*) FILTER (WHERE in_payload) AS hidden FROM chain WHERE verdict = 'finding' GROUP BY path)"],
        "SELECT path, 'payload' AS what, n_payloads AS n FROM reports WHERE n_payloads > 0 UNION ALL SELECT path, 'mixed', n_mixed_script FROM reports WHERE n_mixed_script > 0 "
        "UNION ALL SELECT path, 'finding', shown FROM inside WHERE shown > 0 UNION ALL SELECT path, 'inside', 1 FROM inside WHERE hidden > 0",
    ),
}
