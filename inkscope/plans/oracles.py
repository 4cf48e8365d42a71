"""SQL of the registered queries, for any engine with RE2 expressions and chr().

Each text is assembled from the common table expressions below; it states the
result in relational terms (islands, windows, joins) and shares no plan with the
Spark side.
"""

from __future__ import annotations

from ..binary.provenance import GENERATORS
from ..options import Options
from ..tables import EXTENSIONS, PROSE_NAMES, SCRIPT_PUNCTUATION, WORD_COMMON, char_class
from .queries import EXCLUDED, TOOLS
from .seeding import DIRECTIVE, seeded_sql, sql_text

OPTIONS = Options(directive=DIRECTIVE)
ANY = char_class(m.code for m in OPTIONS.markers())
TAG, FLAG = char_class(range(0xE0000, 0xE0080)), 0x1F3F4
VARIATION = char_class([*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
ZERO_WIDTH = char_class((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
CURLY, DASH = char_class((0x2018, 0x2019, 0x201C, 0x201D)), char_class((0x2013, 0x2014))
GROUPS = {"cjk": r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]", "arabic": r"[\p{Arabic}\p{Syriac}\p{Thaana}]", "greek": r"[\p{Greek}]"}
JOINING = (
    r"[\p{Arabic}\p{Syriac}\p{Thaana}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}"
    r"\p{Malayalam}\p{Sinhala}\p{Myanmar}\p{Khmer}\p{Tibetan}\p{Javanese}\p{Balinese}]"
)
IDEOGRAPH = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
RTL = r"[\p{Arabic}\p{Hebrew}\p{Syriac}\p{Thaana}]"
ISO = char_class(range(0x2066, 0x206A))
SCRIPTS = "Latin Cyrillic Greek Han Hiragana Katakana Hangul Arabic Hebrew Devanagari Thai Armenian Georgian Bopomofo".split()
NL = "chr(10)"

_markers = ", ".join(
    f"({m.code}, '{m.label}', {sql_text(m.name)}, '{m.kind}', {sql_text(m.replacement)}, {str(m.can_clean).lower()}, {str(m.letter).lower()})"
    for m in OPTIONS.markers()
)
MARKERS = f"markers(code, codepoint, name, kind, replacement, can_clean, letter) AS (VALUES {_markers})"
LINES = (
    f"lines AS (SELECT doc_id, path, text, content, line, CAST(coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM (SELECT doc_id, path, text, "
    f"unnest(string_split(text, {NL})) AS content, generate_subscripts(string_split(text, {NL}), 1) AS line FROM seeded))"
)
CHARS = (
    "chars AS (SELECT doc_id, path, line, off, content, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) AS col "
    f"FROM lines WHERE regexp_matches(content, '{ANY}'))"
)
AROUND = "around AS (SELECT *, lag(ch) OVER w AS prev, lead(ch) OVER w AS next FROM chars WINDOW w AS (PARTITION BY doc_id, line ORDER BY col))"
OCC = (
    "occ AS (SELECT a.doc_id, a.path, a.line, a.col, a.off + a.col - 1 AS pos, a.content, a.ch, a.prev, a.next, m.code, m.codepoint, m.name, m.kind, m.replacement, "
    "m.can_clean, m.letter FROM around a JOIN markers m ON unicode(a.ch) = m.code)"
)
BASE = [seeded_sql(), MARKERS, LINES, CHARS, AROUND, OCC]


def _with(parts, body):
    return "WITH " + ", ".join(parts) + " " + body


def _islands(name: str, pattern: str, source: str = "around") -> str:
    """Maximal runs of a class within lines: first and last column, and what stands before."""
    return (
        f"{name} AS (SELECT doc_id, path, line, off, min(col) AS c1, max(col) AS c2, arg_min(prev, col) AS before, count(*) AS n FROM "
        f"(SELECT *, col - row_number() OVER (PARTITION BY doc_id, line ORDER BY col) AS g FROM {source} WHERE regexp_matches(ch, '{pattern}')) "
        f"GROUP BY doc_id, path, line, off, g)"
    )


def _hex(expr: str, width: int = 2) -> str:
    return f"lpad(lower(to_hex({expr})), {width}, '0')"


# -- payloads -------------------------------------------------------------------------------

_OF = "FROM {r} r JOIN around c ON c.doc_id = r.doc_id AND c.line = r.line AND c.col BETWEEN r.c1 AND r.c2"
TAGS = [
    _islands("tagrun", TAG),
    "tags AS (SELECT r.doc_id, r.path, r.line, r.off, r.c1, r.c2, string_agg(chr(CAST(unicode(c.ch) - 917504 AS INTEGER)), '' ORDER BY c.col) AS shown "
    + _OF.format(r="tagrun")
    + f" WHERE unicode(c.ch) BETWEEN 917536 AND 917630 AND coalesce(unicode(r.before), 0) <> {FLAG} GROUP BY ALL)",
]
VARS = [
    _islands("varrun", VARIATION),
    "vars AS (SELECT r.doc_id, r.path, r.line, r.off, r.c1, r.c2, string_agg("
    + _hex("CASE WHEN unicode(c.ch) < 917760 THEN unicode(c.ch) - 65024 ELSE unicode(c.ch) - 917744 END")
    + ", '' ORDER BY c.col) AS hexed "
    + _OF.format(r="varrun")
    + " WHERE r.n >= 2 GROUP BY ALL)",
]
ZERO = [
    _islands("zwrun", ZERO_WIDTH),
    "zwbits AS (SELECT r.doc_id, r.path, r.line, r.off, r.c1, r.c2, CASE WHEN unicode(c.ch) = 8204 THEN 1 ELSE 0 END AS bit, "
    "row_number() OVER (PARTITION BY r.doc_id, r.line, r.c1 ORDER BY c.col) - 1 AS k " + _OF.format(r="zwrun") + " WHERE unicode(c.ch) IN (8203, 8204))",
    "zwbytes AS (SELECT doc_id, path, line, off, c1, c2, k // 8 AS b, CAST(sum(bit * CAST(pow(2, 7 - k % 8) AS BIGINT)) AS BIGINT) AS v "
    "FROM zwbits GROUP BY ALL HAVING count(*) = 8)",
    "zws AS (SELECT doc_id, path, line, off, c1, c2, string_agg(" + _hex("v") + ", '' ORDER BY b) AS hexed, string_agg(chr(CAST(v AS INTEGER)), '' ORDER BY b) AS shown, "
    "bool_and(v BETWEEN 32 AND 126) AS fine FROM zwbytes GROUP BY ALL)",
]
SPANS = (
    "spans AS (SELECT doc_id, path, line, off, c1, c2, 0 AS rank FROM tags UNION ALL SELECT doc_id, path, line, off, c1, c2, 1 FROM vars "
    "UNION ALL SELECT doc_id, path, line, off, c1, c2, 2 FROM zws)"
)

# -- mixed words -----------------------------------------------------------------------------

_script = "CASE " + " ".join(f"WHEN regexp_matches(ch, '\\p{{{s}}}') THEN '{s}'" for s in SCRIPTS) + " ELSE '' END"
_aug = " AND ".join(
    f"len(list_filter(scripts, lambda s: s NOT IN ({', '.join(repr(x) for x in g)}))) > 0"
    for g in (("Han", "Hiragana", "Katakana", "Latin"), ("Han", "Hangul", "Latin"), ("Han", "Bopomofo", "Latin"))
)
WORDS = [
    "wchars AS (SELECT doc_id, path, line, off, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) AS col FROM lines "
    r"WHERE regexp_matches(content, '[^\p{Latin}\p{Common}\p{Inherited}]'))",
    rf"wgroups AS (SELECT *, {_script} AS script, col - row_number() OVER (PARTITION BY doc_id, line ORDER BY col) AS g FROM wchars "
    r"WHERE regexp_matches(ch, '[\p{L}\p{Nd}\p{M}]'))",
    "wcounts AS (SELECT doc_id, line, g, script, count(*) AS n FROM wgroups WHERE script <> '' GROUP BY ALL)",
    "wscripts AS (SELECT doc_id, line, g, list(script ORDER BY script) AS scripts, first(script ORDER BY n, script) AS rare FROM wcounts GROUP BY ALL)",
    "mixed AS (SELECT w.doc_id, w.path, w.line, w.off, w.g, min(col) AS c1, string_agg(ch, '' ORDER BY col) AS word, s.scripts, s.rare FROM wgroups w "
    f"JOIN wscripts s USING (doc_id, line, g) WHERE len(scripts) >= 2 AND {_aug} GROUP BY ALL)",
    "suspects AS (SELECT w.doc_id, w.line, w.col FROM wgroups w JOIN mixed m ON w.doc_id = m.doc_id AND w.line = m.line AND w.g = m.g AND w.script = m.rare)",
]

# -- the chain --------------------------------------------------------------------------------


def _format(path: str) -> str:
    base = f"regexp_extract({path}, '([^/]*)/*$', 1)"
    ext = f"lower(regexp_extract({base}, '([.][^.]*)$', 1))"
    by = {}
    for e, f in EXTENSIONS.items():
        by.setdefault(f, []).append(f"'{e}'")
    whens = " ".join(f"WHEN {ext} IN ({', '.join(v)}) THEN '{k}'" for k, v in by.items())
    return f"CASE {whens} WHEN {ext} <> '' THEN 'source' WHEN upper({base}) IN ({', '.join(repr(n) for n in PROSE_NAMES)}) THEN 'prose' ELSE 'source' END"


def _directive(token: str) -> str:
    rest = f"substr(content, strpos(content, '{token}') + {len(token)})"
    return f"(strpos(content, '{token}') > 0 AND regexp_matches({rest}, '^[ \\t\\r*/>}})\"`\\]' || chr(39) || '-]*$'))"


SUPPRESS = [
    f"whole AS (SELECT DISTINCT doc_id FROM lines WHERE {_directive(DIRECTIVE + '-file')})",
    f"offlines AS (SELECT doc_id, CASE WHEN {_directive(DIRECTIVE + '-next-line')} THEN line + 1 WHEN {_directive(DIRECTIVE)} THEN line END AS line FROM lines)",
]


def _native(group: str, text: str = "text") -> str:
    n = f"len(regexp_extract_all({text}, '{GROUPS[group]}'))"
    return f"({n} > 0 AND {n} >= 0.1 * len(regexp_extract_all({text}, '\\p{{L}}')))"


def _emoji(c: str) -> str:
    return f"coalesce(unicode({c}) BETWEEN 126976 AND 129791 OR unicode({c}) = 65039 OR regexp_matches({c}, '\\p{{So}}'), false)"


_punct = {g: ", ".join(str(c) for c, x in SCRIPT_PUNCTUATION.items() if x == g) for g in GROUPS}
_near = " ".join(
    f"WHEN code IN ({_punct[g]}) THEN {_native(g)} OR regexp_matches(substr(text, 1, pos), '{GROUPS[g]}\\P{{L}}*$') OR regexp_matches(substr(text, pos + 2), '^\\P{{L}}*{GROUPS[g]}')"
    for g in GROUPS
)
_joins = f"coalesce(regexp_matches(prev, '{JOINING}'), false) OR coalesce(regexp_matches(next, '{JOINING}'), false)"
_no_iso = ISO.replace("[", "[^")
_context = (
    f"CASE WHEN code = 65279 THEN pos = 0 "
    f"WHEN code IN (65038, 65039) THEN coalesce(regexp_matches(prev, '[\\p{{S}}0-9#*]') OR regexp_matches(prev, '{IDEOGRAPH}'), false) "
    f"WHEN code BETWEEN 65024 AND 65037 OR code BETWEEN 917760 AND 917999 THEN coalesce(regexp_matches(prev, '{IDEOGRAPH}'), false) "
    f"WHEN code = 8205 THEN ({_emoji('prev')} AND {_emoji('next')}) OR {_joins} WHEN code = 8204 THEN {_joins} "
    f"WHEN code BETWEEN 6155 AND 6157 THEN coalesce(regexp_matches(prev, '\\p{{Mongolian}}'), false) "
    f"WHEN code BETWEEN 917504 AND 917631 THEN flagged {_near} "
    f"WHEN code BETWEEN 8294 AND 8296 THEN regexp_matches(substr(content, col), '^.{_no_iso}*{RTL}{_no_iso}*\\x{{2069}}') "
    f"WHEN code = 8297 THEN regexp_matches(substr(content, 1, col - 1), '[\\x{{2066}}-\\x{{2068}}]{_no_iso}*{RTL}{_no_iso}*$') ELSE false END"
)


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _lines_with(text: str, pattern: str) -> str:
    return f"len(list_filter(string_split({text}, {NL}), lambda x: regexp_matches(x, '{pattern}')))"


def _established(text: str, form: str, other: str) -> str:
    total = f"({_n(text, form)} + {_n(text, other)})"
    return f"({total} >= 20 AND {_lines_with(text, form)} >= 3 AND {_n(text, form)} > 0.1 * {total})"


QUOTES = "[\"' || chr(39) || ']"
_common = ", ".join(map(str, sorted(WORD_COMMON)))
CHAIN = [
    *BASE, *TAGS, *VARS, *ZERO, SPANS, *WORDS, *SUPPRESS,
    f"flagruns AS (SELECT doc_id, line, c1, c2 FROM tagrun WHERE coalesce(unicode(before), 0) = {FLAG})",
    "facts AS (SELECT o.*, s.text, " + _format("o.path") + " AS format, "
    "EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = o.doc_id AND p.line = o.line AND o.col BETWEEN p.c1 AND p.c2 AND NOT EXISTS "
    "(SELECT 1 FROM offlines x WHERE x.doc_id = p.doc_id AND x.line = p.line) AND p.doc_id NOT IN (SELECT doc_id FROM whole)) AS in_payload, "
    "EXISTS (SELECT 1 FROM suspects u WHERE u.doc_id = o.doc_id AND u.line = o.line AND u.col = o.col) AS suspect, "
    "EXISTS (SELECT 1 FROM flagruns f WHERE f.doc_id = o.doc_id AND f.line = o.line AND o.col BETWEEN f.c1 AND f.c2) AS flagged, "
    "(o.doc_id IN (SELECT doc_id FROM whole) OR EXISTS (SELECT 1 FROM offlines x WHERE x.doc_id = o.doc_id AND x.line = o.line)) AS covered "
    "FROM occ o JOIN seeded s ON s.doc_id = o.doc_id)",
    "judged AS (SELECT *, CASE WHEN kind = 'typographic' AND letter AND NOT suspect THEN 'letter' "
    f"WHEN NOT in_payload AND {_context} THEN 'context' "
    f"WHEN format = 'prose' AND ((regexp_matches(ch, '{CURLY}') AND {_established('text', CURLY, QUOTES)}) OR (regexp_matches(ch, '{DASH}') AND {_established('text', DASH, '-')})) THEN 'typography' "
    f"WHEN format = 'log' OR (format = 'office' AND code IN ({_common})) THEN 'ignored' WHEN covered THEN 'suppressed' ELSE 'finding' END AS verdict FROM facts)",
    "chain AS (SELECT *, verdict = 'finding' AND can_clean AND NOT (kind = 'typographic' AND letter) AS actionable, "
    "CASE WHEN verdict = 'finding' AND can_clean AND NOT (kind = 'typographic' AND letter) THEN "
    "CASE WHEN path LIKE '%.json' THEN replace(replacement, '\"', chr(92) || '\"') ELSE replacement END ELSE '' END AS change FROM judged)",
]
_ID = "substr(sha256(path || chr(0) || key || chr(0) || CAST(occurrence AS VARCHAR)), 1, 16)"
_SEEN = "NOT EXISTS (SELECT 1 FROM offlines x WHERE x.doc_id = {t}.doc_id AND x.line = {t}.line) AND {t}.doc_id NOT IN (SELECT doc_id FROM whole)"
ITEMS = [
    *CHAIN,
    "found AS (SELECT path, codepoint AS key, 0 AS rank, pos AS ord, line, col, 1 AS width, CASE WHEN actionable THEN 'warning' ELSE 'note' END AS level, codepoint AS rule "
    "FROM chain WHERE verdict = 'finding' AND NOT in_payload "
    "UNION ALL SELECT path, 'payload', rank + 1, off + c1 - 1, line, c1, c2 - c1 + 1, 'error', 'payload' FROM spans p WHERE " + _SEEN.format(t="p")
    + " UNION ALL SELECT path, 'mixed:' || word, 4, off + c1 - 1, line, c1, length(word), 'warning', 'mixed-script' FROM mixed m WHERE " + _SEEN.format(t="m") + ")",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY path, key ORDER BY rank, ord) - 1 AS occurrence FROM found)",
    f"items AS (SELECT *, {_ID} AS id FROM numbered)",
    "base AS (SELECT id FROM items WHERE path LIKE '%1.%' OR path LIKE '%4.%')",
]
REPORTS = [
    *CHAIN,
    "pay AS (SELECT path, " + _SEEN.format(t="p") + " AS shown FROM spans p)",
    "mix AS (SELECT path, " + _SEEN.format(t="m") + " AS shown FROM mixed m)",
    "reports AS (SELECT s.path, " + _format("s.path") + " AS format, coalesce(c.f, 0) AS n_findings, coalesce(p.n, 0) AS n_payloads, coalesce(w.n, 0) AS n_mixed_script, "
    "coalesce(c.s, 0) + coalesce(p.s, 0) + coalesce(w.s, 0) AS suppressed, coalesce(c.l, 0) AS legitimate, coalesce(c.a, 0) AS n_actionable FROM seeded s "
    "LEFT JOIN (SELECT path, count(*) FILTER (WHERE verdict = 'finding') AS f, count(*) FILTER (WHERE verdict = 'suppressed') AS s, "
    "count(*) FILTER (WHERE verdict IN ('letter', 'context', 'typography')) AS l, count(*) FILTER (WHERE actionable) AS a FROM chain GROUP BY path) c ON c.path = s.path "
    "LEFT JOIN (SELECT path, count(*) FILTER (WHERE shown) AS n, count(*) FILTER (WHERE NOT shown) AS s FROM pay GROUP BY path) p ON p.path = s.path "
    "LEFT JOIN (SELECT path, count(*) FILTER (WHERE shown) AS n, count(*) FILTER (WHERE NOT shown) AS s FROM mix GROUP BY path) w ON w.path = s.path)",
]
_LEGIT = "SELECT doc_id, line, col AS \"column\", codepoint, verdict = 'context' AS legitimate FROM chain WHERE code {}"
_ESCAPED = "CASE WHEN key LIKE 'mixed:%' THEN 'mixed-script ' || {} ELSE key END"

TREE = (
    "tree AS (SELECT doc_id, CASE (doc_id // 5) % 5 WHEN 0 THEN 'src' WHEN 1 THEN 'docs/build' WHEN 2 THEN 'node_modules/x' WHEN 3 THEN 'docs' ELSE 'a/tmp/b' END "
    "|| '/' || path AS path FROM seeded)"
)
TOOL = "tools AS (SELECT doc_id, coalesce(source, '') || ' ' || CASE doc_id % " + str(len(TOOLS)) + " " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TOOLS)) + " END AS value FROM documents)"
_FOLD = "trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'))"
_GEN = "CASE " + " ".join(f"WHEN regexp_matches({_FOLD}, '\\b{p}') THEN '{n}'" for n, p in GENERATORS) + " ELSE '' END"
ENC = "enc AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 5 AS k FROM documents)"


def _typeset() -> list[str]:
    return [seeded_sql(), "typeset AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, ', ', chr(8212)) ELSE text END AS text FROM seeded)"]


def _spelled(text: str) -> str:
    """Markers as U+XXXX: only the seeded word can hold one."""
    return f"replace({text}, chr(1072), 'U+0430')"


ORACLE_SQL: dict[str, str] = {
    "marker_positions": _with(BASE, 'SELECT doc_id, line, col AS "column", pos AS "offset", codepoint, name, kind FROM occ'),
    "marker_summary_by_kind": _with(BASE, "SELECT kind, codepoint, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM occ GROUP BY ALL"),
    "marker_dimension": _with([MARKERS], "SELECT code, codepoint, name, kind, replacement, can_clean FROM markers"),
    "format_classify": _with(
        [seeded_sql(), "p AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'docs/License' WHEN 1 THEN 'a.b/.env' WHEN 2 THEN 'x/Page.HTML' ELSE path END AS path FROM seeded)"],
        f"SELECT doc_id, path, {_format('path')} AS format FROM p",
    ),
    "policy_filter": _with(CHAIN, "SELECT format, codepoint, count(*) AS n FROM chain WHERE verdict = 'ignored' GROUP BY ALL"),
    "exclude_chars": _with(BASE, f"SELECT codepoint, count(*) AS n FROM occ WHERE code NOT IN ({', '.join(map(str, EXCLUDED))}) GROUP BY ALL"),
    "codepoint_labels": _with(BASE, "SELECT DISTINCT codepoint FROM occ"),
    "payload_tag": _with(
        [*BASE, *TAGS],
        "SELECT doc_id, off + c1 - 1 AS start_at, off + c2 AS end_at, lower(hex(shown)) AS bytes_hex, CASE WHEN trim(shown) <> '' THEN shown ELSE '' END AS decoded, trim(shown) <> '' AS printable, line FROM tags",
    ),
    "payload_variation": _with([*BASE, *VARS], "SELECT doc_id, off + c1 - 1 AS start_at, off + c2 AS end_at, hexed AS bytes_hex, '' AS decoded, false AS printable, line FROM vars"),
    "payload_zero_width": _with(
        [*BASE, *ZERO], "SELECT doc_id, off + c1 - 1 AS start_at, off + c2 AS end_at, hexed AS bytes_hex, CASE WHEN fine THEN shown ELSE '' END AS decoded, fine AS printable, line FROM zws"
    ),
    "payload_membership": _with(CHAIN, 'SELECT doc_id, pos AS "offset", codepoint FROM chain WHERE in_payload'),
    "mixed_words": _with(
        [seeded_sql(), LINES, *WORDS],
        "SELECT m.doc_id, m.line, m.c1 AS \"column\", m.word, array_to_string(m.scripts, ',') AS scripts, string_agg(CAST(w.off + w.col - 1 AS VARCHAR), ',' ORDER BY w.col) AS minority "
        "FROM mixed m JOIN wgroups w ON w.doc_id = m.doc_id AND w.line = m.line AND w.g = m.g AND w.script = m.rare GROUP BY m.doc_id, m.line, m.c1, m.word, m.scripts",
    ),
    "script_of_marker": _with(BASE, f"SELECT DISTINCT code, {_script} AS script FROM occ"),
    "script_census": _with(
        [seeded_sql()], "SELECT doc_id, " + _n("text", r"\p{L}") + " AS letters, " + ", ".join(f"{_n('text', p)} AS {g}" for g, p in GROUPS.items()) + " FROM seeded"
    ),
    "native_script": _with([seeded_sql()], "SELECT doc_id, " + ", ".join(f"{_native(g)} AS {g}" for g in GROUPS) + " FROM seeded"),
    "typography_census": _with(
        [seeded_sql()],
        f"SELECT doc_id, {_n('text', QUOTES)} AS straight_quotes, {_n('text', CURLY)} AS curly_quotes, {_n('text', '-')} AS hyphens, {_n('text', DASH)} AS dashes, "
        f"{_lines_with('text', CURLY)} AS curly_lines, {_lines_with('text', DASH)} AS dash_lines FROM seeded",
    ),
    "typography_established": _with(_typeset(), f"SELECT doc_id, {_established('text', CURLY, QUOTES)} AS curly, {_established('text', DASH, '-')} AS dash FROM typeset"),
    "suppressed_lines": _with(
        [seeded_sql(), LINES, *SUPPRESS],
        f"SELECT s.doc_id, s.doc_id IN (SELECT doc_id FROM whole) AS whole_file, CAST(o.line AS BIGINT) AS line FROM seeded s LEFT JOIN (SELECT * FROM offlines WHERE line IS NOT NULL) o "
        f"ON o.doc_id = s.doc_id WHERE strpos(s.text, '{DIRECTIVE}') > 0",
    ),
    "legit_emoji_joiner": _with(CHAIN, _LEGIT.format("= 8205")),
    "legit_flag_tags": _with(CHAIN, _LEGIT.format("BETWEEN 917504 AND 917631")),
    "legit_variation": _with(CHAIN, _LEGIT.format("BETWEEN 65024 AND 65039")),
    "legit_script_punct": _with(CHAIN, _LEGIT.format(f"IN ({', '.join(map(str, SCRIPT_PUNCTUATION))})")),
    "legit_isolate": _with(CHAIN, _LEGIT.format("BETWEEN 8294 AND 8297")),
    "verdict_chain": _with(CHAIN, 'SELECT doc_id, line, col AS "column", codepoint, verdict, in_payload, actionable, change AS replacement FROM chain'),
    "verdict_counters": _with(CHAIN, "SELECT format, verdict, count(*) AS n FROM chain GROUP BY ALL"),
    "detect_only_text": _with(CHAIN, "SELECT 'detected' AS action, false AS applied, count(*) AS n FROM chain WHERE verdict = 'finding'"),
    "clean_text": _with(
        [*CHAIN, "edits AS (SELECT doc_id, pos, change FROM chain WHERE actionable)",
         "every AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM seeded WHERE doc_id IN (SELECT doc_id FROM edits))",
         "rebuilt AS (SELECT e.doc_id, string_agg(coalesce(x.change, e.ch), '' ORDER BY e.pos) AS t FROM every e LEFT JOIN edits x ON x.doc_id = e.doc_id AND x.pos = e.pos GROUP BY e.doc_id)"],
        "SELECT s.doc_id, r.doc_id IS NOT NULL AS changed, sha256(coalesce(r.t, s.text)) AS clean_sha256 FROM seeded s LEFT JOIN rebuilt r ON r.doc_id = s.doc_id",
    ),
    "occurrence_identity": _with(ITEMS, "SELECT path, key, occurrence, id FROM items"),
    "baseline_new": _with(ITEMS, "SELECT path, key, id FROM items WHERE id NOT IN (SELECT id FROM base)"),
    "baseline_accepted": _with(ITEMS, "SELECT path, key, id FROM items WHERE id IN (SELECT id FROM base)"),
    "baseline_stale": "SELECT '0000000000000000' AS id, 'gone.md' AS path, 'U+200B' AS codepoint",
    "baseline_entries": _with(ITEMS, f"SELECT id, path, {_ESCAPED.format(_spelled('substr(key, 7)'))} AS codepoint FROM items"),
    "file_reports": _with(REPORTS, "SELECT path, format, n_findings, n_payloads, n_mixed_script, suppressed, legitimate FROM reports"),
    "file_summary": _with(
        REPORTS,
        "SELECT count(*) AS files_scanned, count(*) FILTER (WHERE n_findings > 0) AS files_with_markers, CAST(sum(n_findings) AS BIGINT) AS markers_detected, CAST(sum(n_actionable) AS BIGINT) AS markers_actionable, "
        "CAST(0 AS BIGINT) AS markers_applied, CAST(sum(n_payloads) AS BIGINT) AS payloads_decoded, CAST(sum(n_mixed_script) AS BIGINT) AS mixed_script_words, CAST(sum(suppressed) AS BIGINT) AS suppressed FROM reports",
    ),
    "exit_code": _with(REPORTS, "SELECT CASE WHEN sum(n_actionable + n_payloads + n_mixed_script) > 0 THEN 1 ELSE 0 END AS exit_code FROM reports"),
    "file_actionable": _with(REPORTS, "SELECT n_payloads > 0 OR n_mixed_script > 0 OR n_actionable > 0 AS actionable, count(*) AS n FROM reports GROUP BY ALL"),
    "findings_rollup": _with(
        [*CHAIN, "f AS (SELECT format, kind FROM chain WHERE verdict = 'finding')"],
        "SELECT format, kind, count(*) AS n FROM f GROUP BY format, kind UNION ALL SELECT format, '*', count(*) FROM f GROUP BY format UNION ALL SELECT '*', '*', count(*) FROM f",
    ),
    "sarif_results": _with(
        ITEMS, "SELECT path, 'inkscope/' || rule AS rule_id, level, line AS start_line, col AS start_column, col + width AS end_column, id AS identity FROM items ORDER BY path, rank, ord LIMIT 25000"
    ),
    "sarif_rules": _with(
        ITEMS,
        "SELECT DISTINCT 'inkscope/' || i.rule AS rule_id, CASE i.rule WHEN 'payload' THEN 'Hidden payload' WHEN 'mixed-script' THEN 'Mixed-script word' ELSE m.name END AS name "
        "FROM items i LEFT JOIN markers m ON m.codepoint = i.rule",
    ),
    "utf16_columns": _with(
        BASE, r"""SELECT doc_id, line, col AS "column", col - 1 + len(regexp_extract_all(substr(content, 1, col - 1), '[\x{10000}-\x{10FFFF}]')) AS utf16_column FROM occ"""
    ),
    "ignore_match": _with(
        [seeded_sql(), TREE],
        "SELECT doc_id, path LIKE 'docs/build/%' OR path LIKE 'node_modules/%' OR path LIKE 'a/tmp/%' OR (path LIKE '%.log' AND NOT regexp_matches(path, '/d1[^/]*[.]log$')) "
        "OR regexp_matches(path, '^src/d2[^/]*[.]py$') AS ignored FROM tree",
    ),
    "glob_filter": _with([seeded_sql(), TREE], "SELECT doc_id, path FROM tree WHERE regexp_matches(path, '/[^/]*[.]m[a-e]$') OR regexp_matches(path, '/d[^/][.]py$')"),
    "config_override": _with(
        [seeded_sql(), TREE],
        "SELECT doc_id, CASE WHEN path LIKE 'docs/%' THEN 'ignore' ELSE '-' END AS hidden, CASE WHEN path LIKE 'docs/%' THEN '-' ELSE 'report' END AS typographic, "
        "CASE WHEN path LIKE '%.py' OR regexp_matches(path, '^src/d3') THEN 'ignore' ELSE 'report' END AS mixed FROM tree",
    ),
    "decode_bytes": _with(
        [ENC],
        "SELECT doc_id, CASE k WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'latin-1' ELSE 'utf-8' END AS encoding, k IN (1, 2, 3) AS had_bom, "
        "length(t) + CASE WHEN k = 4 THEN 1 ELSE 0 END AS n_chars, sha256(t || CASE WHEN k = 4 THEN chr(233) ELSE '' END) AS text_sha256 FROM enc",
    ),
    "encode_round_trip": _with(
        [ENC],
        "SELECT CASE k WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'latin-1' ELSE 'utf-8' END AS encoding, true AS same, count(*) AS n FROM enc GROUP BY ALL",
    ),
    "container_sniff": "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'tiff' WHEN 4 THEN 'gif' ELSE '' END AS image, doc_id % 8 IN (5, 6) AS container FROM documents",
    "generator_match": _with([TOOL], f"SELECT doc_id, {_GEN} AS generator FROM tools"),
    "pdf_info": _with([TOOL], "SELECT doc_id, 'pdf-property' AS kind, 'Producer' AS label, value FROM tools UNION ALL SELECT doc_id, 'pdf-property', 'Title', 't' FROM tools"),
    "provenance_signals": _with(
        [TOOL, f"g AS (SELECT doc_id, {_GEN} AS g FROM tools)"],
        "SELECT doc_id, CASE WHEN g <> '' THEN 1 ELSE 0 END AS n_signals, CASE WHEN g <> '' THEN 'likely' ELSE '' END AS confidence FROM g",
    ),
    "png_records": _with(
        [TOOL, f"g AS (SELECT doc_id, value, {_GEN} AS g FROM tools)"],
        "SELECT doc_id, 'png-text' AS kind, 'Software' AS label, value, length(value) + 9 AS bytes, CASE WHEN g <> '' THEN 'likely' ELSE '' END AS confidence FROM g",
    ),
    "png_strip": _with(
        [TOOL, f"g AS (SELECT doc_id, value, doc_id % 2 = 1 OR {_GEN} <> '' AS gone FROM tools)"],
        "SELECT doc_id, gone AS changed, CASE WHEN gone THEN length(value) + 21 ELSE 0 END AS bytes_removed FROM g",
    ),
    "svg_metadata": _with([TOOL], "SELECT doc_id, 'xmp' AS kind, 'CreatorTool' AS label, value FROM tools"),
}

# -- variations of the chain ------------------------------------------------------------------

_OFFICE = f"(format = 'office' AND code IN ({_common}))"
_SET = (
    "configured AS (SELECT *, CASE WHEN kind = 'typographic' AND letter AND NOT suspect THEN 'letter' "
    f"WHEN NOT in_payload AND {_context} THEN 'context' WHEN format = 'log' OR {_OFFICE} OR (format = 'source' AND kind = 'hidden') THEN 'ignored' "
    "WHEN covered THEN 'suppressed' ELSE 'finding' END AS verdict FROM facts)"
)
_TYPESET = [
    seeded_sql().replace("seeded AS", "plain AS", 1),
    "seeded AS (SELECT doc_id, path, CASE WHEN doc_id % 2 = 0 THEN replace(text, ', ', chr(8212)) ELSE text END AS text, lang, source FROM plain)",
]
_STRICT = f"strict AS (SELECT *, CASE WHEN format = 'log' OR {_OFFICE} THEN 'ignored' WHEN covered THEN 'suppressed' ELSE 'finding' END AS verdict FROM facts)"
_FENCE = "'^[ \\t]*(`{3,}|~{3,})'"

ORACLE_SQL |= {
    "policy_configured": _with(
        [*CHAIN[:-2], _SET],
        "SELECT format, kind, verdict, verdict = 'finding' AND can_clean AND NOT (kind = 'typographic' AND letter) AND NOT (format = 'prose' AND kind = 'typographic') AS actionable, "
        "count(*) AS n FROM configured GROUP BY ALL",
    ),
    "typography_findings": _with([*_TYPESET, *CHAIN[1:]], "SELECT format, verdict, count(*) AS n FROM chain WHERE codepoint = 'U+2014' GROUP BY ALL"),
    "fence_regions": _with(
        [seeded_sql(), LINES, f"marks AS (SELECT doc_id, line, regexp_matches(content, {_FENCE}) AS mark FROM lines WHERE {_format('path')} IN ('prose', 'notebook'))",
         "opened AS (SELECT *, sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS n FROM marks)"],
        "SELECT doc_id, CAST(line AS BIGINT) AS line FROM opened WHERE mark OR n % 2 = 1",
    ),
    "verdict_chain_strict": _with(
        [*CHAIN[:-2], _STRICT],
        "SELECT codepoint, verdict, verdict = 'finding' AND can_clean AND NOT (kind = 'typographic' AND letter) AS actionable, count(*) AS n FROM strict GROUP BY ALL",
    ),
    "homoglyph_fixes": _with(
        [*CHAIN, "fixed AS (SELECT *, CASE WHEN NOT can_clean THEN '' WHEN path LIKE '%.json' THEN replace(replacement, '\"', chr(92) || '\"') ELSE replacement END AS new FROM chain "
         "WHERE verdict = 'finding' AND kind = 'typographic')"],
        "SELECT codepoint, new AS replacement, CASE WHEN NOT can_clean THEN 'detected' WHEN new = '' THEN 'removed' ELSE 'replaced' END AS action, count(*) AS n FROM fixed GROUP BY ALL",
    ),
    "binary_sniff": _with(
        [ENC],
        "SELECT doc_id, CASE WHEN k IN (2, 3) THEN false WHEN doc_id % 3 = 0 THEN true WHEN k = 4 THEN "
        "len(regexp_extract_all(t, '[\\x20-\\x7E\\t\\n\\r]')) <= 0.75 * (length(t) + 1) ELSE false END AS is_binary FROM enc",
    ),
}

# -- what an editor shows -----------------------------------------------------------------------

_PROBLEMS = [
    *ITEMS,
    "shown AS (SELECT path, line, col, 1 AS width, CASE WHEN actionable THEN 'warning' ELSE 'information' END AS severity, codepoint AS code, "
    "kind IN ('hidden', 'tag', 'ideographic-vs') AS invisible, NOT actionable AS rewritable, CASE WHEN actionable THEN change END AS new_text FROM chain "
    "WHERE verdict = 'finding' AND NOT in_payload UNION ALL SELECT path, line, col, width, 'warning', "
    "CASE rank WHEN 1 THEN 'tag-ascii' WHEN 2 THEN 'variation-selector' ELSE 'zero-width-binary' END, true, false, '' FROM found WHERE rule = 'payload' "
    "UNION ALL SELECT path, line, col, width, 'warning', 'mixed-script', false, false, NULL FROM found WHERE rule = 'mixed-script')",
]

ORACLE_SQL |= {
    "editor_problems": _with(
        _PROBLEMS, "SELECT path, line, col AS \"column\", width, severity, code, invisible, rewritable, coalesce(new_text, '-') AS new_text FROM shown"
    ),
    "editor_rewrites": _with(
        _PROBLEMS,
        'SELECT path, line, col AS "column", codepoint AS code, replacement AS rewrite FROM chain '
        "WHERE verdict = 'finding' AND NOT in_payload AND NOT actionable AND can_clean AND kind = 'typographic' AND letter AND replacement <> ''",
    ),
    "editor_edits": _with(_PROBLEMS, 'SELECT path, line, col AS "column", width, new_text FROM shown WHERE invisible AND new_text IS NOT NULL'),
    "editor_summary": _with(
        _PROBLEMS,
        "SELECT path, count(*) AS problems, count(new_text) AS removable FROM shown WHERE path NOT IN (SELECT path FROM seeded WHERE doc_id % 10 = 0) GROUP BY path",
    ),
}
