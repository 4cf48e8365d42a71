"""The marker dimension and the fixed policy tables.

Code points, replacements and sets below are fixed values of the marker
definition.  Names are the Unicode names in title case, with the few exceptions
listed.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

# -- fixed values: which characters are markers -------------------------------
HIDDEN = (
    0x00A0, 0x00AD, 0x034F, *range(0x180B, 0x180F), *range(0x2000, 0x2010), *range(0x202A, 0x2030),
    *range(0x205F, 0x2065), *range(0x2066, 0x206A), 0x3000, *range(0xFE00, 0xFE10), 0xFEFF,
)
FILLERS = (0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x206A, 0x2070), 0x2800, 0x3164, 0xFFA0, *range(0xFFF9, 0xFFFC), 0xFFFD)
TYPOGRAPHIC = (
    0x00B4, 0x01C3, 0x02B9, 0x02BB, 0x02BC, 0x02BE, 0x02C8, 0x0301, 0x037E, 0x0391, 0x0395, 0x0397, 0x0399, 0x039A,
    0x039C, 0x039F, 0x03A1, 0x03A4, 0x03A5, 0x03A7, 0x03BF, 0x0405, 0x0406, 0x0408, 0x0410, 0x0415, 0x041C, 0x041D,
    0x041E, 0x0420, 0x0421, 0x0425, 0x0430, 0x0435, 0x043E, 0x0440, 0x0441, 0x0443, 0x0445, 0x0456, 0x0458, 0x060C,
    *range(0x2010, 0x2016), 0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x2023, 0x2024, 0x2025, 0x2027, 0x2032, 0x2033,
    0x2034, 0x2035, 0x2036, 0x2044, 0x2052, 0x2059, 0x205A, 0x2212, 0x2215, 0x2219, 0x3002, 0xFE50, 0xFE52, 0xFE55,
    0xFE56, 0xFE63, 0xFF01, 0xFF07, 0xFF0C, 0xFF0E, 0xFF0F, 0xFF1A, 0xFF1B, 0xFF1F,
)
TAGS = range(0xE0000, 0xE0080)
SELECTORS = range(0xE0100, 0xE01F0)
#: Never markers, whatever else says so.
NEVER_DETECTED = frozenset({0x00B7, 0x2022, 0x2026})
#: Reported out of context, never rewritten: punctuation of a writing system.
SCRIPT_PUNCTUATION = {0x060C: "arabic", 0x037E: "greek"} | dict.fromkeys(
    (0x3000, 0x3002, 0xFE50, 0xFE52, 0xFE55, 0xFE56, 0xFE63, 0xFF01, 0xFF07, 0xFF0C, 0xFF0E, 0xFF0F, 0xFF1A, 0xFF1B, 0xFF1F),
    "cjk",
)
#: Left alone in office formats.
WORD_COMMON = frozenset({0x00A0, 0x2011, 0x2013, 0x2014, 0x2018, 0x2019, 0x201A, 0x201C, 0x201D, 0x201E, 0x2022, 0x2026})

# -- fixed values: what replaces them, by replacement ---------------------------
_REPLACED = {
    " ": (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x3000, 0x2800, 0x3164, 0xFFA0),
    "'": (0x00B4, 0x02B9, 0x02BB, 0x02BC, 0x02BE, 0x2018, 0x2019, 0x2032, 0x2035, 0xFF07),
    '"': (0x201C, 0x201D, 0x2033, 0x2036),
    "-": (*range(0x2010, 0x2016), 0x2052, 0x2212, 0xFE63),
    ",": (0x060C, 0x201A, 0xFE50, 0xFF0C),
    ".": (0x2024, 0x2027, 0x2219, 0x3002, 0xFE52, 0xFF0E),
    "..": (0x2025,),
    ":": (0xFE55, 0xFF1A),
    ";": (0x037E, 0xFE56, 0xFF1B),
    "!": (0x01C3, 0xFF01),
    "?": (0xFF1F,),
    "/": (0x2044, 0x2215, 0xFF0F),
    "*": (0x2023,),
    "A": (0x0391, 0x0410), "C": (0x0421,), "E": (0x0395, 0x0415), "H": (0x0397, 0x041D), "I": (0x0399, 0x0406),
    "J": (0x0408,), "K": (0x039A,), "M": (0x039C, 0x041C), "O": (0x039F, 0x041E), "P": (0x03A1, 0x0420),
    "S": (0x0405,), "T": (0x03A4,), "X": (0x03A7, 0x0425), "Y": (0x03A5,), "a": (0x0430,), "c": (0x0441,),
    "e": (0x0435,), "i": (0x0456,), "j": (0x0458,), "o": (0x03BF, 0x043E), "p": (0x0440,), "x": (0x0445,), "y": (0x0443,),
}
REPLACEMENT = {c: text for text, codes in _REPLACED.items() for c in codes}
#: Names that are not the Unicode name.
_NAMES = {
    0x00A0: "Non-Breaking Space", 0x2052: "Commercial Minus", 0x2059: "Tricolon", 0x205A: "Four Dot Mark", 0xFE56: "Small Semicolon",
    0xFEFF: "Byte Order Mark (BOM) / Zero Width No-Break Space", 0xFF0C: "Full-Width Comma", 0xFF0E: "Full-Width Full Stop",
    0xE0001: "Language Tag", 0xE007F: "Cancel Tag",
}
#: Directories a scan skips.
IGNORED_DIRS = (
    ".angular .astro .bundle .cache .dart_tool .eggs .git .gradle .hg .mypy_cache .next .nox .nuxt .nyc_output .parcel-cache "
    ".pnpm-store .pytest_cache .pytype .ruff_cache .sass-cache .serverless .svelte-kit .svn .terraform .tests .tox .turbo .venv "
    ".vite .yarn Pods __pycache__ __snapshots__ bower_components htmlcov jspm_packages node_modules testdata venv"
).split()

# -- fixed values: formats by extension and base name ---------------------------
EXTENSIONS = {
    f".{e}": name
    for name, all_ in {
        "prose": "md markdown txt rst adoc asciidoc org tex",
        "log": "log",
        "data": "json jsonc yaml yml toml ini cfg conf csv tsv env properties",
        "markup": "html htm xhtml xml svg vue svelte css scss less",
        "notebook": "ipynb",
        "office": "docx doc odt rtf xlsx pptx pages epub",
        "pdf": "pdf",
    }.items()
    for e in all_.split()
}
PROSE_NAMES = "README LICENSE LICENCE CHANGELOG CHANGES NOTICE AUTHORS CONTRIBUTORS CONTRIBUTING COPYING TODO".split()
FORMATS = ("source", "prose", "data", "markup", "notebook", "office", "pdf", "log")
ACTIONS = ("ignore", "report", "clean")


@dataclass(frozen=True)
class Marker:
    code: int
    name: str
    kind: str
    replacement: str
    can_clean: bool

    @property
    def char(self) -> str:
        return chr(self.code)

    @property
    def label(self) -> str:
        return f"U+{self.code:04X}"

    @property
    def letter(self) -> bool:
        return unicodedata.category(self.char).startswith("L")


def _name(code: int) -> str:
    if code in _NAMES:
        return _NAMES[code]
    if code in TAGS:
        ascii_ = code - 0xE0000
        shown = {34: '"\\""', 92: '"\\\\"'}.get(ascii_, f'"{chr(ascii_)}"')
        return f"Tag {shown}" if 0x20 <= ascii_ <= 0x7E else "Tag Character"
    if code in SELECTORS:
        return f"Ideographic Variation Selector-{17 + code - SELECTORS[0]}"
    return unicodedata.name(chr(code)).title().replace("-To-", "-to-")


def lookup_table(typographic: bool = True, ivs: bool = True, excluded: frozenset[int] = frozenset()) -> list[Marker]:
    """The markers in force, hidden ones before typographic ones."""
    out: dict[int, Marker] = {}

    def add(codes, kind, clean):
        for c in codes:
            if c not in out and c not in excluded and c not in NEVER_DETECTED:
                out[c] = Marker(c, _name(c), kind, REPLACEMENT.get(c, ""), clean(c))

    add(HIDDEN, "hidden", lambda c: c not in SCRIPT_PUNCTUATION)
    add(FILLERS, "hidden", lambda c: c != 0xFFFD)
    add(TAGS, "tag", lambda c: True)
    if ivs:
        add(SELECTORS, "ideographic-vs", lambda c: True)
    if typographic:
        add(TYPOGRAPHIC, "typographic", lambda c: c in REPLACEMENT and c not in SCRIPT_PUNCTUATION)
    return list(out.values())


def char_class(codes) -> str:
    """Regex class of the given code points, as ranges, for Java and RE2 alike."""
    codes = sorted(set(codes))
    parts, k = [], 0
    while k < len(codes):
        end = k
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        parts.append(f"\\x{{{codes[k]:X}}}" + (f"-\\x{{{codes[end]:X}}}" if end > k else ""))
        k = end + 1
    return "[" + "".join(parts) + "]"


def parse_excluded(values) -> frozenset[int]:
    """Code points named by a character or by U+XXXX."""
    out = set()
    for raw in values:
        token = raw.strip()
        if len(token) == 1:
            out.add(ord(token))
            continue
        digits = token[2:] if token[:2] in ("U+", "u+") else token
        try:
            code = int(digits, 16)
        except ValueError:
            code = -1
        if not 0 <= code <= 0x10FFFF:
            raise ValueError(f"not a character or U+XXXX: {raw!r}")
        out.add(code)
    return frozenset(out)
