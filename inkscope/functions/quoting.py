"""What a double quote means at each place of a TOML or YAML document.

A class is one letter: ``u`` unknown (a quote may not be written there), ``e``
escaped (written ``\\"``), ``r`` raw.  Line breaks keep their place as line
breaks, so the classes split into lines as the text does.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One step of TOML from each state: the pattern, its class, and where it leads.
_TOML = {
    "none": [(re.compile(r'"""'), "u", "basic3"), (re.compile(r"'''"), "u", "literal3"), (re.compile(r'"'), "u", "basic"), (re.compile(r"'"), "u", "literal"), (re.compile(r"#"), "u", "comment"), (re.compile(r"(?s)."), "u", None)],
    "basic": [(re.compile(r"(?s)\\."), "e", None), (re.compile(r'["\n]'), "e", "none"), (re.compile(r"(?s)."), "e", None)],
    "basic3": [(re.compile(r"(?s)\\."), "e", None), (re.compile(r'"""'), "e", "none"), (re.compile(r"(?s)."), "e", None)],
    "literal": [(re.compile(r"['\n]"), "r", "none"), (re.compile(r"(?s)."), "r", None)],
    "literal3": [(re.compile(r"'''"), "r", "none"), (re.compile(r"(?s)."), "r", None)],
    "comment": [(re.compile(r"\n"), "r", "none"), (re.compile(r"."), "r", None)],
}


def toml_classes(text: str) -> str:
    out, at, state = [], 0, "none"
    while at < len(text):
        for pattern, kind, leads in _TOML[state]:
            if m := pattern.match(text, at):
                out.append(kind * (m.end() - at))
                at, state = m.end(), leads or state
                break
    return "".join(out)


_BLOCK = re.compile(r"[|>][ \t]*(?=\n|\Z)")
_DOUBLE = re.compile(r'(?s)(?:\\.|[^"\\\n]|\\\Z)*')
_SINGLE = re.compile(r"(?:''|[^'\n])*")


def yaml_classes(text: str) -> str:
    """A quoted scalar that crosses a line end leaves the rest unknown; a block never ends."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            body = (_DOUBLE if c == '"' else _SINGLE).match(text, at + 1)
            kind = "e" if c == '"' else "r"
            out.append("u" + kind * (body.end() - at - 1))
            at = body.end()
            if at < len(text) and text[at] == "\n":
                out.append("u" * (len(text) - at))
                break
            if at < len(text):
                out.append(kind)
                at += 1
        elif c == "#":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.append("u" + "r" * (end - at - 1))
            at = end
        elif m := _BLOCK.match(text, at):
            out.append("u")
            out.append("".join("u" if x == "\n" else "r" for x in text[at + 1 :]))
            break
        else:
            out.append("u")
            at += 1
    return "".join(out)


def classes(ext: str, text: str) -> str:
    found = toml_classes(text) if ext == ".toml" else yaml_classes(text)
    return "".join("\n" if t == "\n" else c for t, c in zip(text, found))


@F.pandas_udf(StringType())
def quoting_classes(ext: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([classes(e, t) if t is not None else None for e, t in zip(ext, text)], dtype=object)
