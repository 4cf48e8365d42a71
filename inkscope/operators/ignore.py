"""Ignore patterns and path-dependent configuration.

A pattern is compiled on the driver to one regular expression over a relative
path, so that matching stays in the JVM.  Of several patterns the last that
matches decides.  A file below an excluded directory stays excluded, whatever
later patterns say of the file itself.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import FormatPolicy
from ..tables import IGNORED_DIRS


class BadPattern(ValueError):
    """A glob that can match nothing."""


def glob_regex(glob: str) -> str:
    """Regular expression of a one-segment glob: ``*``, ``?``, classes, backslash."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            k += 1
            if k == len(glob):
                raise BadPattern(glob)
            out.append(_quoted(glob[k]))
        elif c == "[":
            k, part = _glob_class(glob, k + 1)
            out.append(part)
            continue
        else:
            out.append(_quoted(c))
        k += 1
    return "".join(out)


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in "_ -" else f"\\x{{{ord(c):X}}}"


def _glob_class(glob: str, k: int) -> tuple[int, str]:
    deny = k < len(glob) and glob[k] == "^"
    k += deny
    parts: list[str] = []

    def char(at: int) -> tuple[int, str]:
        if at < len(glob) and glob[at] == "\\":
            at += 1
        if at >= len(glob) or (glob[at] in "-]" and glob[at - 1] != "\\"):
            raise BadPattern(glob)
        return at + 1, f"\\x{{{ord(glob[at]):X}}}"

    while not (k < len(glob) and glob[k] == "]" and parts):
        k, low = char(k)
        if k < len(glob) and glob[k] == "-":
            k, high = char(k + 1)
            if int(low[3:-1], 16) > int(high[3:-1], 16):
                continue
            parts.append(f"{low}-{high}")
        else:
            parts.append(low)
    return k + 1, ("[^/" if deny else "[") + "".join(parts) + "]"


@dataclass(frozen=True)
class Pattern:
    """One line of an ignore file below the directory ``domain``."""

    regex: str | None  # of the path from the root; None matches nothing
    include: bool
    dirs_only: str | None  # regex under which a match of the whole path must be a directory
    prefix: str = ""  # what stands before the paths it is given

    @classmethod
    def parse(cls, line: str, domain: tuple[str, ...] = ()) -> Pattern:
        include = line.startswith("!")
        line = line[include:]
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        only = line.endswith("/")
        line = line[:-1] if only else line
        root = "".join(_literal(d) + "/" for d in domain)
        try:
            if "/" in line:
                whole, exact = cls._path_regex(line.split("/"))
            else:
                g = glob_regex(line)
                # the first component of that name decides, as a directory or not
                whole, exact = f"(?:[^/]+/)*?{g}(?:/.*)?", f"(?:(?!{g}/)[^/]+/)*{g}"
        except BadPattern:
            return cls(None, include, None)
        if whole is None:
            return cls(None, include, None)
        return cls(f"^{root}{whole}$", include, f"^{root}{exact}$" if only else None)

    @staticmethod
    def _path_regex(parts: list[str]) -> tuple[str | None, str]:
        out, wander, matched = [], False, False
        for k, part in enumerate(parts):
            if part == "":
                wander = False
            elif part == "**":
                if k == len(parts) - 1:
                    break
                wander = True
            elif "**" in part:
                return None, ""
            else:
                g = glob_regex(part)
                out.append(f"(?:(?!{g}(?:/|$))[^/]+/)*{g}" if wander else g)
                wander, matched = False, True
        body = "/".join(out)
        return (f"{body}(?:/.*)?", body) if matched else (None, "")

    def below(self, parts: tuple[str, ...]) -> Pattern:
        """The same pattern for paths that start below ``parts``."""
        return replace(self, prefix="".join(p + "/" for p in parts) + self.prefix)

    def matches(self, path: Column, is_dir: Column) -> Column:
        if self.regex is None:
            return F.lit(False)
        whole = F.concat(F.lit(self.prefix), path) if self.prefix else path
        hit = whole.rlike(self.regex)
        return hit if self.dirs_only is None else hit & (is_dir | ~whole.rlike(self.dirs_only))


def _literal(name: str) -> str:
    return "".join(map(_quoted, name))


def parse_lines(content: str, domain: tuple[str, ...] = ()) -> list[Pattern]:
    """Patterns of an ignore file: no blank lines, no comments."""
    lines = [x.removesuffix("\r") for x in content.split("\n")]
    return [Pattern.parse(x, domain) for x in lines if x.strip() and not x.startswith("#")]


def excluded(path: Column, is_dir: Column, patterns: list[Pattern]) -> Column:
    """Whether the last pattern that matches this one path excludes it."""
    return reduce(lambda before, p: F.when(p.matches(path, is_dir), F.lit(not p.include)).otherwise(before), patterns, F.lit(False))


def ignored(path: Column, patterns: list[Pattern], dirs: tuple[str, ...] = tuple(IGNORED_DIRS)) -> Column:
    """Whether a file is skipped: a directory above it is, or it is itself."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))
    names = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.arrays_overlap(names, F.array(*map(F.lit, {*dirs, ".git"})))
    return skipped | F.exists(above, lambda d: excluded(d, F.lit(True), patterns)) | excluded(path, F.lit(False), patterns)


def name_matches(path: Column, globs: list[str]) -> Column:
    """Whether the base name matches any glob; no glob matches all, a bad one nothing."""
    if not globs:
        return F.lit(True)
    from ..functions.text import base_name

    good = []
    for g in globs:
        try:
            good.append(f"^{glob_regex(g)}$")
        except BadPattern:
            continue
    return reduce(lambda a, r: a | base_name(path).rlike(r), good, F.lit(False))


# -- configuration ------------------------------------------------------------------

_KEYS = {"exclude", "ignoreDirs", "patterns", "noDefaultIgnores", "noGitignore", "strict", "mixedScript", "formats", "overrides"}
_FIELDS = {"hidden", "typographic", "ivs"}


@dataclass(frozen=True)
class Override:
    files: tuple[str, ...]
    mixed_script: str | None
    formats: dict[str, FormatPolicy]


@dataclass(frozen=True)
class Config:
    """A parsed configuration; unknown keys and actions are errors."""

    exclude: tuple[str, ...] = ()
    ignore_dirs: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    no_default_ignores: bool = False
    no_gitignore: bool = False
    strict: bool = False
    mixed_script: str | None = None
    formats: dict[str, FormatPolicy] | None = None
    overrides: tuple[Override, ...] = ()

    @classmethod
    def load(cls, content: str) -> Config:
        raw = json.loads(content.removeprefix("\ufeff"))
        _only(raw, _KEYS, "config")
        overrides = []
        for k, o in enumerate(raw.get("overrides", [])):
            _only(o, {"files", "mixedScript", "formats"}, f"overrides[{k}]")
            if not o.get("files"):
                raise ValueError(f"overrides[{k}]: files must not be empty")
            overrides.append(Override(tuple(o["files"]), _action(o.get("mixedScript"), f"overrides[{k}].mixedScript"), _formats(o.get("formats"), f"overrides[{k}].")))
        return cls(
            tuple(raw.get("exclude", ())), tuple(raw.get("ignoreDirs", ())), tuple(raw.get("patterns", ())), bool(raw.get("noDefaultIgnores")),
            bool(raw.get("noGitignore")), bool(raw.get("strict")), _action(raw.get("mixedScript"), "mixedScript"), _formats(raw.get("formats"), ""), tuple(overrides),
        )

    def setting(self, path: Column, format_: str, field: str) -> Column:
        """Configured action of a format's field for a path, null where built-in.

        The last matching override that names the format replaces all of it.
        """
        own = lambda formats: F.lit(getattr((formats or {}).get(format_, FormatPolicy()), field)).cast("string")
        out = own(self.formats)
        for o in self.overrides:
            if format_ in o.formats:
                out = F.when(_any(path, o.files), own(o.formats)).otherwise(out)
        return out

    def mixed_action(self, path: Column) -> Column:
        out = F.lit(self.mixed_script or "report")
        for o in self.overrides:
            if o.mixed_script is not None:
                out = F.when(_any(path, o.files), o.mixed_script).otherwise(out)
        return out


def _any(path: Column, globs) -> Column:
    hit = lambda g: F.lit(False) if (p := Pattern.parse(g)).include else p.matches(path, F.lit(False))
    return reduce(lambda a, g: a | hit(g), globs, F.lit(False))


def _only(raw: dict, keys: set[str], where: str) -> None:
    if unknown := set(raw) - keys:
        raise ValueError(f"{where}: unknown field {sorted(unknown)[0]!r}")


def _action(value: str | None, where: str) -> str | None:
    if value is not None and value not in ("ignore", "report", "clean"):
        raise ValueError(f"{where}: {value!r} is not one of ignore, report, clean")
    return value


def _formats(raw: dict | None, where: str) -> dict[str, FormatPolicy]:
    out = {}
    for name, fields in (raw or {}).items():
        _only(fields, _FIELDS, f"{where}formats.{name}")
        out[name] = FormatPolicy(**{k: _action(v, f"{where}formats.{name}.{k}") for k, v in fields.items()})
    return out
