"""Options of a detection run; plain values, made on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from .tables import ACTIONS, FORMATS, Marker, lookup_table


@dataclass(frozen=True)
class FormatPolicy:
    """Configured actions of one format; None leaves the built-in action."""

    hidden: str | None = None
    typographic: str | None = None
    ivs: str | None = None

    def __post_init__(self):
        for action in (self.hidden, self.typographic, self.ivs):
            if action is not None and action not in ACTIONS:
                raise ValueError(f"unknown action {action!r}, want one of {', '.join(ACTIONS)}")


@dataclass(frozen=True)
class Options:
    """What to look for and what to do about it.

    ``directive`` is the token of inline suppressions: ``<directive>``,
    ``<directive>-next-line`` and ``<directive>-file``.
    """

    strict: bool = False
    clean: bool = False
    fix_homoglyphs: bool = False
    mixed_script: str = "report"
    typographic: bool = True
    ivs: bool = True
    excluded: frozenset[int] = frozenset()
    formats: dict[str, FormatPolicy] = field(default_factory=dict)
    directive: str = "inkscope:ignore"

    def __post_init__(self):
        for name in self.formats:
            if name not in FORMATS:
                raise ValueError(f"unknown format {name!r}, want one of {', '.join(FORMATS)}")
        if self.mixed_script not in ACTIONS:
            raise ValueError(f"unknown action {self.mixed_script!r}")

    def markers(self) -> list[Marker]:
        return lookup_table(self.typographic, self.ivs, self.excluded)

    def action(self, format_: str, kind: str, code: int) -> str:
        """What the policy of a format does with a marker."""
        if format_ == "office":
            from .tables import WORD_COMMON

            if code in WORD_COMMON:
                return "ignore"
        given = self.formats.get(format_, FormatPolicy())
        own = {"hidden": given.hidden, "typographic": given.typographic, "ideographic-vs": given.ivs}.get(kind)
        return own or ("ignore" if format_ == "log" else "clean")
