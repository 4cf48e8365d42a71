"""What a scan of a local tree finds around it, on the driver: repository, ignore files, configuration.

Nothing here runs on executors.  The user's global ignore file is read only if asked for.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from ..operators.ignore import Config, Pattern, parse_lines

CONFIG_NAME = ".inkscope.json"
BASELINE_NAME = ".inkscope-baseline.json"


def repository_root(start: str) -> Path | None:
    """The nearest directory upwards that holds ``.git`` (a directory or a file)."""
    here = Path(start).resolve()
    return next((d for d in (here, *here.parents) if (d / ".git").exists()), None)


def global_ignore_file() -> Path:
    """The user's ignore file where no other is configured."""
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return Path(base, "git", "ignore")


def _patterns(file: Path, domain: tuple[str, ...]) -> list[Pattern]:
    try:
        return parse_lines(file.read_text(encoding="utf-8", errors="replace"), domain)
    except OSError:
        return []


def _directories(root: Path) -> Iterator[Path]:
    """Directories below ``root``, parents first, names in order; links are not followed."""
    for place, names, _ in os.walk(root):
        names[:] = sorted(n for n in names if n != ".git")
        yield Path(place)


def ignore_patterns(root: str, use_global: bool = False) -> list[Pattern]:
    """All ignore patterns for a scan of ``root``, lowest priority first.

    Global file, ``.git/info/exclude``, the ignore files of directories above the
    root, then those of the tree itself.  Paths of patterns are relative to ``root``;
    those of outer files are matched through the part of the path above it.
    """
    here = Path(root).resolve()
    repo = repository_root(root)
    outer: list[tuple[Path, Path]] = []  # (ignore file, directory it speaks for)
    if use_global:
        outer.append((global_ignore_file(), repo or here))
    if repo is not None:
        outer.append((repo / ".git" / "info" / "exclude", repo))
        above = [d for d in here.parents if d == repo or repo in d.parents]
        outer += [(d / ".gitignore", d) for d in reversed(above)]
    out: list[Pattern] = []
    for file, base in outer:
        depth = here.relative_to(base).parts
        out += [p.below(depth) for p in _patterns(file, ())]
    for d in _directories(here):
        out += _patterns(d / ".gitignore", d.relative_to(here).parts)
    return out


def find_config(start: str) -> tuple[Config, Path | None]:
    """The nearest configuration upwards, no further than the repository root; none is an empty one."""
    here = Path(start).resolve()
    here = here if here.is_dir() else here.parent
    for d in (here, *here.parents):
        file = d / CONFIG_NAME
        if file.is_file():
            return Config.load(file.read_text(encoding="utf-8")), file
        if (d / ".git").exists():
            break
    return Config(), None
