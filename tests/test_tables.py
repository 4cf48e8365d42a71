import re

import pytest

from inkscope import tables as T


def test_dimension():
    rows = T.lookup_table()
    assert len(rows) == len({m.code for m in rows}) == 525
    assert {k: sum(m.kind == k for m in rows) for k in ("hidden", "typographic", "tag", "ideographic-vs")} == {
        "hidden": 74, "typographic": 83, "tag": 128, "ideographic-vs": 240,
    }


def test_sets():
    by = {m.code: m for m in T.lookup_table()}
    assert all(not by[c].can_clean for c in T.SCRIPT_PUNCTUATION)
    assert not T.NEVER_DETECTED & set(by)
    assert [c for c, m in by.items() if m.kind == "typographic" and not m.replacement] == [0x02C8, 0x0301, 0x2034, 0x2059, 0x205A]
    assert {c for c, m in by.items() if m.code in T.HIDDEN and m.replacement} == {0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000}
    assert by[0x205F].replacement == "" and by[0xFFFD].can_clean is False
    assert len(T.IGNORED_DIRS) == 39


def test_options():
    assert len(T.lookup_table(typographic=False)) == 525 - 83
    assert len(T.lookup_table(ivs=False)) == 525 - 240
    assert 0x200B not in {m.code for m in T.lookup_table(excluded=frozenset({0x200B}))}
    assert T.parse_excluded(["U+200B", "u+2014", "x", "00A0"]) == {0x200B, 0x2014, ord("x"), 0xA0}
    with pytest.raises(ValueError):
        T.parse_excluded(["U+110000"])


def test_char_class():
    assert re.fullmatch(T.char_class([65, 66, 67, 90]).replace("\\x{", "\\x").replace("}", ""), "B")
    assert T.char_class([0x41, 0x42, 0x5A]) == r"[\x{41}-\x{42}\x{5A}]"
