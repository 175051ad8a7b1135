"""Masks: the shape of a cell without its value.

Digits become 0, letters A or a by their base letter's case, other letters x;
combining marks vanish and the rest stays. The accents' base letters come from a
table that is computed, not listed, so the whole mask is a chain of builtins.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

GLYPH = "*"


@cache
def accents() -> tuple[str, str]:
    """Every precomposed letter with an ASCII base letter or digit, and the bases."""
    found = []
    for code in range(0x80, sys.maxunicode + 1):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalnum():
            found.append((chr(code), base))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def mask(c: Column) -> Column:
    bare = F.translate(F.regexp_replace(c, r"\p{M}", ""), *accents())
    shaped = F.regexp_replace(bare, "[0-9]", "0")
    for letters, glyph in (("[a-z]", "a"), ("[A-Z]", "A"), (r"[^\P{L}A-Za-z]", "x")):
        shaped = F.regexp_replace(shaped, letters, glyph)
    return shaped


def script_note(masks: list[str]) -> str | None:
    """A note when shapes hold letters of scripts without case."""
    n = sum("x" in m for m in masks)
    return f"{n} shape(s) hold x, a letter of a script without case; changing case leaves such cells alone." if n else None
