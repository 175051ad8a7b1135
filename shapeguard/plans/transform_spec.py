"""Transform specifications from untrusted fields."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from shapeguard.operators.transforms import KINDS, MAX_PAD
from shapeguard.plans.predicate import whole
from shapeguard.types import TransformSpec


class SpecError(ValueError):
    """A call that names no transform; the message says what to change."""


#: Per kind: the targets its field ``to`` may name.
TARGETS = {"changeCase": ("lower", "upper", "title"), "normaliseDate": ("dateIso", "timestampIso"), "normaliseNumber": ("decimalPoint", "integerPlain")}


def parse_spec(raw: Any) -> tuple[TransformSpec, list[str]]:
    """The spec and notes about fields that were left out."""
    if not isinstance(raw, Mapping) or not isinstance(raw.get("kind"), str):
        raise SpecError(f"a transform is an object whose kind is one of {', '.join(KINDS)}")
    kind, column = raw["kind"], raw.get("column")
    if kind not in KINDS:
        raise SpecError(f"{kind!r} is no transform; the kinds are {', '.join(KINDS)}, and none takes code")
    if not isinstance(column, str) or not column:
        raise SpecError("column must name one column")
    notes = ["placeholders are a fixed set; the field was ignored"] if "placeholders" in raw else []
    if kind in TARGETS:
        if raw.get("to") not in TARGETS[kind]:
            raise SpecError(f"to must be one of {', '.join(TARGETS[kind])} for {kind}")
        return TransformSpec(kind, column, to=raw["to"]), notes
    if kind == "normalisePhone":
        code = raw.get("defaultCountryCode")
        if raw.get("to") not in (None, "phoneE164"):
            raise SpecError("phones are only ever normalised to phoneE164")
        if not isinstance(code, str) or not re.fullmatch(r"\+?[0-9]{1,3}", code.strip()):
            raise SpecError("defaultCountryCode is required, such as +62; it is never guessed")
        return TransformSpec(kind, column, to="phoneE164", country_code=code.strip()), notes
    if kind == "padLeft":
        length, fill = raw.get("length"), raw.get("padWith", "0")
        if not whole(length) or not 0 < length <= MAX_PAD:
            raise SpecError(f"length must be a whole number from 1 to {MAX_PAD}")
        if not isinstance(fill, str) or not fill:
            raise SpecError("padWith must be a string of one character or more")
        return TransformSpec(kind, column, length=length, fill=fill), notes
    if kind == "maskColumn":
        keep = "none" if raw.get("keep") == "nothing" else raw.get("keep")
        if keep not in ("none", "lastFour", "domain"):
            raise SpecError("keep must be nothing, lastFour or domain")
        return TransformSpec(kind, column, keep=keep), notes
    return TransformSpec(kind, column), notes


def parse_rows(raw: Any) -> list[int] | None:
    """Sorted different row ids; None for every row."""
    if raw is None:
        return None
    if not isinstance(raw, (list, tuple)) or not raw:
        raise SpecError("rows must be a list of row ids; leave it out for every row")
    if not all(whole(r) and r >= 0 for r in raw):
        raise SpecError("row ids are whole numbers from 0")
    return sorted(set(raw))
