"""Text helpers whose results don't depend on Java's narrower ideas of white space and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every white-space character, for use inside a character class.
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

EDGES = rf"\A[{WS}]+|[{WS}]+\z"
INNER = rf"[{WS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    Catalyst has no bindings inside an expression: naming a long expression ten
    times plans it ten times. A one-element array's transform binds it."""
    return F.transform(F.array(value), body)[0]


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, EDGES, "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{WS}]")


def round3(c: Column) -> Column:
    """Three decimals, halves towards positive infinity."""
    return F.floor(c * 1000 + 0.5) / 1000


def rounded_metric(c: Column) -> Column:
    """Whole and very large numbers as they are, others at three decimals."""
    return F.when((c == F.floor(c)) | (F.abs(c) > 1e12), c).otherwise(round3(c))
