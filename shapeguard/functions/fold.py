"""Folding and similarity for near-duplicate rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from shapeguard.functions.text import WS, let, round3


@pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Composed form, which Spark has no builtin for; all-ASCII batches pass through."""
    for s in batches:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def fold(c: Column, ascii_only: bool = False) -> Column:
    """Lower case letters, digits and single spaces. ``ascii_only``: the caller
    vouches for it, so composing is left out and the expression stays in the JVM."""
    text = c if ascii_only else nfc(c)
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), rf"[{WS}]", " "), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def similarity(a: Column, b: Column, floor: float) -> Column:
    """1 - distance / longer length at three decimals; 0 past the distance that the
    floor allows, worked out in doubles (so 10 characters at 0.9 allow none)."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _similarity(s["a"], s["b"], floor))


def _similarity(a: Column, b: Column, floor: float) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    allowed = F.floor(longest.cast("double") * F.lit(1.0 - floor))
    near = F.abs(F.length(a) - F.length(b)) <= allowed

    def scored(distance: Column) -> Column:
        return F.when(distance <= allowed, round3(1 - distance.cast("double") / longest)).otherwise(0.0)

    score = F.when(near, let(F.levenshtein(a, b), scored)).otherwise(0.0)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(score)


def block_keys(joined: Column) -> Column:
    """Two keys: beginning with a length class, and ending."""
    return let(joined, _block_keys)


def _block_keys(joined: Column) -> Column:
    head = F.concat(F.lit("p:"), F.substring(joined, 1, 2), F.lit(":"), F.floor(F.length(joined) / 4).cast("string"))
    return F.array(head, F.concat(F.lit("s:"), F.right(joined, F.lit(4))))
