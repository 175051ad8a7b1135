"""The 25 named formats of a cell: 24 recognisers in order, and ``unrecognised``.

A recogniser is a condition on one string column, so classifying is one CASE
expression inside whole-stage codegen; what names a value many times binds it by
``text.let``, which is evaluated outside of it. Loops over groups are possessive:
others recurse in Java and overflow its stack on long cells. A pattern is only tried
where a cheap test that every match passes holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shapeguard.functions.text import WS, is_blank, let, trimmed

# One pattern for each format that a single whole-cell pattern decides.
PATTERNS = {
    "emailAddress": rf"[^{WS}@]+@[^{WS}@.]+(?:\.[^{WS}@.]+)++",
    "uuid": r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "timestampIso": r"(?i)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[T ][01][0-9]:[0-5][0-9](?::[0-5][0-9])?(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?",
    "dateIso": r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "dateDmySlash": r"(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/[0-9]{4}",
    "dateMdySlash": r"(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/[0-9]{4}",
    "dateDmyDot": r"(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.[0-9]{4}",
    "dateTextualMonth": r"(?i)[0-9]{1,2}[ -](?:jan|feb|mar|apr|may|mei|jun|jul|aug|agu|agt|sep|oct|okt|nov|nop|dec|des)[a-z]*[ -][0-9]{4}",
    "phoneE164": r"\+[1-9][0-9]{6,14}",
    "phoneLocalId": r"08[0-9]{1,2}[ -]?[0-9]{3,4}[ -]?[0-9]{4,5}",
    "phoneDigitsOnly": r"8[0-9]{9,12}",
    "currencyPrefixed": rf"(?i)(?:rp|idr|usd|\$|\x{{20AC}}|\x{{A3}})[{WS}]*-?(?:[0-9]+|[0-9]{{1,3}}(?:[.,][0-9]{{3}})++)(?:[.,][0-9]{{1,2}})?",
    "percentSuffixed": rf"-?[0-9]+(?:[.,][0-9]+)?[{WS}]*%",
    "decimalPoint": r"-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})++)\.[0-9]+",
    "decimalComma": r"-?(?:[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})++),[0-9]+",
    "digitsFixedLength": r"[0-9]{5,20}",
    "integerPlain": r"-?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})++)",
}

# Fixed value: the order in which recognisers are tried.
ORDER = (
    "blank emailAddress uuid timestampIso dateIso dateDmySlash dateMdySlash dateDmyDot dateTextualMonth phoneE164 phoneLocalId phoneDigitsOnly "
    "currencyPrefixed percentSuffixed decimalPoint decimalComma digitsFixedLength integerPlain alphanumericCode upperCase lowerCase titleCase "
    "singleWord multipleWords"
).split()
UNRECOGNISED = "unrecognised"
KNOWN = (*ORDER, UNRECOGNISED)

# Fixed value: cells that stand for nothing.
PLACEHOLDERS = ("n/a", "n.a.", "-", "--", "null", "nil", "none", "#n/a", "#value!", "tbd", "tba", "?", "??", "0000-00-00")

# Fixed value: month prefixes, English and Indonesian.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "agu": 8, "agt": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "nop": 11, "dec": 12, "des": 12,
}
DATES = ("timestampIso", "dateIso", "dateDmySlash", "dateMdySlash", "dateDmyDot", "dateTextualMonth")

#: What every match of a pattern has, told without a pattern.
NEEDS = {
    "emailAddress": lambda c: c.contains("@"),
    "uuid": lambda c: F.length(c) == 36,
    "timestampIso": lambda c: F.length(c) >= 16,
    "dateIso": lambda c: F.length(c) == 10,
    "dateDmySlash": lambda c: c.contains("/"),
    "dateMdySlash": lambda c: c.contains("/"),
    "dateDmyDot": lambda c: c.contains("."),
    "phoneE164": lambda c: c.startswith("+"),
    "phoneLocalId": lambda c: c.startswith("08"),
    "phoneDigitsOnly": lambda c: c.startswith("8"),
    "percentSuffixed": lambda c: c.endswith("%"),
    "decimalPoint": lambda c: c.contains("."),
    "decimalComma": lambda c: c.contains(","),
    "digitsFixedLength": lambda c: F.length(c).between(5, 20),
}

SIGNS = {
    "alphanumericCode": ((r"\A[A-Za-z0-9](?:[-A-Za-z0-9_/.]*[A-Za-z0-9])?\z", r"\p{L}", r"[0-9]"), (r"[-_/.]{2}",)),
    "upperCase": ((r"\p{Lu}",), (r"\p{Ll}",)),
    "lowerCase": ((r"\p{Ll}",), (r"\p{Lu}",)),
    "titleCase": (
        (rf"[^{WS}]",),
        (rf"(?:\A|[{WS}])[^\p{{L}}{WS}]+(?:[{WS}]|\z)", rf"(?:\A|[{WS}])[^\p{{L}}{WS}]*[\p{{Ll}}\p{{Lt}}]", rf"\p{{L}}[^{WS}]*[\p{{Lu}}\p{{Lt}}]"),
    ),
    "singleWord": ((rf"\A[^{WS}]+\z", r"\p{L}"), ()),
    "multipleWords": ((rf"[^{WS}][{WS}]+[^{WS}]", r"\p{L}"), ()),
}


def whole(pattern: str) -> str:
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return rf"{flag}\A(?:{rest})\z"


def matches(c: Column, name: str) -> Column:
    """Whether one recogniser alone accepts the cell (recognisers overlap)."""
    if name == "blank":
        return is_blank(c)
    if name == UNRECOGNISED:
        return classify(c) == UNRECOGNISED
    if name in SIGNS:
        has, lacks = SIGNS[name]
        return reduce(Column.__and__, [c.rlike(p) for p in has] + [~c.rlike(p) for p in lacks])
    hit = c.rlike(whole(PATTERNS[name]))
    return NEEDS[name](c) & hit if name in NEEDS else hit


def classify(c: Column) -> Column:
    """The first format that accepts the cell."""
    first, *rest = ORDER
    case = reduce(lambda acc, name: acc.when(matches(c, name), name), rest, F.when(matches(c, first), first))
    return case.otherwise(UNRECOGNISED)


def numeric(c: Column) -> Column:
    """The cell as a double where it is a plain, grouped, point or comma number; else null."""

    def text(t: Column) -> Column:
        point = F.replace(t, F.lit(","), F.lit(""))
        comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(matches(t, "decimalComma"), comma).when(matches(t, "decimalPoint") | matches(t, "integerPlain"), point)

    value = let(trimmed(c), text).try_cast("double")
    return let(value, lambda v: F.when(F.abs(v) < float("inf"), v))


def is_placeholder(c: Column) -> Column:
    return F.lower(trimmed(c)).isin(*PLACEHOLDERS)


def date_parts(c: Column, name: Column) -> Column:
    """struct<year, month, day> by position for a cell of a date format, else null."""
    return let(F.struct(trimmed(c).alias("t"), name.alias("name")), lambda b: _parts(b["t"], b["name"]))


def _parts(t: Column, name: Column) -> Column:

    def number(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    iso, parts, textual = r"\A([0-9]+)-([0-9]+)-([0-9]+)", r"\A([0-9]+)[/.]([0-9]+)[/.]([0-9]+)\z", r"\A([0-9]+)[ -]+[A-Za-z]+[ -]+([0-9]+)\z"
    prefix = F.lower(F.substring(F.regexp_extract(t, r"\A[0-9]+[ -]+([A-Za-z]+)", 1), 1, 3))
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])[prefix]

    def struct(year: Column, month_: Column, day: Column) -> Column:
        return F.struct(year.alias("year"), month_.alias("month"), day.alias("day"))

    return (
        F.when(name.isin("dateIso", "timestampIso"), struct(number(iso, 1), number(iso, 2), number(iso, 3)))
        .when(name.isin("dateDmySlash", "dateDmyDot"), struct(number(parts, 3), number(parts, 2), number(parts, 1)))
        .when(name == "dateMdySlash", struct(number(parts, 3), number(parts, 1), number(parts, 2)))
        .when((name == "dateTextualMonth") & month.isNotNull(), struct(number(textual, 2), month, number(textual, 1)))
    )


def is_real_date(p: Column) -> Column:
    """Gregorian, by arithmetic: ``make_date`` raises under ANSI rules."""

    def real(p: Column) -> Column:
        y, m, d = p["year"], p["month"], p["day"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return m.between(1, 12) & (d >= 1) & (d <= last)

    return let(p, real)


def day_number(p: Column) -> Column:
    """A number that orders dates."""
    return p["year"] * 10000 + p["month"] * 100 + p["day"]
