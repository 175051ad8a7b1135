"""DuckDB SQL for the same expressions, to check results with another engine."""

from __future__ import annotations

from shapeguard.functions.formats import MONTHS, ORDER, PATTERNS, PLACEHOLDERS, SIGNS, whole
from shapeguard.functions.mask import accents
from shapeguard.functions.text import EDGES, WS
from shapeguard.sources.fixture import MESSY_SQL


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def replaced(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def trimmed(x: str) -> str:
    return replaced(x, EDGES)


def blank(x: str) -> str:
    return f"NOT {hit(x, f'[^{WS}]')}"


def matches(x: str, name: str) -> str:
    if name == "blank":
        return f"({blank(x)})"
    if name == "unrecognised":
        return f"({classify(x)} = 'unrecognised')"
    if name in SIGNS:
        has, lacks = SIGNS[name]
        return "(" + " AND ".join([hit(x, p) for p in has] + [f"NOT {hit(x, p)}" for p in lacks]) + ")"
    return f"({hit(x, whole(PATTERNS[name]).replace(')++', ')+'))})"  # possessive loops are a matter of Java's stack only


def classify(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {matches(x, n)} THEN '{n}'" for n in ORDER) + " ELSE 'unrecognised' END"


def numeric(x: str) -> str:
    t = trimmed(x)
    return (
        f"CASE WHEN {matches(t, 'decimalComma')} THEN TRY_CAST(replace(replace({t}, '.', ''), ',', '.') AS DOUBLE) "
        f"WHEN {matches(t, 'decimalPoint')} OR {matches(t, 'integerPlain')} THEN TRY_CAST(replace({t}, ',', '') AS DOUBLE) END"
    )


def placeholder(x: str) -> str:
    return f"lower({trimmed(x)}) IN ({', '.join(map(lit, PLACEHOLDERS))})"


def part(x: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({trimmed(x)}, {lit(pattern)}, {group}) AS INTEGER)"


def dates(source: str, column: str) -> str:
    """A SELECT of row_id, cell, format, year, month, day and whether the date is real."""
    iso, marks = r"^([0-9]+)-([0-9]+)-([0-9]+)", r"^([0-9]+)[/.]([0-9]+)[/.]([0-9]+)$"
    words = r"^([0-9]+)[ -]+([A-Za-z]+)[ -]+([0-9]+)$"
    months = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MONTHS.items())
    month = f"CASE lower(substr(regexp_extract({trimmed('cell')}, {lit(words)}, 2), 1, 3)) {months} END"
    year = f"CASE WHEN format IN ('dateIso', 'timestampIso') THEN {part('cell', iso, 1)} WHEN format IN ('dateDmySlash', 'dateDmyDot', 'dateMdySlash') THEN {part('cell', marks, 3)} WHEN format = 'dateTextualMonth' THEN {part('cell', words, 3)} END"
    mon = f"CASE WHEN format IN ('dateIso', 'timestampIso') THEN {part('cell', iso, 2)} WHEN format IN ('dateDmySlash', 'dateDmyDot') THEN {part('cell', marks, 2)} WHEN format = 'dateMdySlash' THEN {part('cell', marks, 1)} WHEN format = 'dateTextualMonth' THEN {month} END"
    day = f"CASE WHEN format IN ('dateIso', 'timestampIso') THEN {part('cell', iso, 3)} WHEN format IN ('dateDmySlash', 'dateDmyDot') THEN {part('cell', marks, 1)} WHEN format = 'dateMdySlash' THEN {part('cell', marks, 2)} WHEN format = 'dateTextualMonth' THEN {part('cell', words, 1)} END"
    leap = "((year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0)"
    last = f"CASE WHEN month = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END WHEN month IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    return (
        f"SELECT *, (month BETWEEN 1 AND 12 AND day >= 1 AND day <= {last}) AS is_real FROM (SELECT *, {year} AS year, {mon} AS month, {day} AS day "
        f"FROM (SELECT row_id, {column} AS cell, {classify(column)} AS format FROM {source}))"
    )


def mask(x: str) -> str:
    a, b = accents()
    out = replaced(f"translate({replaced(x, r'\p{M}')}, {lit(a)}, {lit(b)})", "[0-9]", "0")
    for letters, glyph in (("[a-z]", "a"), ("[A-Z]", "A"), (r"[^\P{L}A-Za-z]", "x")):
        out = replaced(out, letters, glyph)
    return out


def fold(x: str) -> str:
    kept = replaced(replaced(f"lower({x})", f"[{WS}]", " "), r"[^\p{L}\p{N} ]")
    return f"trim({replaced(kept, ' +', ' ')})"


def similarity(a: str, b: str, floor: float) -> str:
    longest = f"greatest(length({a}), length({b}))"
    allowed = f"floor(CAST({longest} AS DOUBLE) * (1.0::DOUBLE - {floor}::DOUBLE))"
    score = f"floor((1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / {longest}) * 1000 + 0.5) / 1000"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN levenshtein({a}, {b}) <= {allowed} THEN {score} ELSE 0.0::DOUBLE END"


def with_messy(rest: str) -> str:
    return f"WITH messy AS ({MESSY_SQL}), {rest}" if not rest.lstrip().upper().startswith("SELECT") else f"WITH messy AS ({MESSY_SQL}) {rest}"


def buckets(source: str, column: str, k: int) -> str:
    """CTEs ending in ``b``: format, count, share, truncated."""
    return (
        f"c0 AS (SELECT {classify(column)} AS format, count(*) AS n FROM {source} WHERE NOT ({blank(column)}) GROUP BY 1), "
        f"c1 AS (SELECT *, n >= {k} AND sum(CASE WHEN n >= {k} THEN 1 ELSE 0 END) OVER (ORDER BY n DESC, format ROWS UNBOUNDED PRECEDING) <= 8 AS kept, sum(n) OVER () AS all_n FROM c0), "
        "c2 AS (SELECT *, count(*) FILTER (NOT kept) OVER () > 0 AS truncated FROM c1), "
        "c3 AS (SELECT CASE WHEN kept THEN format ELSE 'unrecognised' END AS format, sum(n) AS n, bool_or(kept) AS named, max(all_n) AS all_n, bool_or(truncated) AS truncated FROM c2 GROUP BY 1), "
        f"b AS (SELECT format, CAST(n AS BIGINT) AS count, floor(n::DOUBLE / all_n * 1000 + 0.5) / 1000 AS share, truncated FROM c3 WHERE named OR n >= {k})"
    )


def aggregate(source: str, by: str, fn: str, over: str | None, k: int, where: str = "TRUE") -> str:
    """A SELECT of group_key, is_other, row_count, group_count, value, suppressed."""
    x = numeric(over) if over else "NULL::DOUBLE"
    value, shown = {
        "count": ("n::DOUBLE", "TRUE"),
        "sum": ("total", f"numbers >= {k}"),
        "mean": ("total / numbers", f"numbers >= {k}"),
        "min": ("least", f"numbers >= {2 * k} AND n >= {2 * k}"),
        "max": ("most", f"numbers >= {2 * k} AND n >= {2 * k}"),
    }[fn]
    rounded = f"CASE WHEN {value} = floor({value}) OR abs({value}) > 1e12 THEN {value} ELSE floor({value} * 1000 + 0.5) / 1000 END"
    return (
        f"g0 AS (SELECT {by} AS group_key, {x} AS x FROM {source} WHERE {where}), "
        "g1 AS (SELECT group_key, count(*) AS n, count(x) AS numbers, CAST(sum(CAST(x AS DECIMAL(38,9))) AS DOUBLE) AS total, min(x) AS least, max(x) AS most FROM g0 GROUP BY 1), "
        f"g2 AS (SELECT * FROM g1 WHERE n >= {k} ORDER BY n DESC, group_key LIMIT 25), "
        "g3 AS (SELECT (SELECT count(*) FROM g1) - (SELECT count(*) FROM g2) AS g, (SELECT coalesce(sum(n), 0) FROM g1) - (SELECT coalesce(sum(n), 0) FROM g2) AS r) "
        f"SELECT group_key, FALSE AS is_other, CAST(n AS BIGINT) AS row_count, 1::BIGINT AS group_count, CASE WHEN {shown} THEN {rounded} END AS value, (CASE WHEN {shown} THEN {value} END) IS NULL AS suppressed FROM g2 "
        "UNION ALL SELECT NULL, TRUE, CAST(r AS BIGINT), CAST(g AS BIGINT), NULL, FALSE FROM g3 WHERE g > 0"
    )
