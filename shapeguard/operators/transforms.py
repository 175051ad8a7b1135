"""The ten cleaning transforms as column expressions, dry runs, commits and undo.

A transform maps a cell to struct<value, status> with status unchanged, changed or
failed, so a dry run is one grouping and a commit one projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeguard.functions.formats import classify, date_parts, is_placeholder, is_real_date, matches
from shapeguard.functions.mask import GLYPH, mask
from shapeguard.functions.text import INNER, WS, is_blank, let, trimmed
from shapeguard.sources.table import quoted
from shapeguard.types import ROW_ID, TransformSpec

MAX_FAILED, MAX_EXAMPLES, KEPT_DIGITS, MAX_PAD = 10, 10, 4, 256
KINDS = (
    "trimWhitespace", "collapseSpaces", "changeCase", "normaliseDate", "normalisePhone", "normaliseNumber", "padLeft",
    "replacePlaceholderWithEmpty", "dropColumn", "maskColumn",
)
#: Row lists up to this length become a condition; longer ones are joined.
INLINE_ROWS = 1000


def outcome(c: Column, value: Column, ok: Column | None = None) -> Column:
    """``value`` where it is known and ``ok``; a null or refused value is a failure."""
    kept = value if ok is None else F.when(F.coalesce(ok, F.lit(False)), value)

    def told(v: Column) -> Column:
        status = F.when(v.isNull(), "failed").when(v == c, "unchanged").otherwise("changed")
        return F.struct(F.coalesce(v, c).alias("value"), status.alias("status"))

    return let(kept, told)


def unless_blank(c: Column, done: Column) -> Column:
    still = F.struct(c.alias("value"), F.lit("unchanged").alias("status"))
    return F.when(is_blank(c), still).otherwise(done)


def title(c: Column) -> Column:
    """Each word's first cased letter upper, the rest lower; white space stays."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"

    def word(w: Column) -> Column:
        head = F.regexp_extract(w, rf"\A([^{cased}]*)", 1)
        rest = F.substring(w, F.length(head) + 1, F.length(w))
        return F.concat(head, F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))

    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(rf"([{WS}]+|[^{WS}]+)"), 1), word), "")


def date(c: Column, to: str) -> Column:
    parted = let(classify(c), lambda name: F.struct(name.alias("name"), date_parts(c, name).alias("p")))
    return outcome(c, let(parted, lambda b: _date(c, b["name"], b["p"], to)))


def _date(c: Column, name: Column, p: Column, to: str) -> Column:
    ambiguous = matches(c, "dateDmySlash") & matches(c, "dateMdySlash")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    iso = F.concat_ws("-", pad(p["year"], 4), pad(p["month"], 2), pad(p["day"], 2))
    if to == "timestampIso":
        clock = F.regexp_extract(c, r"\A[^Tt ]*[T ](.*)\z", 1)
        iso = F.concat(iso, F.lit("T"), F.when((name == "timestampIso") & (clock != ""), clock).otherwise("00:00:00"))
    return F.when(p.isNotNull() & is_real_date(p) & ~ambiguous, iso)


def phone(c: Column, code: str) -> Column:
    code = code if code.startswith("+") else f"+{code}"

    def full(digits: Column) -> Column:
        after = lambda n: F.substring(digits, F.lit(n), F.length(digits))
        return (
            F.when(digits.startswith("+"), digits)
            .when(digits.startswith("00"), F.concat(F.lit("+"), after(3)))
            .when(digits.startswith("0"), F.concat(F.lit(code), after(2)))
            .when(digits.rlike(r"\A[1-9][0-9]{7,12}\z"), F.concat(F.lit(code), digits))
        )

    found = let(F.regexp_replace(trimmed(c), rf"[{WS}()./-]", ""), full)
    return outcome(c, let(found, lambda f: F.when(matches(f, "phoneE164"), f)))


def number(c: Column, to: str) -> Column:
    named = let(trimmed(c), lambda t: F.struct(t.alias("t"), classify(t).alias("name")))
    return outcome(c, let(named, lambda b: _number(b["t"], b["name"], to)))


def _number(t: Column, name: Column, to: str) -> Column:
    sign = F.when(t.startswith("-"), "-").otherwise("")
    body = F.regexp_replace(t, r"\A-", "")
    comma = F.regexp_replace(F.regexp_replace(body, r"\.", ""), ",", ".")
    plain = F.when(name == "decimalComma", comma).when(name.isin("decimalPoint", "integerPlain"), F.regexp_replace(body, ",", ""))
    return let(plain, lambda p: _digits(p, sign, to))


def _digits(plain: Column, sign: Column, to: str) -> Column:
    whole, fraction = F.substring_index(plain, ".", 1), F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
    ok = ~((F.length(whole) > 1) & whole.startswith("0"))
    if to == "integerPlain":
        return F.when(ok & ~fraction.rlike("[1-9]"), F.concat(sign, whole))
    return F.when(ok, F.concat(sign, whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise("")))


def masked(c: Column, keep: str) -> Column:
    hide = lambda n: F.repeat(F.lit(GLYPH), n.cast("int"))
    if keep == "none":
        return outcome(c, hide(F.length(c)))
    if keep == "lastFour":
        value = F.concat(hide(F.length(c) - KEPT_DIGITS), F.right(c, F.lit(KEPT_DIGITS)))
        return outcome(c, F.when(F.length(c) > KEPT_DIGITS, value))
    domain = F.substring_index(c, "@", -1)
    before = F.length(c) - F.length(domain) - 1
    return outcome(c, F.when(c.contains("@") & (before > 0), F.concat(hide(before), F.lit("@"), domain)))


def build(spec: TransformSpec, c: Column) -> Column:
    """struct<value, status> for a cell."""
    match spec.kind:
        case "trimWhitespace":
            return outcome(c, trimmed(c))
        case "collapseSpaces":
            return outcome(c, F.regexp_replace(c, INNER, " "))
        case "changeCase":
            return unless_blank(c, outcome(c, {"lower": F.lower(c), "upper": F.upper(c), "title": title(c)}[spec.to]))
        case "normaliseDate":
            return unless_blank(c, date(c, spec.to))
        case "normalisePhone":
            return unless_blank(c, phone(c, spec.country_code))
        case "normaliseNumber":
            return unless_blank(c, number(c, spec.to))
        case "padLeft":
            if not spec.fill or not spec.length or spec.length <= 0:
                return unless_blank(c, outcome(c, F.lit(None).cast("string")))
            return unless_blank(c, outcome(c, F.when(F.length(c) >= spec.length, c).otherwise(F.lpad(c, spec.length, spec.fill))))
        case "replacePlaceholderWithEmpty":
            return outcome(c, F.when(is_placeholder(c), "").otherwise(c))
        case "dropColumn":
            return F.struct(F.lit("").alias("value"), F.lit("changed").alias("status"))
        case "maskColumn":
            return unless_blank(c, masked(c, spec.keep))
    raise ValueError(f"unknown transform {spec.kind}")


def targeted(df: DataFrame, spec: TransformSpec, rows: Sequence[int] | None = None) -> DataFrame:
    """_row_id, cell, value, status for the chosen rows."""
    own = df.select(ROW_ID, quoted(spec.column).alias("cell"))
    if rows is not None:
        chosen = sorted(set(rows))
        if len(chosen) <= INLINE_ROWS:
            own = own.where(F.col(ROW_ID).isin(*chosen))
        else:
            own = own.join(df.sparkSession.createDataFrame([(r,) for r in chosen], f"{ROW_ID} long"), ROW_ID, "left_semi")
    return own.withColumn("t", build(spec, F.col("cell"))).select(ROW_ID, "cell", "t.value", "t.status")


def report(done: DataFrame) -> DataFrame:
    """One row: unchanged, changed, failed."""
    return done.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "changed", "failed")])


def failed_rows(done: DataFrame) -> DataFrame:
    return done.where("status = 'failed'").select(ROW_ID).orderBy(ROW_ID).limit(MAX_FAILED)


def examples(done: DataFrame) -> DataFrame:
    """The first ten different masked pairs, in row order."""
    pairs = done.where("status = 'changed'").select(ROW_ID, mask(F.col("cell")).alias("from"), mask(F.col("value")).alias("to")).where("`from` <> `to`")
    return pairs.groupBy("from", "to").agg(F.min(ROW_ID).alias("first_row")).orderBy("first_row").limit(MAX_EXAMPLES)


def commit(df: DataFrame, spec: TransformSpec, rows: Sequence[int] | None = None) -> DataFrame:
    """The table with changed cells in place; failed and unchanged cells stay."""
    if spec.kind == "dropColumn":
        return df.drop(quoted(spec.column))
    c = quoted(spec.column)
    t = build(spec, c)
    chosen = F.lit(True)
    if rows is not None and len(set(rows)) > INLINE_ROWS:
        picked = df.sparkSession.createDataFrame([(r,) for r in sorted(set(rows))], "__row long").withColumn("__hit", F.lit(True))
        df, chosen = df.join(picked, F.col(ROW_ID) == F.col("__row"), "left").drop("__row"), F.coalesce(F.col("__hit"), F.lit(False))
    elif rows is not None:
        chosen = F.col(ROW_ID).isin(*sorted(set(rows)))
    return df.withColumn(spec.column, F.when(chosen, t["value"]).otherwise(c)).drop("__hit")  # an unchanged or failed cell's value is itself


def previous_values(df: DataFrame, spec: TransformSpec, rows: Sequence[int] | None = None) -> DataFrame:
    """(_row_id, previous) of what a commit changes: all that an undo needs."""
    return targeted(df, spec, rows).where("status = 'changed'").select(ROW_ID, F.col("cell").alias("previous"))


def undo(df: DataFrame, column: str, previous: DataFrame) -> DataFrame:
    """The table with the recorded cells put back."""
    back = previous.select(F.col(ROW_ID).alias("__row"), "previous")
    joined = df.join(back, F.col(ROW_ID) == F.col("__row"), "left")
    return joined.withColumn(column, F.coalesce(F.col("previous"), quoted(column))).select(df.columns)
