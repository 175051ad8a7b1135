"""Formats, profiles, aggregates, findings, duplicates and transforms."""

import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from shapeguard.functions.fold import fold, similarity
from shapeguard.functions.formats import classify, date_parts, is_placeholder, is_real_date, matches, numeric
from shapeguard.functions.mask import mask
from shapeguard.functions.text import round3, rounded_metric, trimmed
from shapeguard.operators import aggregate as agg
from shapeguard.operators import dedupe, issues, profile, transforms
from shapeguard.sources.fixture import generated, messy
from shapeguard.sources.table import as_strings, numbered, quoted
from shapeguard.types import ROW_ID, TransformSpec

SF = "/root/testdata/sf0.001"


def cells(spark, values):
    return spark.createDataFrame(list(enumerate(values)), f"{ROW_ID} long, c string")


def mapped(spark, values, *columns):
    return [tuple(r)[1:] for r in cells(spark, values).select(ROW_ID, *columns).orderBy(ROW_ID).collect()]


CLASSES = {
    "": "blank", " \t　": "blank", "a.wijaya@example.co.id": "emailAddress", "a@b": "lowerCase",
    "123E4567-e89b-12d3-a456-426614174000": "uuid", "2026-08-27T10:00:00Z": "timestampIso", "2026-08-27 08:30": "timestampIso",
    "2026-08-27 20:30:00": "unrecognised", "2026-08-27": "dateIso", "2026-13-01": "unrecognised", "03/04/2026": "dateDmySlash", "12/31/2026": "dateMdySlash",
    "27.8.2026": "dateDmyDot", "27 Agu 2026": "dateTextualMonth", "1-August-2026": "dateTextualMonth", "+6281234567890": "phoneE164",
    "0812-1000-0002": "phoneLocalId", "81234567890": "phoneDigitsOnly", "Rp 1.250.000,00": "currencyPrefixed", "€5": "currencyPrefixed",
    "12,5 %": "percentSuffixed", "1,234.56": "decimalPoint", "1.234,56": "decimalComma", "12345": "digitsFixedLength", "007": "integerPlain", "-1,234": "decimalComma", "-1,234,567": "integerPlain",
    "INV-2026/001": "alphanumericCode", "1-URGENT": "alphanumericCode", "4-NOT SPECIFIED": "upperCase", "N/A": "upperCase", "ani": "lowerCase",
    "Customer#000000001": "titleCase", "Ani ": "titleCase", "McDonald": "singleWord", "PT. Sumber Jaya": "multipleWords", "한국": "titleCase",
    "2026-08-27\n": "unrecognised", "--": "unrecognised", "###": "unrecognised",
}


def test_classes(spark):
    got = mapped(spark, list(CLASSES), classify(F.col("c")))
    assert dict(zip(CLASSES, (g[0] for g in got), strict=True)) == CLASSES


def test_long_cells_do_not_end_the_jvm(spark):
    long = ["a.b@" + "c." * 40000, "1" * 60000, "Word " * 20000, "1,234" * 10000, "a-" * 40000]
    assert len(mapped(spark, long, classify(F.col("c")), numeric(F.col("c")), mask(F.col("c")))) == 5


def test_recognisers_overlap(spark):
    assert mapped(spark, ["03/04/2026", "12345"], *[matches(F.col("c"), n) for n in ("dateDmySlash", "dateMdySlash", "integerPlain")]) == [(True, True, False), (False, False, True)]


def test_numbers_dates_and_placeholders(spark):
    values = [" 1.234,5 ", "1,234.5", "-7", "12%", "1e5", "+3", "Rp 5", "0,5", "1" * 400]
    assert [r[0] for r in mapped(spark, values, numeric(F.col("c")))] == [1234.5, 1234.5, -7.0, None, None, None, None, 0.5, None]
    days = ["29/02/2024", "29/02/2023", "31 Des 2025", "2026-04-31", "x"]
    p = date_parts(F.col("c"), classify(F.col("c")))
    assert [(r[0] and tuple(r[0]), r[1]) for r in mapped(spark, days, p, is_real_date(p))] == [((2024, 2, 29), True), ((2023, 2, 29), False), ((2025, 12, 31), True), ((2026, 4, 31), False), (None, None)]
    assert [r[0] for r in mapped(spark, [" N/A ", "TBD", "", "none.", "??"], is_placeholder(F.col("c")))] == [True, True, False, False, True]


def test_text_helpers(spark):
    assert mapped(spark, [" 　x y﻿"], trimmed(F.col("c"))) == [("x y",)]
    own = spark.createDataFrame([(0.0005,), (-0.0005,), (2.5,), (2e12 + 0.12345,)], "x double")
    assert [tuple(r) for r in own.select(round3(F.col("x")), rounded_metric(F.col("x"))).collect()][:3] == [(0.001, 0.001), (0.0, 0.0), (2.5, 2.5)]


def test_masks_hide_values(spark):
    shown = {"Ahmad Fauzi": "Aaaaa Aaaaa", "+6281234567890": "+0000000000000", "27/08/2026": "00/00/0000", "Éloïse Ç": "Aaaaaa A", "é": "a", "한국 x1": "xx a0"}
    assert [r[0] for r in mapped(spark, list(shown), mask(F.col("c")))] == list(shown.values())


def test_folds_and_similarity(spark):
    values = ["PT. Sumber Jaya", "0812-1000-0002", "  É\tX ", "é", "***"]
    assert [r[0] for r in mapped(spark, values, fold(F.col("c")))] == ["pt sumber jaya", "081210000002", "é x", "é", ""]
    rows = spark.createDataFrame([("abc", "abc"), ("", ""), ("a", ""), ("abcdefghij", "abcdefghix"), ("kitten", "sitting")], "a string, b string")
    assert [r[0] for r in rows.select(similarity(F.col("a"), F.col("b"), 0.9)).collect()] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert [round(r[0], 3) for r in rows.select(similarity(F.col("a"), F.col("b"), 0.5)).collect()][3:] == [0.9, 0.571]


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(5)
    assert [(r["x"], r[ROW_ID]) for r in numbered(df, [F.col("x")]).orderBy("x").collect()] == [(i, i) for i in range(1000)]
    many = numbered(spark.range(60000).select((F.col("id") * 7919 % 60000).alias("x")).repartition(6), [F.col("x")])
    assert many.where(F.col("x") != F.col(ROW_ID)).count() == 0  # sampled bounds
    assert numbered(df.limit(0), [F.col("x")]).count() == 0


def test_types_and_distinct_counts(spark):
    n = 1200
    rows = [(i, str(i), f"{i}.5", "ya" if i % 2 else "no", "", "x" if i < 600 else str(i), f"K{i:05}") for i in range(n)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, a string, b string, c string, d string, `e.f` string, g string")
    names = ["a", "b", "c", "d", "e.f", "g"]
    got = {r["column"]: r for r in profile.describe(df, names).collect()}
    assert [got[c]["value_type"] for c in names] == ["integer", "decimal", "boolean", "empty", "text", "text"]
    assert got["a"]["is_unique_marker"] and got["a"]["distinct_count"] is None and got["c"]["distinct_count"] == 2
    assert got["d"]["empty_count"] == n and got["d"]["distinct_count"] == 0
    assert {r["column"] for r in profile.unique_columns(df, names).collect()} == {"a", "b", "g"}


def test_buckets_keep_totals(spark):
    df = messy(spark, SF)
    for k in (3, 100, 400):
        rows = profile.format_buckets(df, "joined", k).collect()
        assert all(r["count"] >= k or r["format"] != "unrecognised" for r in rows)
        assert sum(r["count"] for r in rows) <= 1500 and (k > 3 or sum(r["count"] for r in rows) == 1500)


def test_answers_do_not_depend_on_partitions(spark):
    df = messy(spark, SF)
    for run in (
        lambda x: profile.format_buckets(x, "joined", 5),
        lambda x: agg.aggregate(x, "city", "mean", "amount", 5),
        lambda x: issues.summary(issues.findings(x, ["code"], 5)),
        lambda x: dedupe.find_duplicates(x, ["name", "phone"]),
    ):
        one, many = (sorted(map(str, run(x).collect())) for x in (df.repartition(1), df.orderBy(F.rand(1)).repartition(8)))
        assert one == many


def test_metrics_are_withheld(spark):
    rows = [(i, "Jakarta", "5" if i == 0 else "") for i in range(6)] + [(6 + i, "Bandung", str(i)) for i in range(6)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, city string, salary string")
    value = lambda fn, k: {r["group_key"]: r["value"] for r in agg.aggregate(df, "city", fn, "salary", k).collect()}
    assert value("mean", 5) == {"Jakarta": None, "Bandung": 2.5} and value("max", 5) == {"Jakarta": None, "Bandung": None}
    assert value("max", 3) == {"Jakarta": None, "Bandung": 5.0} and value("count", 5) == {"Jakarta": 6.0, "Bandung": 6.0}


def test_a_group_named_other_stays(spark):
    df = cells(spark, ["__other__"] * 6 + ["x"] * 2)
    assert {(r["group_key"], r["is_other"], r["row_count"]) for r in agg.aggregate(df, "c", "count", None, 5).collect()} == {("__other__", False, 6), (None, True, 2)}


def test_findings(spark):
    def codes(values, **more):
        return {r["code"]: r["affected_count"] for r in issues.summary(issues.findings(cells(spark, values), ["c"], 5, date(2027, 6, 30), **more)).collect()}

    assert codes([" a", "b ", "n/a", ""])["leadingWhitespace"] == 1
    found = codes(["2024-02-30", "2031-01-01", "2024-01-01"])
    assert found["impossibleDate"] == found["futureDate"] == 1
    assert codes(["1"] * 96 + ["x"] * 4)["nonNumericInNumericColumn"] == 4
    assert "nonNumericInNumericColumn" not in codes(["01"] * 96 + ["x"] * 4)
    assert codes([str(i % 7) for i in range(40)] + ["900"])["outOfRange"] == 1
    assert codes([f"K{i}" for i in range(19)] + ["K1"])["duplicateKey"] == 2
    assert codes(["Ani", "Ani ", "Budi"])["inconsistentCase"] == 2
    assert codes(["ab"] * 19 + ["abc"])["inconsistentLength"] == 1
    assert codes([]) == {}


def test_oversized_blocks_are_skipped(spark):
    df = cells(spark, ["same value"] * 12 + ["other thing", "other thinh"])
    rows = dedupe.folded(df, ["c"])
    assert {(r["a"], r["b"]) for r in dedupe.pairs(rows, 0.85, 10).collect()} == {(12, 13)}
    assert sorted(r["n"] for r in dedupe.skipped_blocks(rows, 10).collect()) == [12, 12]


CASES = [
    (TransformSpec("trimWhitespace", "c"), {" a ": "a", "  ": ""}),
    (TransformSpec("collapseSpaces", "c"), {"a 　b ": "a b ", "ab": "ab"}),
    (TransformSpec("changeCase", "c", to="title"), {"ani  o'BRIEN (budi) ": "Ani  O'brien (Budi) ", "": ""}),
    (TransformSpec("normaliseDate", "c", to="dateIso"), {"27/08/2026": "2026-08-27", "03/04/2026": None, "03/03/2026": None, "27 Agu 2026": "2026-08-27", " 2026-08-27": None, "30.2.2024": None, "": ""}),
    (TransformSpec("normaliseDate", "c", to="timestampIso"), {"2026-08-27 08:30:00": "2026-08-27T08:30:00", "27.08.2026": "2026-08-27T00:00:00", "27 Agu 2026": "2026-08-27T00:00:00"}),
    (TransformSpec("normalisePhone", "c", country_code="62"), {"0812-1000-0002": "+6281210000002", "0062 812 1000": "+628121000", "81210000002": "+6281210000002", "12": None, "+1 (202) 555.0100": "+12025550100"}),
    (TransformSpec("normaliseNumber", "c", to="decimalPoint"), {"1.234,50": "1234.50", "-1,234": "-1.234", "-1,234,567": "-1234567", "12345": None, "007": None, "0.5": "0.5", "x": None}),
    (TransformSpec("normaliseNumber", "c", to="integerPlain"), {"12.00": "12", "12.50": None}),
    (TransformSpec("padLeft", "c", length=6, fill="ab"), {"1234": "ab1234", "123": "aba123", "1234567": "1234567", "": ""}),
    (TransformSpec("replacePlaceholderWithEmpty", "c"), {" N/A ": "", "x": "x"}),
    (TransformSpec("maskColumn", "c", keep="lastFour"), {"081210000001": "********0001", "1234": None}),
    (TransformSpec("maskColumn", "c", keep="domain"), {"a.wijaya@example.co.id": "********@example.co.id", "@x": None, "x": None}),
    (TransformSpec("maskColumn", "c", keep="none"), {"añ😀": "***", " ": " "}),
    (TransformSpec("dropColumn", "c"), {"x": ""}),
]


@pytest.mark.parametrize("spec, want", CASES, ids=lambda x: getattr(x, "kind", ""))
def test_transforms(spark, spec, want):
    df = cells(spark, list(want))
    done = {r["cell"]: r for r in transforms.targeted(df, spec).collect()}
    for before, after in want.items():
        r = done[before]
        assert (r["value"], r["status"]) == ((before, "failed") if after is None else (after, "changed" if after != before or spec.kind == "dropColumn" else "unchanged")), before


@pytest.mark.parametrize("spec", [s for s, _ in CASES if s.kind != "dropColumn"], ids=lambda s: s.kind)
def test_dry_run_equals_commit_and_undo_is_exact(spark, spec):
    values = [v for _, w in CASES for v in w]
    df = cells(spark, values)
    n = transforms.report(transforms.targeted(df, spec)).first()
    after = transforms.commit(df, spec)
    changed = after.alias("a").join(df.alias("b"), ROW_ID).where(F.col("a.c") != F.col("b.c")).count()
    assert changed == n["changed"] and n["changed"] + n["unchanged"] + n["failed"] == len(values)
    back = transforms.undo(after, "c", transforms.previous_values(df, spec))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_long_row_lists_are_joined(spark):
    df, rows = cells(spark, ["a"] * 3000), list(range(0, 3000, 2))
    spec = TransformSpec("changeCase", "c", to="upper")
    assert transforms.commit(df, spec, rows).where("c = 'A'").count() == transforms.targeted(df, spec, rows).count() == 1500


def test_generated_rows_have_defects(spark):
    df = generated(spark, 2000)
    assert df.count() == 2000 and df.where(~(F.col("email") == trimmed(quoted("email")))).count() > 0
    assert generated(spark, 2000).exceptAll(df).count() == 0


def test_doubles_keep_their_digits(spark):
    values = [0.001234, 1e17, float("nan"), float("-inf"), 12.5, 3.0, -12345678.25, 1e-5, 1.5e-9, 1e300, 123456789012345680.0, 0.1 + 0.2, None, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_id long, x double")
    got = [r.x for r in as_strings(df).orderBy("_row_id").collect()]
    assert got[:5] == ["0.001234", "100000000000000000.0", "NaN", "-Infinity", "12.5"]
    assert got[5:8] == ["3.0", "-12345678.25", "0.00001"] and got[12:] == ["", "0.0"]
    assert all(float(t) == v for t, v in zip(got, values) if v is not None and v == v)
    assert as_strings(spark.createDataFrame([(0.5,)], "x float")).first().x == "0.5"


def test_long_cells_are_classified_by_the_same_rules(spark):
    cells = {"a@" + "b." * 50_000 + "c": "emailAddress", "1" + ",234" * 50_000: "integerPlain", "-1" + ".234" * 40_000 + ",5": "decimalComma", "1" + ",234" * 40_000 + ".5": "decimalPoint", "Rp 1" + ".234" * 40_000 + ",50": "currencyPrefixed"}
    df = spark.createDataFrame([(c, f) for c, f in cells.items()], "cell string, want string")
    assert df.where(classify(F.col("cell")) != F.col("want")).count() == 0


def test_quartiles_of_equal_and_different_numbers(spark):
    rng = random.Random(5)
    columns = {"zeros": [0.0] * 950 + [float(i) for i in range(50)], "many": [rng.gauss(0, 1) for _ in range(777)], "few": [float(rng.randint(0, 3)) for _ in range(64)], "short": [1.0] * 5}
    rows = spark.createDataFrame([(c, x) for c, xs in columns.items() for x in xs], "column string, x double")
    got = issues.fences(rows, {c: len(v) for c, v in columns.items()}, 5)
    want = {}
    for c in ("many", "few"):
        low, _, high = statistics.quantiles(columns[c], n=4, method="inclusive")
        want[c] = low - 3 * (high - low), high + 3 * (high - low)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for c in want for a, b in zip(got[c], want[c]))


def test_blocks_of_any_size_can_be_compared(spark):
    rng = random.Random(2)
    rows = [(i, "Ana " + "".join(rng.choices("abc", k=6))) for i in range(120)]
    df = spark.createDataFrame(rows, "_row_id long, name string")
    folded = dedupe.folded(df, ["name"])
    capped = {(r.a, r.b) for r in dedupe.pairs(folded, 0.85, limit=10).collect()}
    got = {(r.a, r.b): r.score for r in dedupe.pairs(folded, 0.85, limit=10, exact=True).collect()}
    names = {i: t.lower() for i, t in rows}
    keys = lambda t: {t[:2] + str(len(t) // 4), "s" + t[-4:]}

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            own = [i]
            for j, y in enumerate(b, 1):
                own.append(min(last[j] + 1, own[-1] + 1, last[j - 1] + (x != y)))
            last = own
        return last[-1]

    want = {(a, b) for a in names for b in names if a < b and keys(names[a]) & keys(names[b]) and distance(names[a], names[b]) <= 1}
    assert set(got) == want and capped < want and all(s in (0.9, 1.0) for s in got.values())
