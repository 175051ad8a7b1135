"""Every operator as a query over the given tables, each with its DuckDB counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeguard import duck
from shapeguard.functions import fold as folding
from shapeguard.functions.formats import classify, date_parts, is_real_date, numeric
from shapeguard.functions.mask import mask
from shapeguard.functions.text import WS, is_blank
from shapeguard.guard import GuardConfig
from shapeguard.operators import aggregate as agg
from shapeguard.operators import dedupe, issues, profile, transforms
from shapeguard.plans.predicate import compile_query, matching_rows
from shapeguard.session import People, Session
from shapeguard.sources import csv as csv_source
from shapeguard.sources.fixture import messy
from shapeguard.sources.shared import shared_folder, spread
from shapeguard.sources.table import as_strings, from_dataframe, quoted
from shapeguard.types import ROW_ID, Condition, Query, TransformSpec

K = 5
AS_OF = date(2027, 6, 30)
COLUMNS = ["name", "phone", "email", "city", "joined", "amount", "notes", "code"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    own = spark.read.parquet(f"{sf}/{name}.parquet")
    return as_strings(spread(own.select(*columns) if columns else own))


def public(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed(ROW_ID, "row_id")


# --- formats

add(
    "format_buckets",
    lambda s, d: profile.format_buckets(table(s, d, "orders", "o_orderpriority"), "o_orderpriority", K),
    f"WITH {duck.buckets('orders', 'o_orderpriority', K)} SELECT * FROM b",
)
add(
    "format_buckets_folded",
    lambda s, d: profile.format_buckets(messy(s, d), "joined", 100),
    duck.with_messy(duck.buckets("messy", "joined", 100) + " SELECT * FROM b"),
)


def classify_all(s: SparkSession, d: str) -> DataFrame:
    cells = profile.long_form(messy(s, d), COLUMNS)
    return cells.groupBy(F.col("column").alias("column_name"), classify(F.col("cell")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


add(
    "format_classify_all",
    classify_all,
    duck.with_messy(
        "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS cell FROM messy" for c in COLUMNS) + ") "
        f"SELECT column_name, {duck.classify('cell')} AS format, count(*) AS n FROM l GROUP BY 1, 2"
    ),
)
add(
    "format_samples",
    lambda s, d: public(profile.format_samples(messy(s, d), "joined", K)).select("format", "raw_format", "rank", "row_id"),
    duck.with_messy(
        duck.buckets("messy", "joined", K) + f", s AS (SELECT row_id, {duck.classify('joined')} AS raw_format FROM messy WHERE NOT ({duck.blank('joined')})), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY raw_format ORDER BY row_id) AS INTEGER) AS rank FROM s), "
        "n AS (SELECT coalesce(b.format, 'unrecognised') AS format, raw_format, rank, row_id FROM r LEFT JOIN b ON r.raw_format = b.format WHERE rank <= 16) "
        "SELECT n.* FROM n WHERE format IN (SELECT format FROM b)"
    ),
)
add(
    "numeric_values",
    lambda s, d: public(messy(s, d).select(ROW_ID, numeric(F.col("amount")).alias("value"))),
    duck.with_messy(f"SELECT row_id, {duck.numeric('amount')} AS value FROM messy"),
)


def parts_of_dates(s: SparkSession, d: str) -> DataFrame:
    p = date_parts(F.col("joined"), classify(F.col("joined")))
    own = messy(s, d).select(ROW_ID, p.alias("p")).where("p IS NOT NULL")
    return public(own.select(ROW_ID, "p.year", "p.month", "p.day", is_real_date(F.col("p")).alias("is_real")))


add("date_parts", parts_of_dates, duck.with_messy(f"d AS ({duck.dates('messy', 'joined')}) SELECT row_id, year, month, day, is_real FROM d WHERE year IS NOT NULL"))

# --- predicates


def counted(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n, hidden = agg.reported(F.col("n"), K)
        total = messy(s, d).agg(F.count_if(compile_query(query)).alias("n"))
        return total.select(n.alias("matched"), hidden.alias("suppressed"))

    return run


def counted_sql(where: str) -> str:
    return duck.with_messy(f"c AS (SELECT count(*) AS n FROM messy WHERE {where}) SELECT CASE WHEN n = 0 OR n >= {K} THEN n END AS matched, n > 0 AND n < {K} AS suppressed FROM c")


PREDICATES = {
    "count_equals": (Query((Condition("equals", "city", value="Bandung"),)), "city = 'Bandung'"),
    "count_suppressed": (Query((Condition("equals", "city", value="Manado"),)), "city = 'Manado'"),
    "count_is_empty": (Query((Condition("isEmpty", "email"),)), duck.blank("email")),
    "count_matches_format": (Query((Condition("matchesFormat", "joined", format="dateMdySlash"),)), duck.matches("joined", "dateMdySlash")),
    "count_unrecognised": (Query((Condition("matchesFormat", "joined", format="unrecognised"),)), duck.matches("joined", "unrecognised")),
    "count_compare": (Query((Condition("compare", "amount", value=100000.0, op=">="),)), f"coalesce({duck.numeric('amount')} >= 100000, FALSE)"),
    "count_length_between": (Query((Condition("lengthBetween", "name", min=9, max=11),)), "length(name) BETWEEN 9 AND 11"),
    "count_all": (
        Query((Condition("equals", "city", value="Mataram"), Condition("compare", "amount", value=5000.0, op="<"), Condition("matchesFormat", "phone", format="phoneE164"))),
        f"city = 'Mataram' AND coalesce({duck.numeric('amount')} < 5000, FALSE) AND {duck.matches('phone', 'phoneE164')}",
    ),
    "count_any": (
        Query((Condition("isEmpty", "email"), Condition("matchesFormat", "joined", format="upperCase"), Condition("lengthBetween", "notes", min=1, max=99)), "any"),
        f"({duck.blank('email')}) OR {duck.matches('joined', 'upperCase')} OR length(notes) BETWEEN 1 AND 99",
    ),
}
for name, (query, where) in PREDICATES.items():
    add(name, counted(query), counted_sql(where))
add(
    "evaluate_row_ids",
    lambda s, d: public(matching_rows(messy(s, d), PREDICATES["count_all"][0])),
    duck.with_messy(f"SELECT row_id FROM messy WHERE {PREDICATES['count_all'][1]}"),
)

# --- aggregates and cross tables

for fn in agg.METRICS:
    add(
        f"agg_{fn}",
        lambda s, d, fn=fn: agg.aggregate(messy(s, d), "city", fn, "amount" if fn != "count" else None, K),
        duck.with_messy(duck.aggregate("messy", "city", fn, "amount" if fn != "count" else None, K)),
    )
    money = "CAST(o_totalprice AS VARCHAR)"
    add(
        f"agg_{fn}_orders",
        lambda s, d, fn=fn: agg.aggregate(table(s, d, "orders", "o_orderpriority", "o_totalprice"), "o_orderpriority", fn, "o_totalprice" if fn != "count" else None, K),
        "WITH " + duck.aggregate("orders", "o_orderpriority", fn, money if fn != "count" else None, K),
    )
add(
    "agg_other_bucket",
    lambda s, d: agg.aggregate(table(s, d, "part", "p_name"), "p_name", "count", None, K),
    "WITH " + duck.aggregate("part", "p_name", "count", None, K),
)
FILTER = Query((Condition("matchesFormat", "phone", format="phoneE164"),))
add(
    "agg_filtered",
    lambda s, d: agg.aggregate(messy(s, d), "city", "mean", "amount", K, compile_query(FILTER)),
    duck.with_messy(duck.aggregate("messy", "city", "mean", "amount", K, duck.matches("phone", "phoneE164"))),
)
add(
    "agg_suppressed_extremes",
    lambda s, d: agg.aggregate(messy(s, d), "city", "max", "amount", 3, compile_query(Query((Condition("lengthBetween", "name", min=1, max=99),)))),
    duck.with_messy(duck.aggregate("messy", "city", "max", "amount", 3, "length(name) BETWEEN 1 AND 99")),
)


def crosstab_sql(source: str, a: str, b: str, k: int) -> str:
    def axis(x: str, name: str) -> str:
        return f"{name} AS (SELECT {x} AS {name} FROM {source} GROUP BY 1 HAVING count(*) >= {k} ORDER BY count(*) DESC, 1 LIMIT 12)"

    return (
        f"{axis(a, 'row_key')}, {axis(b, 'column_key')}, j AS (SELECT {a} AS r, {b} AS c, count(*) AS n FROM {source} GROUP BY 1, 2) "
        f"SELECT row_key, column_key, CASE WHEN coalesce(n, 0) = 0 OR n >= {k} THEN coalesce(n, 0) END AS count, coalesce(n, 0) > 0 AND coalesce(n, 0) < {k} AS suppressed "
        "FROM row_key CROSS JOIN column_key LEFT JOIN j ON r = row_key AND c = column_key"
    )


add(
    "crosstab_cells",
    lambda s, d: agg.crosstab(table(s, d, "lineitem", "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", K),
    "WITH " + crosstab_sql("lineitem", "l_returnflag", "l_linestatus", K),
)


def by_weekday(s: SparkSession, d: str) -> DataFrame:
    own = s.read.parquet(f"{d}/events.parquet").select("event_type", F.dayofweek("ts").alias("weekday"))
    return agg.crosstab(as_strings(own), "event_type", "weekday", K)


add("crosstab_events", by_weekday, "WITH e AS (SELECT event_type, CAST(dayofweek(ts) + 1 AS VARCHAR) AS weekday FROM events), " + crosstab_sql("e", "event_type", "weekday", K))
add(
    "crosstab_suppressed",
    lambda s, d: agg.crosstab(messy(s, d).withColumn("format", classify(F.col("joined"))), "city", "format", 3),
    duck.with_messy(f"e AS (SELECT city, {duck.classify('joined')} AS format FROM messy), " + crosstab_sql("e", "city", "format", 3)),
)
add(
    "suppressed_counts",
    lambda s, d: messy(s, d).groupBy("city").agg(F.count(F.lit(1)).alias("n")).select("city", *[c.alias(a) for c, a in zip(agg.reported(F.col("n"), K), ("reported", "suppressed"), strict=True)]),
    duck.with_messy(f"g AS (SELECT city, count(*) AS n FROM messy GROUP BY 1) SELECT city, CASE WHEN n >= {K} THEN n END AS reported, n < {K} AS suppressed FROM g"),
)

# --- profiles

LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS i, row_id, {c} AS cell FROM messy" for i, c in enumerate(COLUMNS)) + ")"
TYPES = (
    f"f0 AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY row_id) AS pos FROM l WHERE NOT ({duck.blank('cell')})), "
    f"f1 AS (SELECT *, {duck.classify('cell')} AS f, lower({duck.trimmed('cell')}) AS w FROM f0 WHERE pos <= 500), "
    f"f2 AS (SELECT column_name, count(*) AS n, count(*) FILTER (w IN ({', '.join(map(duck.lit, profile.BOOLEAN_WORDS))})) AS bo, count(*) FILTER (f = 'integerPlain') AS it, "
    "count(*) FILTER (f IN ('decimalPoint', 'decimalComma')) AS de, count(*) FILTER (f LIKE 'date%' OR f = 'timestampIso') AS da FROM f1 GROUP BY 1), "
    "types AS (SELECT column_name, CASE WHEN bo = n THEN 'boolean' WHEN it >= 0.95 * n THEN 'integer' WHEN de > 0 AND it + de >= 0.95 * n THEN 'decimal' "
    "WHEN da >= 0.95 * n THEN 'date' WHEN n - it - de - da >= 0.95 * n THEN 'text' ELSE 'mixed' END AS value_type FROM f2)"
)
add(
    "infer_types",
    lambda s, d: profile.infer_types(messy(s, d), COLUMNS).withColumnRenamed("column", "column_name"),
    duck.with_messy(f"{LONG}, {TYPES}, i AS (SELECT DISTINCT column_name, i FROM l) SELECT i.column_name, CAST(i.i AS INTEGER) AS column_index, coalesce(value_type, 'empty') AS value_type FROM i LEFT JOIN types USING (column_name)"),
)
add(
    "describe_dataset",
    lambda s, d: profile.describe(messy(s, d), COLUMNS).withColumnRenamed("column", "column_name"),
    duck.with_messy(
        f"{LONG}, {TYPES}, n AS (SELECT column_name, i, count(*) FILTER ({duck.blank('cell')}) AS empty_count, count(DISTINCT CASE WHEN NOT ({duck.blank('cell')}) THEN cell END) AS u FROM l GROUP BY 1, 2) "
        "SELECT n.column_name, CAST(i AS INTEGER) AS column_index, coalesce(value_type, 'empty') AS value_type, empty_count, CASE WHEN u <= 1000 THEN u END AS distinct_count, u > 1000 AS is_unique_marker FROM n LEFT JOIN types USING (column_name)"
    ),
)
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def customers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer", *CUSTOMER)


CUSTOMER_LONG = (
    "l AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS cell FROM customer" for c in CUSTOMER
    ) + ")"
)
add(
    "unique_columns",
    lambda s, d: profile.unique_columns(customers(s, d), CUSTOMER).withColumnRenamed("column", "column_name"),
    f"WITH {CUSTOMER_LONG} SELECT column_name, count(*) AS filled_count FROM l WHERE NOT ({duck.blank('cell')}) GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT cell) = count(*)",
)
add(
    "distinct_capped",
    lambda s, d: profile.distinct_counts(customers(s, d), CUSTOMER).select(
        F.col("column").alias("column_name"), profile.capped(F.col("distinct_exact"))[0].alias("distinct_count"), profile.capped(F.col("distinct_exact"))[1].alias("is_unique_marker")
    ),
    f"WITH {CUSTOMER_LONG}, u AS (SELECT column_name, count(DISTINCT cell) AS u FROM l WHERE NOT ({duck.blank('cell')}) GROUP BY 1) SELECT column_name, CASE WHEN u <= 1000 THEN u END AS distinct_count, u > 1000 AS is_unique_marker FROM u",
)
add(
    "distinct_at_most",
    lambda s, d: profile.distinct_at_most(messy(s, d), "city", agg.MAX_AXIS),
    duck.with_messy(f"u AS (SELECT count(DISTINCT {duck.trimmed('city')}) AS u FROM messy) SELECT CASE WHEN u <= 12 THEN u END AS distinct_count, u > 12 AS more FROM u"),
)
add(
    "profile_column",
    lambda s, d: profile.profile(messy(s, d), "email"),
    duck.with_messy(
        f"c AS (SELECT email AS cell, {duck.blank('email')} AS e FROM messy), u AS (SELECT count(*) FILTER (e) AS empty_count, count(DISTINCT CASE WHEN NOT e THEN cell END) AS u, "
        "min(CASE WHEN NOT e THEN length(cell) END) AS a, max(CASE WHEN NOT e THEN length(cell) END) AS b FROM c) "
        "SELECT empty_count, CASE WHEN u <= 1000 THEN u END AS distinct_count, u > 1000 AS is_unique_marker, CAST(a AS INTEGER) AS min_length, CAST(b AS INTEGER) AS max_length FROM u"
    ),
)

# --- masks

add(
    "mask_values",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", mask(F.col("url")).alias("masked")),
    f"SELECT page_id, {duck.mask('url')} AS masked FROM pages",
)
add(
    "mask_texts",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", mask(F.col("text")).alias("masked")),
    f"SELECT doc_id, {duck.mask('text')} AS masked FROM documents",
)
add(
    "mask_pairs",
    lambda s, d: public(messy(s, d).select(ROW_ID, mask(F.col("phone")).alias("from_mask"), mask(F.upper("name")).alias("to_mask"))),
    duck.with_messy(f"SELECT row_id, {duck.mask('phone')} AS from_mask, {duck.mask('upper(name)')} AS to_mask FROM messy"),
)


def shapes(s: SparkSession, d: str) -> DataFrame:
    df = messy(s, d)
    return profile.exemplars(profile.format_samples(df, "phone", K), profile.format_buckets(df, "phone", K))


add(
    "sample_shapes",
    shapes,
    duck.with_messy(
        duck.buckets("messy", "phone", K) + f", s AS (SELECT row_id, phone, {duck.classify('phone')} AS format FROM messy), r AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY row_id) AS turn FROM s), "
        "b2 AS (SELECT format, row_number() OVER (ORDER BY count DESC, format) AS seat FROM b), "
        f"o AS (SELECT r.format, {duck.mask('phone')} AS masked, row_number() OVER (ORDER BY turn, seat) AS scan FROM r JOIN b2 ON r.format = b2.format WHERE turn <= 16), "
        "u AS (SELECT format, masked, min(scan) AS scan FROM o WHERE scan <= 200 GROUP BY 1, 2), "
        "v AS (SELECT CAST(row_number() OVER (ORDER BY scan) AS INTEGER) AS rank, format, masked FROM u) SELECT * FROM v WHERE rank <= 10"
    ),
)

# --- findings

REAL = duck.dates("c", "cell")
ISSUES = {
    "leadingWhitespace": ("name", "SELECT row_id FROM c WHERE " + duck.hit("cell", rf"\A[{WS}]")),
    "trailingWhitespace": ("email", "SELECT row_id FROM c WHERE " + duck.hit("cell", rf"[{WS}]\z")),
    "placeholderValue": ("joined", "SELECT row_id FROM c WHERE " + duck.placeholder("cell")),
    "impossibleDate": ("joined", f"SELECT row_id FROM ({REAL}) WHERE year IS NOT NULL AND NOT is_real"),
    "futureDate": ("joined", f"SELECT row_id FROM ({REAL}) WHERE is_real AND year * 10000 + month * 100 + day > 20270630"),
    "mixedFormat": (
        "joined",
        f"SELECT row_id FROM (SELECT row_id, {duck.classify('cell')} AS f FROM c) WHERE f <> (SELECT f FROM (SELECT {duck.classify('cell')} AS f, count(*) AS n, min(row_id) AS seen FROM c GROUP BY 1) ORDER BY n DESC, seen LIMIT 1)",
    ),
    "nonNumericInNumericColumn": (
        "amount",
        f"SELECT row_id FROM c WHERE {duck.numeric('cell')} IS NULL AND (SELECT count({duck.numeric('cell')}) / count(*)::DOUBLE FROM c) >= 0.95 "
        f"AND (SELECT count(*) FROM c WHERE {duck.numeric('cell')} IS NOT NULL AND {duck.hit(duck.trimmed('cell'), '^-?0[^.]')}) = 0",
    ),
    "inconsistentLength": (
        "code",
        "SELECT row_id FROM c, (SELECT l, n FROM (SELECT length(cell) AS l, count(*) AS n, min(row_id) AS seen FROM c GROUP BY 1) ORDER BY n DESC, seen LIMIT 1) t WHERE length(cell) <> t.l AND t.n >= 0.9 * (SELECT count(*) FROM c)",
    ),
    "outOfRange": (
        "amount",
        f"SELECT row_id FROM (SELECT row_id, {duck.numeric('cell')} AS x FROM c), (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT {duck.numeric('cell')} AS x FROM c)) t "
        "WHERE q3 > q1 AND (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1))",
    ),
    "duplicateKey": (
        "code",
        "SELECT row_id FROM (SELECT row_id, count(*) OVER (PARTITION BY cell) AS n FROM c) WHERE n > 1 AND (SELECT count(DISTINCT cell) <= 1000 AND count(DISTINCT cell) >= 0.9 * count(*) FROM c)",
    ),
    "inconsistentCase": (
        "city",
        f"SELECT row_id FROM c WHERE lower({duck.trimmed('cell')}) IN (SELECT lower({duck.trimmed('cell')}) FROM c GROUP BY 1 HAVING count(DISTINCT cell) > 1) AND (SELECT count(DISTINCT lower({duck.trimmed('cell')})) <= 1000 FROM c)",
    ),
}


def issue_rows(code: str, column: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = issues.findings(messy(s, d), [column], K, AS_OF, [code])
        return public(issues.row_ids(found).join(issues.summary(found), ["code", "column"])).withColumnRenamed("column", "column_name")

    return run


for code, (column, rows) in ISSUES.items():
    cells = f"c AS (SELECT row_id, {column} AS cell FROM messy WHERE NOT ({duck.blank(column)}))"
    add(
        f"issue_{code}",
        issue_rows(code, column),
        duck.with_messy(
            f"{cells}, f AS ({rows}), r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rank, count(*) OVER () AS n FROM f) "
            f"SELECT '{code}' AS code, '{column}' AS column_name, CAST(rank AS INTEGER) AS rank, row_id, n AS affected_count, n > 100 AS truncated FROM r WHERE rank <= 100"
        ),
    )


def issues_all(s: SparkSession, d: str) -> DataFrame:
    return issues.summary(issues.findings(messy(s, d), list(dict.fromkeys(c for _, (c, _) in sorted(ISSUES.items()))), K, AS_OF)).withColumnRenamed("column", "column_name")


def all_issues_sql() -> str:
    parts = []
    for column in dict.fromkeys(c for _, (c, _) in sorted(ISSUES.items())):
        own = f"c AS (SELECT row_id, {column} AS cell FROM messy WHERE NOT ({duck.blank(column)}))"
        for code, (_, rows) in ISSUES.items():
            parts.append(f"SELECT '{code}' AS code, '{column}' AS column_name, count(*) AS affected_count, count(*) > 100 AS truncated FROM (WITH {own} {rows}) HAVING count(*) > 0")
    return duck.with_messy("SELECT * FROM (" + " UNION ALL ".join(parts) + ")")


add("issues_all", issues_all, all_issues_sql())

# --- near-duplicate rows

PAIR = ["name", "phone"]


def folded_messy(s: SparkSession, d: str) -> DataFrame:
    return dedupe.folded(messy(s, d), PAIR, ascii_only=True)


FOLDED = f"fr AS (SELECT row_id, {duck.fold('name')} AS p1, {duck.fold('phone')} AS p2 FROM messy), j AS (SELECT *, trim(p1 || ' ' || p2) AS joined FROM fr)"
BLOCKED = f"{FOLDED}, k AS (SELECT *, unnest(['p:' || substr(joined, 1, 2) || ':' || CAST(CAST(floor(length(joined) / 4.0) AS BIGINT) AS VARCHAR), 's:' || right(joined, 4)]) AS key FROM j WHERE joined <> ''), n AS (SELECT key, count(*) AS n FROM k GROUP BY 1)"
PAIRED = (
    f"{BLOCKED}, u AS (SELECT k.* FROM k JOIN n USING (key) WHERE n.n BETWEEN 2 AND 500), "
    "e AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b, a.joined AS ja, b.joined AS jb, a.p1 AS a1, b.p1 AS b1, a.p2 AS a2, b.p2 AS b2 FROM u a JOIN u b ON a.key = b.key AND a.row_id < b.row_id AND abs(length(a.joined) - length(b.joined)) <= 8), "
    f"q AS (SELECT *, {duck.similarity('ja', 'jb', 0.85)} AS score FROM e), t AS (SELECT * FROM q WHERE score >= 0.85 ORDER BY score DESC, a, b LIMIT 50)"
)
add(
    "fold_text",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", folding.fold(F.col("c_name")).alias("folded")),
    f"SELECT c_custkey, {duck.fold('c_name')} AS folded FROM customer",
)


def neighbours(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("city").orderBy(ROW_ID)
    own = messy(s, d).withColumn("other", F.lead("name").over(w)).where("other IS NOT NULL")
    a, b = folding.fold(F.col("name"), True), folding.fold(F.col("other"), True)
    return public(own.select(ROW_ID, folding.similarity(a, b, 0.5).alias("score"), folding.similarity(a, b, 0.9).alias("strict_score")))


add(
    "similarity_scores",
    neighbours,
    duck.with_messy(
        f"w AS (SELECT row_id, {duck.fold('name')} AS a, {duck.fold('lead(name) OVER (PARTITION BY city ORDER BY row_id)')} AS b FROM messy) "
        f"SELECT row_id, {duck.similarity('a', 'b', 0.5)} AS score, {duck.similarity('a', 'b', 0.9)} AS strict_score FROM w WHERE b IS NOT NULL"
    ),
)
add("dedupe_blocks", lambda s, d: dedupe.blocks(folded_messy(s, d)), duck.with_messy(f"{BLOCKED} SELECT key, n FROM n"))
add("dedupe_skipped_blocks", lambda s, d: dedupe.skipped_blocks(folded_messy(s, d)), duck.with_messy(f"{BLOCKED} SELECT key, n FROM n WHERE n > 500"))
add(
    "find_duplicates",
    lambda s, d: dedupe.find_duplicates(messy(s, d), PAIR, 0.85, ascii_only=True).select("a", "b", "score"),
    duck.with_messy(f"{PAIRED} SELECT a, b, score FROM t"),
)
add(
    "dedupe_matched_columns",
    lambda s, d: dedupe.find_duplicates(messy(s, d), PAIR, 0.85, ascii_only=True).select("a", "b", F.explode("matched_columns").alias("column_name")),
    duck.with_messy(
        f"{PAIRED} SELECT a, b, 'name' AS column_name FROM t WHERE NOT (a1 = '' AND b1 = '') AND {duck.similarity('a1', 'b1', 0.85)} >= 0.85 "
        f"UNION ALL SELECT a, b, 'phone' FROM t WHERE NOT (a2 = '' AND b2 = '') AND {duck.similarity('a2', 'b2', 0.85)} >= 0.85"
    ),
)

# --- transforms: (spec, DuckDB value or NULL for a failure)


def recased(x: str) -> str:
    """Title case of ASCII words split at white space."""
    word = "upper(substr(w, 1, length(regexp_extract(w, '^[^a-z]*')) + 1)) || substr(w, length(regexp_extract(w, '^[^a-z]*')) + 2)"
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), {duck.lit(rf'[{WS}]+|[^{WS}]+')}), lambda w: {word}), '')"


T_ = {c: duck.trimmed(c) for c in COLUMNS}
PHONE = duck.replaced(T_["phone"], rf"[{WS}()./-]")
FULL = (
    f"CASE WHEN {PHONE} LIKE '+%' THEN {PHONE} WHEN {PHONE} LIKE '00%' THEN '+' || substr({PHONE}, 3) WHEN {PHONE} LIKE '0%' THEN '+62' || substr({PHONE}, 2) "
    f"WHEN {duck.hit(PHONE, r'^[1-9][0-9]{7,12}$')} THEN '+62' || {PHONE} END"
)
AMOUNT = T_["amount"]
PLAIN = f"CASE {duck.classify(AMOUNT)} WHEN 'decimalComma' THEN replace(replace({AMOUNT}, '.', ''), ',', '.') WHEN 'decimalPoint' THEN replace({AMOUNT}, ',', '') WHEN 'integerPlain' THEN replace({AMOUNT}, ',', '') END"
DATE = f"SELECT row_id, CASE WHEN year IS NOT NULL AND is_real AND NOT ({duck.matches('cell', 'dateDmySlash')} AND {duck.matches('cell', 'dateMdySlash')}) THEN lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-' || lpad(CAST(day AS VARCHAR), 2, '0') END AS iso, format, cell FROM ({duck.dates('messy', 'joined')})"
TRANSFORMS = {
    "tx_trim": (TransformSpec("trimWhitespace", "name"), T_["name"]),
    "tx_collapse": (TransformSpec("collapseSpaces", "name"), duck.replaced("name", rf"[{WS}]+", " ")),
    "tx_case_lower": (TransformSpec("changeCase", "city", to="lower"), "lower(city)"),
    "tx_case_upper": (TransformSpec("changeCase", "name", to="upper"), "upper(name)"),
    "tx_case_title": (TransformSpec("changeCase", "notes", to="title"), f"CASE WHEN {duck.blank('notes')} THEN notes ELSE {recased('notes')} END"),
    "tx_date": (TransformSpec("normaliseDate", "joined", to="dateIso"), f"(SELECT iso FROM ({DATE}) t WHERE t.row_id = messy.row_id)"),
    "tx_timestamp": (
        TransformSpec("normaliseDate", "joined", to="timestampIso"),
        f"(SELECT iso || 'T' || CASE WHEN format = 'timestampIso' THEN substr(cell, 12) ELSE '00:00:00' END FROM ({DATE}) t WHERE t.row_id = messy.row_id)",
    ),
    "tx_phone": (TransformSpec("normalisePhone", "phone", to="phoneE164", country_code="+62"), f"CASE WHEN {duck.matches(FULL, 'phoneE164')} THEN {FULL} END"),
    "tx_number": (TransformSpec("normaliseNumber", "amount", to="decimalPoint"), PLAIN),
    "tx_number_integer": (
        TransformSpec("normaliseNumber", "amount", to="integerPlain"),
        f"CASE WHEN NOT {duck.hit(f'({PLAIN})', '[.][0-9]*[1-9]')} THEN split_part({PLAIN}, '.', 1) END",
    ),
    "tx_pad": (TransformSpec("padLeft", "code", length=10, fill="xy"), "CASE WHEN length(code) >= 10 THEN code ELSE lpad(code, 10, 'xy') END"),
    "tx_placeholder": (TransformSpec("replacePlaceholderWithEmpty", "joined"), f"CASE WHEN {duck.placeholder('joined')} THEN '' ELSE joined END"),
    "tx_mask_none": (TransformSpec("maskColumn", "name", keep="none"), "repeat('*', length(name))"),
    "tx_mask_last_four": (TransformSpec("maskColumn", "phone", keep="lastFour"), "CASE WHEN length(phone) > 4 THEN repeat('*', length(phone) - 4) || right(phone, 4) END"),
    "tx_mask_domain": (
        TransformSpec("maskColumn", "email", keep="domain"),
        f"CASE WHEN {duck.blank('email')} THEN email WHEN strpos(email, '@') > 1 THEN repeat('*', strpos(email, '@') - 1) || substr(email, strpos(email, '@')) END",
    ),
}
for name, (spec, value) in TRANSFORMS.items():
    add(
        name,
        lambda s, d, spec=spec: public(transforms.targeted(messy(s, d), spec).drop("cell")),
        duck.with_messy(
            f"v AS (SELECT row_id, {spec.column} AS cell, {value} AS v FROM messy) "
            "SELECT row_id, coalesce(v, cell) AS value, CASE WHEN v IS NULL THEN 'failed' WHEN v = cell THEN 'unchanged' ELSE 'changed' END AS status FROM v"
        ),
    )
add(
    "tx_drop",
    lambda s, d: public(transforms.commit(messy(s, d), TransformSpec("dropColumn", "notes"))),
    duck.with_messy("SELECT * EXCLUDE (notes) FROM messy"),
)
SUBSET = list(range(0, 3000, 7))
add(
    "tx_row_subset",
    lambda s, d: public(transforms.commit(messy(s, d), TransformSpec("changeCase", "name", to="upper"), SUBSET)).select("row_id", "name"),
    duck.with_messy("SELECT row_id, CASE WHEN row_id < 3000 AND row_id % 7 = 0 THEN upper(name) ELSE name END AS name FROM messy"),
)


def dry_run(s: SparkSession, d: str) -> DataFrame:
    done = transforms.targeted(messy(s, d), TRANSFORMS["tx_date"][0])
    return transforms.report(done)


add(
    "dry_run_report",
    dry_run,
    duck.with_messy(f"v AS (SELECT joined AS cell, {TRANSFORMS['tx_date'][1]} AS v FROM messy) SELECT count(*) FILTER (v = cell) AS unchanged, count(*) FILTER (v <> cell) AS changed, count(*) FILTER (v IS NULL) AS failed FROM v"),
)
add(
    "dry_run_examples",
    lambda s, d: transforms.examples(transforms.targeted(messy(s, d), TRANSFORMS["tx_date"][0])).select(F.col("from").alias("from_mask"), F.col("to").alias("to_mask"), "first_row"),
    duck.with_messy(
        f"v AS (SELECT row_id, {duck.mask('joined')} AS from_mask, {duck.mask('coalesce(' + TRANSFORMS['tx_date'][1] + ', joined)')} AS to_mask FROM messy) "
        "SELECT from_mask, to_mask, min(row_id) AS first_row FROM v WHERE from_mask <> to_mask GROUP BY 1, 2 ORDER BY 3 LIMIT 10"
    ),
)


def round_trip(s: SparkSession, d: str) -> DataFrame:
    df, spec = messy(s, d), TRANSFORMS["tx_date"][0]
    return public(transforms.undo(transforms.commit(df, spec), spec.column, transforms.previous_values(df, spec))).select("row_id", "joined")


add("undo_roundtrip", round_trip, duck.with_messy("SELECT row_id, joined FROM messy"))

# --- sessions and ingest


class Yes(People):
    """A person who approves and reveals, but leaves questions open."""

    def approve(self, spec, report, reason, rows, gate):
        gate.settle((True, "fine"))

    def reveal(self, row, column, reason, read, gate):
        gate.settle((row == 1, read() if row == 1 else "no"))


def session(s: SparkSession, d: str) -> Session:
    own = Session(Yes(), gate_seconds=0.2)
    own.load(from_dataframe(messy(s, d), source_name="messy.csv", as_row_id=ROW_ID), GuardConfig(K, 3, AS_OF))
    return own


def steps(s: SparkSession, rows: list[tuple]) -> DataFrame:
    return s.createDataFrame([(i, *map(str, r)) for i, r in enumerate(rows)], "step int, what string, result string")


def budget_ledger(s: SparkSession, d: str) -> DataFrame:
    own = session(s, d)
    asked = [own.call("count_where", conditions=[{"kind": "isEmpty", "column": "email"}]) for _ in range(4)]
    return steps(s, [("count", f"{a['status']} {a['remaining']}") for a in asked])


def proposal_flow(s: SparkSession, d: str) -> DataFrame:
    own = session(s, d)
    made = own.call("propose_transform", transform={"kind": "trimWhitespace", "column": "name"})
    first = own.call("apply_transform", proposal=made["proposal"], reason="tidy")
    again = own.call("apply_transform", proposal=made["proposal"], reason="tidy")
    back = own.call("undo_last")
    rows = [("proposed", made["value"]["changed"]), ("applied", first["status"]), ("again", again["code"]), ("undone", back["restored"]), ("empty", own.call("undo_last")["status"])]
    return steps(s, rows)


def reveal_flow(s: SparkSession, d: str) -> DataFrame:
    own = session(s, d)
    return steps(s, [(f"row {r}", own.call("request_reveal", row=r, column="name", reason="to compare")["status"]) for r in (1, 2, 2, 10**9)])


def ask_human_timeout(s: SparkSession, d: str) -> DataFrame:
    said = session(s, d).call("ask_human", question="Which?", options=["This", "That", "Leave it"])
    return steps(s, [("answer", said["answer"]), ("answered by", said["answered_by"])])


def report_discrepancy(s: SparkSession, d: str) -> DataFrame:
    own = session(s, d)
    own.call("count_where", conditions=[{"kind": "equals", "column": "city", "value": "Manado"}])
    said = own.call("submit_cleanup_report", summary="done", changes=[], unresolved=[])
    return steps(s, [("refusals", said["refusals"]), ("omitted", (said["discrepancy"] or {}).get("omitted_count"))])


def journal_summary(s: SparkSession, d: str) -> DataFrame:
    own = session(s, d)
    own.call("describe_dataset")
    own.call("count_where", conditions=[{"kind": "equals", "column": "city", "value": "Manado"}])
    own.call("request_reveal", row=1, column="name", reason="to compare")
    return steps(s, list(own.journal.summary().items()))


def answered_sql(where: str) -> str:
    """Whether a count is answered, as a DuckDB condition."""
    n = f"(SELECT count(*) FROM messy WHERE {where})"
    return f"({n} = 0 OR {n} >= {K})"


MANADO = answered_sql("city = 'Manado'")
CHANGED = f"(SELECT count(*) FROM messy WHERE name <> {T_['name']})"
SESSION_ORACLES = {
    # Three questions a column; a small group is refused and costs one as well.
    "budget_ledger": f"SELECT CAST(i AS INTEGER) AS step, 'count' AS what, CASE WHEN i >= 3 THEN 'refused 0' WHEN {answered_sql(duck.blank('email'))} THEN 'answered ' || (2 - i) ELSE 'refused ' || (2 - i) END AS result FROM range(4) t(i)",
    # One person, who grants row 1 only; a refused row stays refused, a row that isn't there is no question.
    "reveal_flow": "SELECT CAST(step AS INTEGER) AS step, 'row ' || r AS what, CASE WHEN r NOT IN (SELECT row_id FROM messy) THEN 'invalid' WHEN r = 1 THEN 'granted' "
    "WHEN row_number() OVER (PARTITION BY r ORDER BY step) > 1 THEN 'alreadyRefused' ELSE 'refused' END AS result FROM (VALUES (0, 1), (1, 2), (2, 2), (3, 1000000000)) t(step, r)",
    "ask_human_timeout": "SELECT CAST(i AS INTEGER) AS step, what, result FROM (SELECT 0 AS i, 'answer' AS what, list_extract(['This', 'That', 'Leave it'], -1) AS result UNION ALL SELECT 1, 'answered by', 'nobody') WHERE (SELECT count(*) FROM messy) > 0",
    "report_discrepancy": f"SELECT CAST(i AS INTEGER) AS step, what, CASE WHEN {MANADO} THEN CASE what WHEN 'omitted' THEN 'None' ELSE '0' END ELSE '1' END AS result FROM (VALUES (0, 'refusals'), (1, 'omitted')) t(i, what)",
    "journal_summary": f"SELECT CAST(i AS INTEGER) AS step, what, CAST(n AS VARCHAR) AS result FROM (SELECT 0 AS i, 'tool_calls' AS what, 3 AS n UNION ALL SELECT 1, 'suppressed_answers', CASE WHEN {MANADO} THEN 0 ELSE 1 END "
    "UNION ALL SELECT 2, 'transforms_applied', 0 UNION ALL SELECT 3, 'reveals_requested', count(*) FROM messy WHERE row_id = 1 UNION ALL SELECT 4, 'reveals_granted', count(*) FROM messy WHERE row_id = 1)",
    "proposal_flow": f"SELECT CAST(i AS INTEGER) AS step, what, result FROM (SELECT 0 AS i, 'proposed' AS what, CAST({CHANGED} AS VARCHAR) AS result UNION ALL SELECT 1, 'applied', 'applied' UNION ALL SELECT 2, 'again', 'alreadyCommitted' "
    f"UNION ALL SELECT 3, 'undone', CAST({CHANGED} AS VARCHAR) UNION ALL SELECT 4, 'empty', 'empty')",
}
for run in (budget_ledger, reveal_flow, ask_human_timeout, report_discrepancy, journal_summary, proposal_flow):
    add(run.__name__, run, duck.with_messy(SESSION_ORACLES[run.__name__]))

CSV = '﻿name;phone;phone;;a;a;a (2)\n"Ani; Wijaya";007;"say ""hi""";x;1;2;3\n\n;;;;;;\nshort;1\nlong;1;2;3;4;5;6;7\n" spaced ";"two\nlines";;;;;\n'


def csv_file(s: SparkSession) -> str:
    """The sample file in the shared folder (or a temporary one of a local master)."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    s.createDataFrame([(CSV.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    return path


def csv_ingest(s: SparkSession, d: str) -> DataFrame:
    found = csv_source.read_csv(s, csv_file(s)).dataset
    cells = profile.long_form(found.df, found.names)
    return public(cells.withColumnRenamed("column", "column_name"))


def csv_ragged(s: SparkSession, d: str) -> DataFrame:
    return steps(s, [("warning", w) for w in csv_source.read_csv(s, csv_file(s)).warnings])


INGESTED = [
    ("Ani; Wijaya", "007", 'say "hi"', "x", "1", "2", "3"), ("short", "1", "", "", "", "", ""), ("long", "1", "2", "3", "4", "5", "6"), (" spaced ", "two\nlines", "", "", "", "", ""),
]
NAMES = ["name", "phone", "phone (2)", "column 4", "a", "a (2)", "a (2) (2)"]
add(
    "csv_ingest",
    csv_ingest,
    "SELECT row_id, column_name, replace(cell, '\\n', chr(10)) AS cell FROM (VALUES "
    + ", ".join(f"({i}::BIGINT, {duck.lit(n)}, {duck.lit(v.replace(chr(10), chr(92) + 'n'))})" for i, row in enumerate(INGESTED) for n, v in zip(NAMES, row, strict=True))
    + ") t(row_id, column_name, cell)",
)
#: Quoted cells become one letter, so that lines are records and semicolons part cells.
CSV_RECORDS = (
    f"r AS (SELECT unnest(string_split(regexp_replace({duck.lit(CSV)}, '\"(?:[^\"]|\"\")*\"', 'q', 'g'), chr(10))) AS line), "
    "c AS (SELECT len(string_split(line, ';')) AS cells, row_number() OVER () AS pos FROM r WHERE regexp_replace(line, '[; ]', '', 'g') <> ''), "
    "w AS (SELECT cells AS width FROM c WHERE pos = 1), f AS (SELECT count(*) FILTER (cells < width) AS short, count(*) FILTER (cells > width) AS long FROM c, w WHERE pos > 1)"
)
add(
    "csv_ragged",
    csv_ragged,
    f"WITH {CSV_RECORDS}, m AS (SELECT 0 AS i, 'the header \"phone\" occurs again and was renamed \"phone (2)\"' AS result UNION ALL SELECT 1, 'column 4 has an empty header and was named \"column 4\"' "
    "UNION ALL SELECT 2, 'the header \"a\" occurs again and was renamed \"a (2)\"' UNION ALL SELECT 3, 'the header \"a (2)\" occurs again and was renamed \"a (2) (2)\"' "
    "UNION ALL SELECT 4, short || ' row(s) had fewer cells than the header; the missing cells are empty' FROM f WHERE short > 0 "
    "UNION ALL SELECT 5, long || ' row(s) had more cells than the header; the extra cells were left out' FROM f WHERE long > 0) "
    "SELECT CAST(i AS INTEGER) AS step, 'warning' AS what, result FROM m",
)
add(
    "column_reduce",
    lambda s, d: profile.reduce_columns(messy(s, d), {"filled": ("notes", lambda c: F.count_if(~is_blank(c))), "longest": ("name", lambda c: F.max(F.length(c)))}),
    duck.with_messy(f"SELECT count(*) FILTER (NOT ({duck.blank('notes')})) AS filled, CAST(max(length(name)) AS INTEGER) AS longest FROM messy"),
)
add(
    "row_reduce",
    lambda s, d: profile.reduce_rows(messy(s, d), ["name", "city"], lambda name, city: F.count_if(F.length(name) > F.length(city)).alias("longer")),
    duck.with_messy("SELECT count(*) FILTER (length(name) > length(city)) AS longer FROM messy"),
)
