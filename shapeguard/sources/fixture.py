"""A deliberately messy table of customers, derived from ``orders`` by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeguard.sources.shared import spread
from shapeguard.types import ROW_ID

# Fixed value: the same text runs in Spark and DuckDB, so results can be compared.
MESSY_SQL = """
WITH b AS (
  SELECT CAST(o_orderkey AS BIGINT) AS k,
         CAST(o_orderkey AS BIGINT) - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS g,
         'anbucidefagihainjukalomunapurisutawiyazu' AS s
  FROM orders),
n AS (
  SELECT k, g,
    concat(upper(substring(s, CAST(1 + 2*(g % 20) AS INT), 1)), substring(s, CAST(2 + 2*(g % 20) AS INT), 1),
           substring(s, CAST(1 + 2*(CAST(floor(g/20) AS BIGINT) % 20) AS INT), 2), ' ',
           upper(substring(s, CAST(1 + 2*((g*7+3) % 20) AS INT), 1)), substring(s, CAST(2 + 2*((g*7+3) % 20) AS INT), 1),
           substring(s, CAST(1 + 2*(CAST(floor(g/400) AS BIGINT) % 20) AS INT), 2), 'wan') AS nm,
    concat('0812', lpad(CAST((g*7919) % 100000000 AS STRING), 8, '0')) AS ph,
    CAST(2023 + g % 4 AS STRING) AS y, lpad(CAST(1 + g % 12 AS STRING), 2, '0') AS m, lpad(CAST(1 + g % 28 AS STRING), 2, '0') AS d,
    1500 + (k*104729) % 24998500 AS cents
  FROM b),
a AS (SELECT *, CAST(floor(cents/100) AS BIGINT) AS w, lpad(CAST(cents % 100 AS STRING), 2, '0') AS f FROM n)
SELECT k AS row_id,
  CASE WHEN k % 50 = 1 THEN concat(substring(nm, 1, length(nm)-1), 'm')
       WHEN k % 23 = 0 THEN concat(' ', nm) WHEN k % 23 = 1 THEN concat(nm, ' ')
       WHEN k % 23 = 2 THEN replace(nm, ' ', '  ') WHEN k % 23 = 3 THEN lower(nm) ELSE nm END AS name,
  CASE k % 8 WHEN 0 THEN concat('+62', substring(ph, 2, 11)) WHEN 1 THEN concat(substring(ph,1,4),'-',substring(ph,5,4),'-',substring(ph,9,4))
       WHEN 2 THEN concat(substring(ph,1,4),' ',substring(ph,5,4),' ',substring(ph,9,4)) WHEN 3 THEN substring(ph, 2, 11) ELSE ph END AS phone,
  CASE WHEN k % 19 = 0 THEN '' WHEN k % 19 = 1 THEN concat(lower(replace(nm,' ','.')),'@example.com ')
       WHEN k % 19 = 2 THEN concat(lower(replace(nm,' ','.')),'@EXAMPLE.NET') WHEN k % 19 = 3 THEN 'n/a'
       ELSE concat(lower(replace(nm,' ','.')),'@example.org') END AS email,
  CASE WHEN k IN (7,107,207) THEN 'Pontianak' WHEN k IN (9,109) THEN 'Manado' WHEN k % 97 = 0 THEN 'mataram'
       WHEN k % 10 < 6 THEN 'Mataram' WHEN k % 10 = 6 THEN 'Bandung' WHEN k % 10 = 7 THEN 'Surabaya' WHEN k % 10 = 8 THEN 'Medan' ELSE 'Makassar' END AS city,
  CASE WHEN k % 499 = 0 THEN '2031-01-01' WHEN k % 501 = 0 THEN '31/02/2024' WHEN k % 211 = 0 THEN 'N/A'
       WHEN k % 7 = 0 THEN concat(d,'/',m,'/',y) WHEN k % 7 = 1 THEN concat(d,'.',m,'.',y) WHEN k % 7 = 2 THEN concat(d,' Agu ',y)
       WHEN k % 7 = 3 THEN concat(y,'-',m,'-',d,' 08:30:00') ELSE concat(y,'-',m,'-',d) END AS joined,
  CASE WHEN k % 701 = 0 THEN '99999999.00' WHEN k % 9 = 0 THEN concat(CASE WHEN w >= 1000 THEN concat(CAST(CAST(floor(w/1000) AS BIGINT) AS STRING),'.',lpad(CAST(w % 1000 AS STRING),3,'0')) ELSE CAST(w AS STRING) END, ',', f)
       WHEN k % 9 = 1 THEN CAST(w AS STRING) WHEN k % 307 = 0 THEN 'tbd' ELSE concat(CAST(w AS STRING),'.',f) END AS amount,
  CASE WHEN k % 20 = 0 THEN 'follow up next week' ELSE '' END AS notes,
  CASE WHEN k % 40 = 0 THEN CAST(k AS STRING) ELSE concat('K', lpad(CAST(k - CASE WHEN k % 30 = 1 THEN 1 ELSE 0 END AS STRING), 6, '0')) END AS code
FROM a
"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_row_id`` and name, phone, email, city, joined, amount, notes, code."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return spark.sql(MESSY_SQL.replace("FROM orders", "FROM {orders}"), orders=orders).withColumnRenamed("row_id", ROW_ID)


def generated(spark: SparkSession, rows: int = 5000, messiness: float = 0.2, seed: int = 20260827) -> DataFrame:
    """Customers with every kind of defect, any number of rows, from hashes of the row id."""
    def draw(tag: str, n: int):
        return F.pmod(F.xxhash64(F.col(ROW_ID), F.lit(f"{seed}:{tag}")), F.lit(n))

    def odd(tag: str):
        return draw(f"odd:{tag}", 1_000_000) < int(messiness * 1_000_000)

    syllables = F.array(*[F.lit(s) for s in "an bu ci de fa gi ha in ju ka lo mu na pu ri su ta wi ya zu".split()])
    syllable = lambda tag: F.element_at(syllables, (draw(tag, 20) + 1).cast("int"))
    name = F.initcap(F.concat(syllable("n1"), syllable("n2"), F.lit(" "), syllable("n3"), syllable("n4"), F.lit("wan")))
    number = F.lpad(draw("ph", 100_000_000).cast("string"), 8, "0")
    day, month, year = F.lpad((draw("d", 28) + 1).cast("string"), 2, "0"), F.lpad((draw("m", 12) + 1).cast("string"), 2, "0"), (draw("y", 4) + 2023).cast("string")
    whole, cents = draw("w", 250_000).cast("string"), F.lpad(draw("c", 100).cast("string"), 2, "0")
    pick = lambda tag, *options: F.element_at(F.array(*options), (draw(tag, len(options)) + 1).cast("int"))
    email = F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit("@example.org"))
    cities = pick("city", *map(F.lit, ["Mataram"] * 6 + ["Bandung", "Surabaya", "Medan", "Makassar"]))
    return spark.range(rows).withColumnRenamed("id", ROW_ID).select(
        ROW_ID,
        F.concat(F.lit("C"), F.lpad(F.col(ROW_ID).cast("string"), 6, "0")).alias("id"),
        F.when(odd("name"), pick("nd", F.concat(F.lit(" "), name), F.concat(name, F.lit(" ")), F.replace(name, F.lit(" "), F.lit("  ")))).otherwise(name).alias("name"),
        F.when(odd("phone"), pick("pd", F.concat(F.lit("+62812"), number), F.concat(F.lit("0812-"), number), F.concat(F.lit("0812 "), number))).otherwise(F.concat(F.lit("0812"), number)).alias("phone"),
        F.when(odd("email"), pick("ed", F.lit(""), F.concat(email, F.lit(" ")), F.replace(email, F.lit("example.org"), F.lit("EXAMPLE.ORG")))).otherwise(email).alias("email"),
        F.when(F.col(ROW_ID).isin(1, 2, 3), "Pontianak").when(F.col(ROW_ID).isin(4, 5), "Manado").otherwise(cities).alias("city"),
        F.when(odd("joined"), pick("jd", F.concat_ws("/", day, month, year), F.concat_ws(".", day, month, year))).otherwise(F.concat_ws("-", year, month, day)).alias("joined"),
        F.when(odd("amount"), pick("ad", F.concat(whole, F.lit(","), cents), whole)).otherwise(F.concat(whole, F.lit("."), cents)).alias("amount"),
        F.when(draw("notes", 20) == 0, "follow up next week").otherwise("").alias("notes"),
    )
