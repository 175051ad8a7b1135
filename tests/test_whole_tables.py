"""Queries over whole tables: every row counts, whatever its id or place."""

import duckdb
import pytest

from shapeguard import duck, queries
from shapeguard.operators import aggregate, issues
from shapeguard.types import ROW_ID

SF = "/root/testdata/sf0.01"
NAMES = ("similarity_scores", "issue_duplicateKey", "agg_suppressed_extremes")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_duckdb_over_the_whole_table(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, (dict(sorted(zip(names, r, strict=True))) for r in cur.fetchall())))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(str, (dict(sorted(r.asDict().items())) for r in df.collect()))) == want


def test_duplicate_keys_and_small_groups(spark):
    rows = [(i, f"K{i - (i == 7)}", "few" if i < 2 else "some" if i < 6 else "many", str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, f"{ROW_ID} long, code string, city string, amount string")
    assert sorted(r[ROW_ID] for r in issues.findings(df, ["code"], 5, codes=["duplicateKey"]).collect()) == [6, 7]
    got = {r.group_key: (r.row_count, r.value, r.suppressed) for r in aggregate.aggregate(df, "city", "max", "amount", 3).collect()}
    assert got == {"many": (14, 19.0, False), "some": (4, None, True), None: (2, None, False)}


def test_proposal_flow_counts_every_row(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW orders AS SELECT * FROM '/root/testdata/sf0.001/orders.parquet'")
    changed = con.execute(duck.with_messy(f"SELECT count(*) FROM messy WHERE name <> {duck.trimmed('name')}")).fetchone()[0]
    got = {r.what: r.result for r in queries.proposal_flow(spark, "/root/testdata/sf0.001").collect()}
    assert int(got["proposed"]) == int(got["undone"]) == changed > 100 and got["empty"] == "empty"


@pytest.mark.parametrize("name", [*queries.SESSION_ORACLES, "csv_ragged", "csv_ingest", "column_reduce", "row_reduce"])
def test_sessions_and_ingest_equal_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, (dict(sorted(zip(names, r, strict=True))) for r in cur.fetchall())))
    got = queries.QUERIES[name](spark, SF)
    assert sorted(map(str, (dict(sorted(r.asDict().items())) for r in got.collect()))) == want and want
