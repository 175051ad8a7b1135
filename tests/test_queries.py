"""Queries against their DuckDB counterparts on the smallest tables."""

import duckdb
import pytest

from shapeguard import queries

SF = "/root/testdata/sf0.001"
CHECKED = (
    "format_buckets format_samples date_parts count_all agg_mean agg_other_bucket crosstab_suppressed infer_types profile_column mask_values "
    "sample_shapes issue_outOfRange find_duplicates tx_date tx_phone tx_number dry_run_examples undo_roundtrip csv_ingest budget_ledger"
).split()


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "pages", "customer", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, (dict(sorted(zip(names, r, strict=True))) for r in cur.fetchall())))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(str, (dict(sorted(r.asDict().items())) for r in df.collect()))) == want and want
