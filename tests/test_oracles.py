"""A sample of the named queries against their SQL in DuckDB; the driver compares them all."""

import duckdb
import pandas as pd
import pytest

from shelfspark.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df):
    num = lambda v: "NULL" if pd.isna(v) else (round(float(v), 6) if not isinstance(v, str) else v)
    return sorted((tuple(num(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", ["summary", "inventory_by_brand", "loss_makers", "completeness", "duplicate_skus", "related_products", "parse_money", "upsert_locked", "import_products", "resolve_slugs", "patch_fields", "patch_outcomes", "create_products", "verify_products", "manifest_gap_split", "assign_folders", "link_folders", "spec_rows", "dedupe_full", "draft_sources", "dedupe_merge", "create_repeated", "brand_filter", "remove_soft", "display_money"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())
