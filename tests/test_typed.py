"""Rows of price lists as typed drafts: identity, prices, specifications, lookups, and the queries against their SQL."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import identity, specs, text
from shelfspark.operators import catalog, imports, ingest
from shelfspark.plans.typed import TYPED
from shelfspark.plans.typed_oracles import ORACLES

SF = "/root/testdata/sf0.001"
GRID = "file string, sheet string, row_index int, cells array<string>"


def each(spark, f, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("c"))).collect()]


def test_words(spark):
    assert each(spark, text.title_case, ["usb-c cable", "o'neil  x", "éa b", "3com", "", None]) == ["Usb-C Cable", "O'Neil X", "éA B", "3com", "", ""]
    assert each(spark, identity.infer_brand, ["soundcore by anker R50i", "Eufy x", "ankerish", "western digital wd", "", None]) == ["Soundcore", "eufy", None, "Western Digital", None, None]


def test_brand_cells(spark):
    got = each(spark, identity.normalize_brand, ["HP / hp", "Dell & usb-co", "soundcore / Soundcore", "Aqua /", " ", "acme", "aCme"])
    assert [(g["brand"], g["parent"], g["is_generic"], g["is_multi"]) for g in got] == [
        ("HP", None, False, False), ("Dell", None, False, True), ("Soundcore", "Anker", False, False), ("Aqua /", None, False, False), (None, None, False, False), ("Acme", None, False, False), ("aCme", None, False, False),
    ]
    assert got[1]["all"] == ["Dell", "Usb-Co"]


def test_supplier_cells(spark):
    got = each(spark, identity.split_supplier_sku, ["Joyroom/JR 1", "Anker A2149", "A2149", "/x", "a b c", None])
    assert [(g["supplier"], g["sku"]) for g in got] == [("Joyroom", "JR 1"), ("Anker", "A2149"), (None, "A2149"), (None, "/x"), (None, "a b c"), (None, None)]


def test_generic_without_sku(spark):
    rows = spark.createDataFrame([("sample item", "X1"), ("sample item", None), ("good item", None)], "name string, sku string")
    none = F.lit(None).cast("string")
    got = rows.select(identity.detect_generic(F.col("name"), none, none, none, F.col("sku"))["reasons"]).collect()
    assert [r[0] for r in got] == [["name_contains_generic_token"], ["name_contains_generic_token", "no_sku"], []]


def test_columns_go_before_texts(spark):
    """Capacity, interface, colour and warranty are read from their own columns; what these lack comes from the texts."""
    rows = spark.createDataFrame(
        [("Disk 1TB red, 2 years", {"capacity": "512GB", "interface": "SATA III", "color": "night blue", "warranty": "6 months", "condition": "sealed"}), ("Disk 1TB red, 2 years, NVMe new", {"capacity": "big"}), ("باور بانك 20K", {}), ("cable 20K", {}), (None, {})],
        "name string, m map<string,string>",
    )
    field = lambda n: F.col("name") if n == "name" else F.element_at("m", n)
    got = [r[0] for r in rows.select(specs.extract_specs(field, F.lit(None).cast("string"))).collect()]
    assert [(g["capacity"], g["interface"], g["color"], g["warranty_months"], g["condition"]) for g in got] == [
        ("512GB", "SATA III", "night blue", 6, "new"), ("1TB", "NVME", "Red", 24, "unknown"), (None, None, None, None, "unknown"), (None, None, None, None, "unknown"), (None, None, None, None, "unknown"),
    ]
    assert [g["battery_capacity"] for g in got] == [None, None, 20000, None, None] and got[0]["capacity_gb"] == 512.0


def test_drafts_of_odd_rows(spark):
    head = ["Product", "SKU", "Brand", "RDP (USD)", "RRP", "Price (est)", "Qty", "Shelf place"]
    cells = [
        ["", "Robovac G50 Hybrid (T2212)", None, "10", "20", None, "-3", " a   b "], ["thing", None, "tbd", None, "30", "x", "", None], ["", "", "Anker", "1", "2", "3", "4", "z"],
        ["long " * 5000, "A1", "HP", "1", "1-3", "5", "7", None], ["thing", None, "tbd", None, "30", "x", "", None],
    ]
    grid = spark.createDataFrame([("f", "Must buy", 1, head), *(("f", "Must buy", i + 2, c) for i, c in enumerate(cells))], GRID)
    got = {r["row_index"]: r for r in ingest.parse(grid).collect()}
    assert set(got) == {2, 3, 5, 6}  # a row without name and SKU is none
    one, two, long = got[2], got[3], got[5]
    assert (one["name"], one["sku"], one["brand"], one["quantity"], one["extras"], one["unmapped_columns"]) == ("Robovac G50 Hybrid (T2212)", "T2212", None, 0, {"Shelf place": "a b"}, ["Shelf place"])
    assert (one["currency"], one["rdp"], one["selling_price"], one["is_estimated"], one["procurement"]) == ("USD", 10.0, 20.0, False, "must_buy")
    assert (two["brand"], two["is_generic"], two["sku_generated"], two["selling_price"], two["quantity"], two["rdp"], two["unmapped_columns"]) == ("Generic", True, True, 30.0, None, None, [])
    assert long["is_range"] and long["is_estimated"] and len(long["name"]) == 24999
    assert two["fingerprint"] == got[6]["fingerprint"] == "sku:" + two["sku"].lower().replace("-", "")
    scored = {r["row_index"]: r for r in imports.parsed(grid).collect()}
    assert "UNPARSED_COLUMNS" in scored[2]["issues"] and "UNPARSED_COLUMNS" not in scored[3]["issues"] and "MISSING_SPECS" not in scored[2]["issues"] and "MISSING_SPECS" in scored[3]["issues"] and scored[3]["quantity"] == 0
    assert ingest.parse(grid.limit(0)).count() == 0


def test_find(spark):
    stored = spark.createDataFrame([(1, "P-7", "sku:p7"), (2, "p 7", "sku:p7"), (3, None, None), (4, "", "")], "id int, sku string, fingerprint string")
    asked = spark.createDataFrame([("P7",), ("P7",), (None,), ("",), ("sku:p7",)], "asked string")
    assert sorted((r["asked"], r["id"]) for r in catalog.find(stored, asked, "asked", by="sku").collect()) == [("P7", 1), ("P7", 2)]
    assert sorted((r["asked"], r["id"]) for r in catalog.find(stored, asked, "asked").collect()) == [("sku:p7", 1), ("sku:p7", 2)]


@pytest.mark.parametrize("name", sorted(TYPED))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    value = lambda v: "NULL" if pd.isna(v) else (round(float(v), 6) if not isinstance(v, str) else v)
    rows = lambda df: sorted((tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert rows(TYPED[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())
