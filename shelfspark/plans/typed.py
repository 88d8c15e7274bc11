"""Named queries of whole rows of price lists: every field from cells of many kinds, and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import identity, specs
from shelfspark.functions import text as t
from shelfspark.operators import catalog, imports, ingest
from shelfspark.operators.slugs import resolve
from shelfspark.plans.deep import _of, _text, k, none
from shelfspark.plans.samples import slug_drafts
from shelfspark.sources import scratch
from shelfspark.sources.testdata import products, table

#: The headers of the list; in the trial sheet prices are dollars and the cost is an estimate.
HEADS = ("Product", "Brand", "Supplier / SKU", "Supplier", "Category", "Verified RDP (EGP)", "Plan RDP", "RRP", "Price (EGP)", "Local Market", "Qty", "Specs", "Capacity", "Interface", "Condition", "Warranty", "Color", "Action", "Notes", "Bin")
TRIAL = {"Verified RDP (EGP)": "RDP (approx, USD)", "Price (EGP)": "Price (USD)"}


def lit(s: str) -> Column:
    return F.lit(s)


def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every part on three sheets, its cells of as many kinds as its number's remainders give."""
    price, size = F.format_string("%d", F.floor("p_retailprice")), F.col("p_size").cast("string")
    cells = F.array(
        F.when(k() % 11 != 0, F.concat_ws(" ", _of(4, F.col("p_name"), _text("Anker ", F.col("p_name")), _text("soundcore by Anker ", F.col("p_name")), _text("power bank ", F.col("p_name"))), _of(3, lit("C-L"), lit("USB-A to HDMI"), lit("plain")))),
        _of(7, lit("n/a"), lit("dell / hp"), lit("SanDisk"), none(), none(), lit("acme-pro"), lit("HP, hp")),
        _of(5, _text("Joyroom / JR-", k()), _text("Joyroom JR-", k()), _text("JR-", k()), none(), _text("Acme ", k(), "X")), F.when(k() % 6 == 0, "Cairo  Trade"),
        _of(3, lit("Cables"), none(), lit("odd things")), F.when(k() % 9 != 1, price), F.when(k() % 2 == 0, _of(4, price, lit("1"), lit("7.5"), lit("1"))), F.when(k() % 8 == 0, _text(price, "-", size, "000")),
        F.when(k() % 4 == 1, _text(price, "0 (est)")).when(k() % 4 == 2, _text("1TB: ", price, " | 2TB: ", price, "9")), F.when(k() % 5 == 0, _text("$5-", size, "00 (street)")), _of(4, size, _text("-", size), none(), lit("1,200 pcs")),
        _of(6, _text(size, "W | 10,000mAh"), _text(size, " cm; usb 3.2 gen 2"), none(), lit("20K navy blue case"), lit("2 years, NVMe"), lit("colour: deep red | 512GB")), _of(4, none(), _text(size, "GB"), lit("2.5 TB fast"), lit("large")),
        F.when(k() % 10 == 3, "Type-C  port"), _of(5, none(), lit("Used – Original Pull"), lit("Brand new"), lit("refurb"), lit("draft")), _of(4, none(), lit("2"), lit("18 months"), lit("?")), F.when(k() % 7 == 2, "sky  blue"),
        _of(6, none(), lit("Avoid"), lit("Hold for test"), lit("approve"), lit("consider"), lit("later")), F.when(k() % 3 == 1, "checked"), F.when(k() % 2 == 1, _text(" B", k())),
    )
    sheet = _of(3, lit("Must Buy"), lit("Trial list"), lit("Stock"))
    rows = table(spark, sf_dir, "part").select(sheet.alias("sheet"), (k() + 10).cast("int").alias("row_index"), cells.alias("cells"))
    for name in ("Must Buy", "Trial list", "Stock"):
        heads = F.array(*(F.lit(TRIAL.get(h, h) if name == "Trial list" else h) for h in HEADS))
        rows = rows.unionByName(spark.range(1).select(F.lit(name).alias("sheet"), F.lit(1).alias("row_index"), heads.alias("cells")))
    return rows.select(F.lit("list.xlsx").alias("file"), "sheet", "row_index", "cells")


def typed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every row is and costs."""
    return ingest.parse(price_list(spark, sf_dir)).select(
        "sheet", "row_index", "name", "brand", "brand_multi", "supplier", "category_unmapped", F.when(~F.col("sku_generated"), F.col("sku")).alias("sku"), "currency", "rdp", "rrp", "selling_price", "market_low", "market_high",
        "quantity", "is_active", "is_generic", "procurement", "is_estimated", "is_range", "cost_mismatch", "notes", F.array_join("unmapped_columns", ";").alias("unmapped"),
        F.array_join(F.transform("variants", lambda v: F.concat(v["label"], F.lit("="), F.format_string("%.0f", v["value"]))), ";").alias("variants"),
    )


def typed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specifications of every row: those with a column of their own go before those found in texts."""
    rows = ingest.parse(price_list(spark, sf_dir))
    return rows.select("sheet", "row_index", *(F.col(f"specs.{c}").alias(c) for c in (*specs.COUNTED, "capacity_gb", "condition")), F.array_join("specs.features", "#").alias("features"), specs.count_given(F.col("specs"), F.col("extras")).cast("long").alias("n_specs"))


def typed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have columns that no field was found for, have no specifications, or an odd cost, by sheet."""
    rows = imports.parsed(price_list(spark, sf_dir))
    has = lambda code: F.sum(F.array_contains("issues", code).cast("long")).alias(code.lower())
    return rows.groupBy("sheet").agg(F.count("*").alias("n"), *(has(c) for c in ("UNPARSED_COLUMNS", "MISSING_SPECS", "COST_MISMATCH", "GENERIC_ITEM", "DRAFT_ITEM", "UNMAPPED_CATEGORY", "ESTIMATED_PRICE", "MISSING_COST")))


def mapping_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_list(spark, sf_dir)
    return imports.mapping_confidence(ingest.map_columns(rows, ingest.detect_headers(rows))).select("sheet", "confidence")


def find_by_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by SKUs as suppliers write them: another case and other marks."""
    wanted = table(spark, sf_dir, "supplier").select(_text(" p – ", F.col("s_suppkey")).alias("asked"))
    return catalog.find(products(spark, sf_dir, supplier=False), wanted, "asked", by="sku").select("asked", "id")


def find_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored products of incoming rows, by identity."""
    stored = products(spark, sf_dir, supplier=False).withColumn("fingerprint", t.fingerprint(F.col("sku"), F.col("brand"), F.col("name")))
    asked = table(spark, sf_dir, "supplier").select(_text("sku:p", F.col("s_suppkey")).alias("asked"))
    return catalog.find(stored, asked, "asked", by="fingerprint").select("asked", "id")


def slugs_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs where stored products hold some already: their owners keep them, others are numbered."""
    drafts, _ = slug_drafts(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", "p_brand")
    own = part.where(k() % 4 == 0).select(t.slugify(F.concat_ws(" ", name, _text("own ", k()))).alias("slug"), _text("sku:p", k()).alias("owner"))
    other = part.where(k() % 4 == 1).select(t.slugify(F.concat_ws(" ", name, _text("own ", k()))).alias("slug"), lit("sku:gone").alias("owner"))
    wants = drafts.withColumn("name", F.concat_ws(" ", "name", F.concat(F.lit("own "), F.col("arrival").cast("string"))))
    return resolve(wants, own.unionByName(other), save=scratch.save).select("fingerprint", "wanted", "slug")


def infer_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _of(5, F.concat_ws(" ", "p_name", lit("by Soundcore Anker")), F.concat_ws(" ", lit("WD"), "p_name"), F.concat_ws("-", lit("hp"), "p_name"), F.concat(F.col("p_name"), lit("dell")), lit(""))
    return table(spark, sf_dir, "part").select(k().alias("id"), identity.infer_brand(cell).alias("brand"))


def split_supplier_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = _of(6, _text("Joyroom / JR-", k()), _text("Anker A", k()), _text("A", k()), lit("two words"), none(), _text("/", k()))
    return table(spark, sf_dir, "part").select(k().alias("id"), identity.split_supplier_sku(cell).alias("s")).select("id", "s.supplier", "s.sku")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions over names: title case, labels, short forms, paths, Arabic."""
    cell = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), _of(3, lit(""), lit(" كابل"), lit(" a_b")))
    return table(spark, sf_dir, "part").select(
        k().alias("id"), t.contains_arabic(cell).alias("arabic"), t.title_case(cell).alias("title"), t.humanize(F.concat_ws("_", lit("PART"), "p_brand")).alias("label"), t.truncate(F.col("p_name"), 12).alias("short"),
        t.encode_path(F.concat(lit("Photos/"), "p_name", lit("/a b.jpg"))).alias("path"),
    )


TYPED = {f.__name__: f for f in (typed_drafts, typed_specs, typed_issues, mapping_confidence, find_by_sku, find_by_fingerprint, slugs_held, infer_brand, split_supplier_sku, text_keys)}
