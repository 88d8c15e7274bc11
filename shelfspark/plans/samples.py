"""Derived inputs over the test tables for parsers, imports and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.sources.testdata import table


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a spreadsheet writes them, one row a part."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    price = F.format_string("%d", F.floor("p_retailprice"))
    money = (
        F.when(k % 7 == 0, F.concat(price, F.lit("-"), F.format_string("%d", F.floor("p_retailprice") + 50))).when(k % 7 == 1, F.concat(F.lit("$"), price)).when(k % 7 == 2, F.concat(price, F.lit(" EGP (est)")))
        .when(k % 7 == 3, F.lit("n/a")).when(k % 7 == 4, F.concat(F.lit("-"), size)).when(k % 7 == 5, F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(".50"))).otherwise(price)
    )
    percent = F.when(k % 3 == 0, F.concat(size, F.lit(".5%"))).when(k % 3 == 1, F.concat(F.lit("0."), F.lpad(size, 2, "0"))).otherwise(size)
    text = F.concat_ws(" ", F.col("p_name"), F.concat(size, F.lit("W")), F.concat(F.lit("USB-C"), F.lit(" cable"), F.lit("")), F.concat(size, F.lit(" cm")), F.concat(size, F.lit("GB")), F.concat((k % 5 + 1).cast("string"), F.lit(" years")), F.element_at(F.array(F.lit("brand new"), F.lit("refurbished"), F.lit("used"), F.lit("original pull")), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), money.alias("money"), percent.alias("percent"), F.concat(F.lit("1,"), F.lpad(size, 3, "0"), F.lit(" pcs")).alias("quantity"), text.alias("text"), F.concat(F.col("p_name"), F.lit(" | "), size, F.lit(" ports; "), F.col("p_brand")).alias("features"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sheets of parts with a banner, a header on row 2, dividers and totals."""
    k = F.col("p_partkey")
    sheet = F.concat(F.lit("sheet-"), (k % 5).cast("string"))
    empty = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part").select(
        F.lit("parts.xlsx").alias("file"), sheet.alias("sheet"), (k + 10).cast("int").alias("row_index"),
        F.when(F.floor(k / 5) % 20 == 0, F.array(F.concat(F.lit("Section "), F.floor(k / 100).cast("string")), empty, empty, empty, empty))
        .when(F.floor(k / 5) % 20 == 19, F.array(F.lit("Total"), empty, empty, F.lit("100"), empty))
        .otherwise(F.array("p_name", "p_brand", F.concat(F.lit("P-"), k.cast("string")), F.format_string("%d", F.floor("p_retailprice")), F.col("p_size").cast("string"))).alias("cells"),
    )
    sheets = spark.range(5).select(F.concat(F.lit("sheet-"), F.col("id").cast("string")).alias("sheet"))
    head = F.when(F.col("sheet") == "sheet-4", F.array(*(F.lit(x) for x in ("Product", "Brand", "Model", "RDP (USD)", "RRP ($)")))).otherwise(F.array(*(F.lit(x) for x in ("Product", "Brand", "SKU", "Price (EGP)", "Qty"))))
    banner = F.array(F.lit("Price list of the season"), empty, empty, empty, empty)
    tops = sheets.select(F.lit("parts.xlsx").alias("file"), "sheet", F.lit(1).alias("row_index"), banner.alias("cells")).unionByName(sheets.select(F.lit("parts.xlsx").alias("file"), "sheet", F.lit(2).alias("row_index"), head.alias("cells")))
    return tops.unionByName(part)


def store_and_drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A stored table and a re-import: other prices, a few locks, rows gone and rows new."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    no = F.array().cast("array<string>")
    stored = part.where(k % 10 != 0).select(
        F.concat(F.lit("sku:p"), k.cast("string")).alias("fingerprint"), k.alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("rdp"), F.col("p_size").cast("long").alias("quantity"), (k % 3 == 0).alias("is_verified"), F.lit(True).alias("is_active"),
        F.when(k % 3 == 0, "approved").otherwise("review").alias("lifecycle"), F.when(k % 7 == 0, F.array(F.lit("rdp"))).otherwise(no).alias("locked_fields"),
    )
    drafts = part.where(k % 8 != 0).select(F.concat(F.lit("sku:p"), k.cast("string")).alias("fingerprint"), k.alias("id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("rdp"), F.col("p_size").cast("long").alias("quantity"), F.lit("review").alias("lifecycle"))
    return stored, drafts


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the stored table: a price, a name as it is, a field that nobody edits, a price that is no number."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kind = lambda *of: F.element_at(F.array(*of), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), kind(F.lit("rdp"), F.lit("name"), F.lit("score"), F.lit("rdp")).alias("field"), kind(F.lit("1.5"), name, F.lit("1"), F.lit("abc")).alias("value"))


def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products to create, half of which are stored already."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 5 == 0).select(F.concat(F.lit("sku:p"), k.cast("string")).alias("fingerprint"), F.col("p_name").alias("name"), F.when(k % 3 == 0, F.col("p_retailprice")).alias("rdp"))


def slug_drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts that want their name's slug, with few SKUs, and the slugs that some of them hold already."""
    k = F.col("p_partkey")
    name = F.concat_ws(" ", "p_name", "p_brand")
    sku = F.concat(F.lit("P-"), (k % 3).cast("string"))
    drafts = table(spark, sf_dir, "part").select(F.concat(F.lit("sku:p"), k.cast("string")).alias("fingerprint"), k.alias("arrival"), name.alias("name"), sku.alias("sku"), F.lit(None).cast("string").alias("slug"))
    return drafts, spark.createDataFrame([], "slug string, owner string")


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated entries of every fourth part: with and without SKU and price, with conflicts, and gaps of every kind."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    every = lambda n, r=0: k % n == r
    no = F.array().cast("array<string>")
    texts = ("Not approved for sale", "No agreed sell price", "Photos belong to another unit", "Unbranded placeholder", "No model code confirmed", "Model DISPUTED", "price missing")
    gaps = F.when(every(9, 7), no).when(every(9, 8), F.array(F.lit("length unknown"), F.lit("price missing"))).otherwise(F.array(F.element_at(F.array(*(F.lit(t) for t in texts)), F.least(k % 9 + 1, F.lit(7)).cast("int"))))
    pricing = F.struct(F.lit("EGP").alias("currency"), (price - 100).alias("rdp"), F.lit(None).cast("double").alias("rrp"), price.alias("selling_price"), F.concat(F.lit("quote "), k.cast("string")).alias("price_source"))
    return table(spark, sf_dir, "part").where("p_partkey % 4 <> 3").select(
        F.concat(F.lit("Cables/"), "p_name", F.lit(" No. "), k.cast("string")).alias("folder"), F.when(~every(3), F.concat(F.lit("M-"), k.cast("string"))).alias("sku"), F.when(every(4), "label").alias("sku_evidence"), F.col("p_name").alias("name"),
        F.when(~every(5), F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("subcategory"), F.when(every(2), pricing).alias("pricing"), F.when(every(7, 1), "must_buy").alias("procurement"),
        F.when(~every(6), F.col("p_size")).cast("long").alias("quantity"), F.lit(None).cast("string").alias("supplier"), every(11).alias("is_generic"), F.when(every(8), F.create_map(F.lit("length_m"), F.lit("2"))).alias("specs"),
        F.when(every(7), F.array(F.lit("two sources give other costs"))).otherwise(no).alias("conflicts"), gaps.alias("gaps"),
    )


def photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of photos: three of every third part, one of them in a folder of a variant, and files that are none."""
    k = F.col("p_partkey")
    folder = F.concat(F.when(k % 2 == 0, "Cables").otherwise("Other"), F.lit("/"), "p_name", F.when(k % 5 == 0, F.concat(F.lit(" P-"), k.cast("string"))).otherwise(F.concat(F.lit(" "), k.cast("string"))))
    names = F.array(*(F.concat(folder, F.lit(n)) for n in ("/Black/1.JPG", "/2.jpg", "/1.png", "/notes.txt")))
    return table(spark, sf_dir, "part").where(k % 3 == 0).select(F.explode(names).alias("path"))


def photo_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that photos may belong to, of some parts under another name; a few hold a folder already."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(k % 2 == 0).select(
        k.alias("id"), F.when(k % 10 == 0, F.concat(F.lit("item "), k.cast("string"))).otherwise(F.concat_ws(" ", "p_name", k.cast("string"))).alias("name"), F.concat(F.lit("P-"), k.cast("string")).alias("sku"),
        F.when(k % 4 == 0, "Cables").otherwise(F.col("p_type")).alias("category"), F.lit(None).cast("string").alias("subcategory"), F.lit(True).alias("is_active"),
        F.when(k % 14 == 0, F.concat(F.lit("Cables/"), "p_name", F.lit(" "), (k + 4).cast("string"))).alias("image_source"),
        F.lit(None).cast("array<struct<path:string,url:string,variant:string,is_primary:boolean>>").alias("images"),
    )


def spec_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of every part as texts by name, some empty or unknown, with attributes, and its images."""
    k = F.col("p_partkey")
    when = lambda n, name, value: F.when(k % n == 0, F.struct(F.lit(name).alias("key"), value.alias("value")))
    size = F.col("p_size").cast("string")
    entries = F.array_compact(F.array(
        when(2, "power_wattage", size), when(3, "capacity", F.concat(size, F.lit("GB"))), when(5, "capacity_gb", size), when(1, "condition", F.element_at(F.array(*(F.lit(c) for c in ("unknown", "original_pull", "new"))), (k % 3 + 1).cast("int"))),
        when(7, "color", F.lit("Black")), when(4, "warranty_months", size), when(6, "interface", F.lit("")), when(8, "features", F.lit("fast|small")), when(9, "screen_size", F.lit("6 in")),
    ))
    image = lambda n, main, url: F.struct(F.when(url, F.concat(F.lit("https://x/"), k.cast("string"), F.lit(f"-{n}"))).alias("url"), F.when(k % 4 != 3, F.concat(F.lit("img/"), k.cast("string"), F.lit(f"-{n}"))).alias("path"), main.alias("is_primary"))
    images = F.array(image(1, F.lit(False), k % 2 == 0), image(2, k % 3 == 0, k % 2 == 1), image(3, F.lit(None).cast("boolean"), F.lit(False)))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.when(k % 50 != 0, F.col("p_type")).alias("category"), F.map_from_entries(entries).alias("specs"), images.alias("images"))


def repeated_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several edits of one price, the last of which is the smaller text, and of a name."""
    k = F.col("p_partkey")
    of = lambda seq, field, value: table(spark, sf_dir, "part").where(k % 3 == 0).select(k.alias("id"), F.lit(field).alias("field"), value.alias("value"), F.lit(seq).alias("seq"))
    return of(1, "rdp", F.lit("9")).unionByName(of(2, "rdp", F.lit("10"))).unionByName(of(1, "name", F.concat(F.lit("new "), k.cast("string"))))


def repeated_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of which several are one product, each with its own notes, extra columns and gaps in its fields."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("sku:"), (k % 700).cast("string")).alias("fingerprint"), (k % 7).cast("double").alias("score"), F.lit("f").alias("file"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("sheet"), k.alias("row_index"),
        F.when(k % 3 == 0, F.col("p_brand")).alias("brand"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("rdp"), F.concat(F.lit("note "), (k % 4).cast("string")).alias("notes"),
        F.create_map(F.concat(F.lit("col"), (k % 3).cast("string")), k.cast("string")).alias("extras"),
    )


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("run-"), k.cast("string")).alias("run_id"), F.when(k % 9 == 0, "failed").otherwise("completed").alias("status"), ((k * 37) % 500).alias("finished_at"))
