"""A deterministic product table over the star schema: one row for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.money import js_round
from shelfspark.functions.text import slugify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def main_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of most units of each part, the smaller key among equals: two partial aggregates, no sort."""
    units = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("units"))
    best = units.groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("units", -F.col("l_suppkey"))).alias("s_suppkey"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    return best.join(names, "s_suppkey").select(F.col("l_partkey").alias("id"), "supplier")


def products(spark: SparkSession, sf_dir: str, supplier: bool = True) -> DataFrame:
    """The product table. `supplier=False` leaves the join with lineitem out where no query needs it."""
    k = F.col("p_partkey")
    price = F.col("p_retailprice")
    every = lambda n, r=0: k % n == r
    out = table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.when(~every(40), F.col("p_brand")).alias("brand"), F.when(~every(50), F.col("p_type")).alias("category"),
        F.when(~every(37), F.concat(F.lit("P-"), (k % 900).cast("string"))).alias("sku"),
        F.when(every(10), None).when((k % 10).between(1, 3), "USD").otherwise("EGP").alias("currency"),
        F.when(~every(13), price).alias("rdp"), F.when(every(7), js_round(price * 1.6)).alias("rrp"),
        F.when(every(17), None).when(every(101), price * 12).otherwise(js_round(price * (85 + (k * 7) % 90) / 100)).alias("asked"),
        F.when(every(6), js_round(price * (70 + (k * 3) % 60) / 100)).alias("market_high"),
        F.when(every(11), 0).otherwise(F.col("p_size")).cast("long").alias("quantity"), (k % 3).alias("reserved"),
        (k % 19 != 0).alias("is_active"), every(3).alias("is_verified"), every(23).alias("is_draft"), every(29).alias("is_generic"),
        F.element_at(F.array(*(F.lit(x) for x in ("must_buy", "test_buy", "avoid", "opportunity", "unclassified"))), (k % 5 + 1).cast("int")).alias("procurement"),
        F.element_at(F.array(*(F.lit(x) for x in ("new", "used", "unknown", "refurbished"))), (k % 4 + 1).cast("int")).alias("condition"),
        (k % 4 != 0).alias("has_image"), (k % 9 != 0).alias("has_specs"), (k % 3 != 0).alias("has_description"), every(31).alias("is_estimated"), every(43).alias("is_range"),
        every(47).alias("category_unmapped"), every(53).alias("cost_mismatch"), every(59).alias("sku_ambiguous"), every(61).alias("sku_corrected"),
        F.concat(F.lit("catalog-"), (k % 4).cast("string")).alias("source_catalog"), F.when(every(3), "approved").otherwise("review").alias("lifecycle"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.when(~every(21), F.concat_ws(" ", "p_type", (k % 3).cast("string"))).alias("subcategory"),
        slugify(F.concat_ws(" ", "p_name", k.cast("string"))).alias("slug"), ((k * 7919) % 100_003).alias("updated"),
    )
    out = out.withColumn("selling_price", F.coalesce("asked", "rrp")).drop("asked")
    return out.join(main_supplier(spark, sf_dir), "id", "left") if supplier else out.withColumn("supplier", F.lit(None).cast("string"))
