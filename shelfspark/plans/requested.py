"""Named queries of what comes from outside and of start pages: requests and edits checked, pages, quotes, previews, the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import display
from shelfspark.operators import analytics, catalog, imports, pricing, quality, requests
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import with_quality
from shelfspark.plans.deep import _of, _text, k, none
from shelfspark.plans.samples import grid
from shelfspark.sources.testdata import products, table

#: What an admin's address asks for, as texts.
ASKED = {"min_margin": "10", "max_quantity": "40", "is_active": "true", "procurement": "must_buy, test_buy,", "has_issues": "1", "page": "3", "limit": "20", "utm": "x"}
SHOP = {"brand": ["Brand#11,Brand#22,Brand#33", "Brand#44"], "min_price": "1000", "max_price": "-3", "sort": "price_asc", "page": "1"}


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(with_pricing(products(spark, sf_dir)))


def requests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every part, its texts right and wrong by the part's number."""
    size, lit = F.col("p_size").cast("string"), F.lit
    given = {
        "page": _of(7, lit("0"), lit("2"), lit("x"), lit("2.0"), none(), none(), lit("")), "limit": _of(5, lit("500"), lit("10"), none(), none(), none()), "min_price": _of(4, size, lit("-5"), none(), lit("1e999")),
        "max_price": F.when(k() % 4 == 0, "20"), "min_quality": F.when(k() % 6 == 0, "101"), "max_quantity": _of(6, none(), lit("2.5"), lit("40"), none(), lit(" 7 "), none()), "is_active": _of(3, lit("true"), lit("yes"), lit("0")),
        "currency": _of(8, lit("USD"), lit("usd"), none(), none(), none(), none(), none(), none()), "brand": F.when(k() % 2 == 0, F.concat(F.col("p_brand"), lit(", Acme,,"))), "search": F.concat(lit("  "), F.col("p_name"), lit(" ")), "utm": lit("1"),
    }
    asked = table(spark, sf_dir, "part").select(k().alias("id"), F.create_map(*(x for name, v in given.items() for x in (lit(name), v))).alias("given"))
    of = lambda c, name: F.col(c)[name]
    return requests.checked(asked).select(
        "id", "page", "limit", "sort", "currency", F.array_join("errors", ";").alias("errors"), of("numbers", "min_price").alias("min_price"), of("numbers", "max_quantity").alias("max_quantity"), of("flags", "is_active").alias("is_active"),
        F.array_join(of("lists", "brand"), "|").alias("brands"), of("texts", "search").alias("search"), (F.size("numbers") + F.size("flags") + F.size("lists") + F.size("texts")).cast("long").alias("n"),
    )


def edits_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit for every part, some of which may not be made."""
    lit = F.lit
    field = _of(11, lit("name"), lit("name"), lit("brand"), lit("rdp"), lit("rdp"), lit("quantity"), lit("currency"), lit("lifecycle"), lit("is_active"), lit("score"), lit("selling_price"))
    value = _of(11, F.col("p_name"), lit(" x "), F.repeat(F.col("p_name"), 9), F.col("p_retailprice").cast("string"), lit("-1"), lit("2.5"), lit("eur"), lit("approved"), lit("maybe"), lit("1"), none())
    edits = table(spark, sf_dir, "part").select(k().alias("id"), field.alias("field"), value.alias("value"))
    return requests.checked_edits(edits).select("id", "field", "error")


def requested_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of the page that an admin's address asks for."""
    filters, page, limit, _ = requests.admin_query(ASKED)
    return requests.page_row(_scored(spark, sf_dir).where(catalog.admin_filter(**filters)), page, limit)


def shop_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that a shop's address asks for."""
    asked = requests.shop_query(SHOP)
    page, limit = int(asked.pop("page")), asked.pop("limit")
    return catalog.page(catalog.public_list(_scored(spark, sf_dir), **asked), page, limit).select("id", "brand", "shown_price")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A what-if for every part: costs in full and in halves, none, and prices without an RRP or the other way round."""
    price, no = F.col("p_retailprice"), F.lit(None).cast("double")
    asked = table(spark, sf_dir, "part").select(k().alias("id"), _of(5, price, price * 2, F.lit(0.0), no, price).alias("rdp"), _of(3, no, price + 100, price * 3).alias("selling_price"), F.when(k() % 2 == 0, price + 500).alias("rrp"), F.lit("egp").alias("currency"))
    return pricing.quotes(asked, 30).select("id", "currency", "selling_price", "margin", "gross_margin", "margin_value", "band", "break_even", "price_at_target", "price_at_warn")


def preview_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skipped rows that the preview of an import shows: the first 100."""
    return imports.preview(grid(spark, sf_dir)).skipped.select("sheet", "row_index", "reason", "text")


def preview_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of an import's preview where only some sheets are asked for."""
    return imports.preview(grid(spark, sf_dir), only=["sheet-1", "sheet-2", "sheet-3"], exclude=["sheet-3"]).totals


def dashboard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.dashboard_groups(_scored(spark, sf_dir))


def rubric_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rubric_use(_scored(spark, sf_dir))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the day they were made, as it is shown and as ISO text."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(display.day(at).alias("day"), display.iso(at).alias("iso")).groupBy("day", "iso").agg(F.count("*").alias("n"))


REQUESTED = {f.__name__: f for f in (requests_checked, edits_checked, requested_page, shop_page, quotes, preview_skipped, preview_sheets, dashboard_groups, rubric_use, order_days)}
