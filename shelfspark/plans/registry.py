"""The named queries: (spark, folder of tables) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import identity, money, specs, text
from shelfspark.operators import analytics, catalog, ingest, pricing, quality, reports, slugs, store
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import with_quality
from shelfspark.operators.spread import spread
from shelfspark.plans.deep import DEEP
from shelfspark.plans.deep_oracles import ORACLES as DEEP_ORACLES
from shelfspark.plans.more import MORE
from shelfspark.plans.more_oracles import ORACLES as MORE_ORACLES
from shelfspark.plans.oracles import ORACLES as FIRST_ORACLES
from shelfspark.plans.requested import REQUESTED
from shelfspark.plans.requested_oracles import ORACLES as REQUESTED_ORACLES
from shelfspark.plans.samples import grid, new_rows, patches, raw_cells, slug_drafts, store_and_drafts
from shelfspark.plans.typed import TYPED
from shelfspark.plans.typed_oracles import ORACLES as TYPED_ORACLES
from shelfspark.sources.scratch import save
from shelfspark.sources.testdata import products, table

Query = Callable[[SparkSession, str], DataFrame]


def priced(spark: SparkSession, sf_dir: str, supplier: bool = False) -> DataFrame:
    return with_pricing(products(spark, sf_dir, supplier))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(priced(spark, sf_dir, supplier=True))


def _p(f: Callable[..., DataFrame], **how) -> Query:
    return lambda spark, sf_dir: f(priced(spark, sf_dir), **how)


def _s(f: Callable[..., DataFrame], **how) -> Query:
    return lambda spark, sf_dir: f(scored(spark, sf_dir), **how)


def recalculate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = F.when(F.col("id") % 5 == 0, F.col("margin") + 1).otherwise(F.col("margin"))
    return pricing.recalculate_counts(priced(spark, sf_dir).withColumn("margin", stale))


def rescore_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = F.when(F.col("id") % 4 == 0, F.col("score") - 1).when(F.col("id") % 4 == 1, F.col("score") + 1).otherwise(F.col("score"))
    return quality.rescore_counts(scored(spark, sf_dir).withColumn("was", was))


def _of_cells(**columns) -> Query:
    return lambda spark, sf_dir: spread(raw_cells(spark, sf_dir)).select("id", *(c().alias(n) for n, c in columns.items()))


def _flat(of: Callable, *names: str) -> Query:
    """The named fields of a struct column over the cells."""
    return lambda spark, sf_dir: spread(raw_cells(spark, sf_dir)).select("id", of().alias("s")).select("id", *(F.col(f"s.{n}").alias(n) for n in names))


def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("key_md5"))


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir, supplier=False).select("id", text.fingerprint(F.col("sku"), F.col("brand"), F.col("name")).alias("fingerprint"))


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(text.similarity(F.col("p_name"), F.concat_ws(" ", "p_name", "p_brand")), 3).alias("similarity"))


def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_headers(grid(spark, sf_dir)).select("sheet", "header_index")


def column_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir)
    return ingest.map_columns(rows, ingest.detect_headers(rows)).select("sheet", F.col("col").cast("long").alias("col"), "header", "field", "currency")


def sheet_currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir)
    return ingest.sheet_currency(ingest.map_columns(rows, ingest.detect_headers(rows))).select("sheet", "currency")


def section_fill_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir)
    return ingest.classify_rows(rows, ingest.detect_headers(rows)).select("sheet", "row_index", "kind", "section")


def import_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse(grid(spark, sf_dir)).select("sheet", "row_index", "name", "brand", "sku", "currency", "rdp", "rrp", "selling_price", "quantity")


def upsert_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*store_and_drafts(spark, sf_dir)).drop("locked_fields")


def import_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.import_run(spark, "parts", store.upsert(*store_and_drafts(spark, sf_dir)))


def archive_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.archive_stale(*store_and_drafts(spark, sf_dir)).select("fingerprint", "is_active", "is_verified", "lifecycle", "archived")


def _saved(df: DataFrame) -> DataFrame:
    """A written table in the folder that driver and executors share."""
    return save(df)


def resolve_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slugs.resolve(*slug_drafts(spark, sf_dir), save=_saved)


def patch_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = store.patch(store_and_drafts(spark, sf_dir)[0], patches(spark, sf_dir))
    return changed.select("id", "name", "rdp", F.array_join("locked_fields", ",").alias("locks"), F.array_join("changed_fields", ",").alias("changed"))


def patch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.patch_outcomes(store_and_drafts(spark, sf_dir)[0], patches(spark, sf_dir))


def unlock_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.unlock(store_and_drafts(spark, sf_dir)[0], ["rdp", "name"])
    return rows.select("id", F.array_join("unlocked", ",").alias("unlocked"), F.size("locked_fields").cast("long").alias("n_locked"))


def create_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.create(store_and_drafts(spark, sf_dir)[0], new_rows(spark, sf_dir))
    return rows.select("fingerprint", "name", "rdp", "lifecycle", "is_verified", F.array_join("locked_fields", ",").alias("locks"), "outcome")


def verify_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.verify(scored(spark, sf_dir)).select("id", "is_verified", "lifecycle", "refused")


def dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lower("p_name").alias("fingerprint"), (F.col("p_partkey") % 7).cast("double").alias("score"), F.col("p_partkey").alias("row_index"), F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).alias("rdp"))
    return ingest.dedupe(rows).select("fingerprint", "score", "row_index", "brand", "rdp", "n_sources")


def market_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by region and segment: the supplier roll-up's shape over the order tables."""
    o, c = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), money.total(F.col("o_totalprice")).alias("v"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = per.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "c_mktsegment").agg(F.sum("n").alias("orders"), money.js_round(money.total(F.col("v"))).alias("value"))


_c = F.col
QUERIES: dict[str, Query] = {
    "summary": _s(analytics.summary),
    **{f"inventory_by_{d}": (lambda spark, sf_dir, d=d: analytics.inventory_value(priced(spark, sf_dir, supplier=d == "supplier"), d)) for d in analytics.DIMENSIONS},
    "top_profitable_total": _p(analytics.top_profitable), "top_profitable_unit": _p(analytics.top_profitable, by="unit"), "top_profitable_min_margin": _p(analytics.top_profitable, min_margin=40),
    "margin_bands": _p(analytics.margin_bands), "low_margin_alerts": _p(analytics.low_margin, limit=None), "supplier_breakdown": _s(analytics.supplier_breakdown),
    "procurement_baskets": _p(analytics.procurement_baskets), "committed_total": _p(analytics.committed_total),
    "pricing_alerts": _p(pricing.alerts, limit=None), "loss_makers": _p(pricing.loss_makers, limit=None), "price_suggestions": _p(pricing.suggestions), "fx_normalized": _p(pricing.fx_normalized),
    "recalculate_counts": recalculate_counts, "quality_overview": _s(quality.overview), "issues_by_code": _s(quality.issues_by_code), "issues_by_severity": _s(quality.issues_by_severity),
    "score_distribution": _s(quality.score_distribution), "completeness": _s(quality.completeness_detail), "worst_products": _s(quality.worst), "worst_high_severity": _s(quality.worst, severity="high"),
    "duplicate_skus": _p(quality.duplicate_skus), "sku_collisions": _p(quality.sku_collisions), "near_duplicates": _p(quality.near_duplicates, threshold=0.7), "rescore_counts": rescore_counts,
    "admin_list_filtered": lambda spark, sf_dir: scored(spark, sf_dir).where(catalog.admin_filter(procurement="must_buy,test_buy", is_active=True, min_margin=10, max_quantity=40, has_issues=True)).select("id", "name", "margin", "quantity", "procurement"),
    "admin_search": lambda spark, sf_dir: scored(spark, sf_dir).where(catalog.admin_filter(search="P-77")).select("id", "sku"),
    "admin_list_sorted_page": lambda spark, sf_dir: catalog.page(catalog.admin_sort(priced(spark, sf_dir), "-margin,name"), 2, 25).select("id", "name", "margin"),
    "issue_code_filter": lambda spark, sf_dir: scored(spark, sf_dir).where(catalog.admin_filter(issue_code="MISSING_COST", issue_severity="high")).select("id", "name"),
    "public_list": _s(lambda df: catalog.page(catalog.public_list(df), 1, 60, 60)), "public_search": _s(catalog.public_list, search="p-7", sort="price_asc"),
    "public_price_range": _s(catalog.public_list, min_price=1000, max_price=20000, in_stock=True), "public_detail": _s(catalog.by_handle, handle="3"),
    "facet_categories": _p(catalog.facet, column="category"), "facet_brands": _p(catalog.facet, column="brand"), "facet_price_range": _p(catalog.facet_price_range), "sitemap": _s(catalog.sitemap), "related_products": _s(catalog.related),
    "publish_candidates": _s(lambda df: store.publish_candidates(df).drop("issues")), "publish_blocked_by_issue": _s(store.blocked_by_issue), "backfill_missing": _p(store.backfill_counts, fields=("brand", "category", "sku", "currency", "rdp", "rrp", "selling_price")),
    "missing_report": _p(reports.missing_report), "blocker_counts": _p(reports.blocker_counts), "open_questions": _s(reports.open_questions), "category_counts": _p(reports.category_counts),
    "normalize_key": normalize_key, "slugify": slugify, "fingerprint": fingerprint, "similarity_pairs": similarity_pairs,
    "generate_sku": _of_cells(sku=lambda: identity.generate_sku(_c("name"), _c("brand"), _c("category"), F.lit(None).cast("string"))),
    "parse_money": _flat(lambda: money.parse_money(_c("money")), "value", "min", "max", "is_range", "is_estimated", "currency", "ok"),
    "parse_percent": _of_cells(percent=lambda: money.parse_percent(_c("percent"))), "parse_integer": _of_cells(quantity=lambda: money.parse_integer(_c("quantity"))),
    "extract_wattage": _of_cells(wattage=lambda: specs.extract_wattage(_c("text"))), "extract_length": _of_cells(length_m=lambda: specs.extract_length(_c("text"))),
    "extract_capacity": _of_cells(capacity=lambda: specs.extract_capacity(_c("text")), capacity_gb=lambda: specs.extract_capacity_gb(_c("text"))), "extract_warranty": _of_cells(months=lambda: specs.extract_warranty_months(_c("text"))),
    "extract_condition": _of_cells(condition=lambda: specs.extract_condition(_c("text"))), "split_features": _of_cells(features=lambda: F.array_join(specs.split_features(_c("features")), "#")),
    "normalize_brand": _flat(lambda: identity.normalize_brand(_c("brand")), "brand", "is_generic", "is_multi"), "normalize_category": _flat(lambda: identity.normalize_category(_c("category"), _c("text")), "category", "subcategory", "matched"),
    "detect_generic": _flat(lambda: identity.detect_generic(_c("name"), _c("brand"), _c("text"), F.lit(None).cast("string")), "is_generic", "is_draft"),
    "header_detect": header_detect, "column_claims": column_claims, "sheet_currency_vote": sheet_currency_vote, "section_fill_forward": section_fill_forward, "import_products": import_products,
    "upsert_locked": upsert_locked, "import_totals": import_totals, "archive_stale": archive_stale,
    "resolve_slugs": resolve_slugs, "patch_fields": patch_fields, "patch_outcomes": patch_outcomes, "unlock_fields": unlock_fields, "create_products": create_products, "verify_products": verify_products, "dedupe_merge": dedupe_merge, "market_segments": market_segments,
}
QUERIES |= MORE | DEEP | TYPED | REQUESTED
ORACLES: dict[str, str] = {**FIRST_ORACLES, **MORE_ORACLES, **DEEP_ORACLES, **TYPED_ORACLES, **REQUESTED_ORACLES}
