"""Named queries of manifests, photos, imports, edits and details."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import display, text
from shelfspark.operators import analytics, catalog, detail, images, imports, ingest, manifest, quality, store
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import with_quality
from shelfspark.plans import samples as s
from shelfspark.sources.testdata import products, table


def _join(c: str) -> F.Column:
    return F.array_join(F.col(c), ";").alias(c)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(with_pricing(products(spark, sf_dir, supplier=True)))


def _entries(f):
    return lambda spark, sf_dir: f(s.manifest_entries(spark, sf_dir))


def manifest_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.drafts(s.manifest_entries(spark, sf_dir))
    return made.select("folder", "fingerprint", "sku", "sku_generated", "currency", "selling_price", "margin", "quantity", "supplier", "procurement", "has_specs", "score", _join("notes"), _join("issues"))


def manifest_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = manifest.drafts(s.manifest_entries(spark, sf_dir))
    k = F.col("p_partkey")
    stored = table(spark, sf_dir, "part").where(k % 2 == 0).select(
        F.concat(F.lit("sku:m"), k.cast("string")).alias("fingerprint"), F.col("p_name").alias("name"), F.when(k % 6 == 0, 1.0).otherwise(F.col("p_retailprice")).alias("selling_price"), F.lit(True).alias("is_active"), F.lit(False).alias("is_verified"),
        F.lit("review").alias("lifecycle"), F.when(k % 10 == 0, F.array(F.lit("selling_price"))).otherwise(F.array().cast("array<string>")).alias("locked_fields"),
    )
    return manifest.import_entries(stored, made).select("fingerprint", "selling_price", "lifecycle", "is_active", "outcome", "archived")


def _saved(df: DataFrame) -> DataFrame:
    from shelfspark.plans.registry import _saved as save

    return save(df)


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.folders(s.photo_files(spark, sf_dir))


def _scores(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    return images.score_matches(_folders(spark, sf_dir), s.photo_products(spark, sf_dir), least=0.7, best=best)


def _links(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    return images.links(_folders(spark, sf_dir), s.photo_products(spark, sf_dir), 0.7, _saved, every)


def assign_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir, every=True)


def product_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = images.product_images(s.photo_files(spark, sf_dir))
    return listed.select("folder", F.posexplode("images").alias("place", "i")).select("folder", "place", "i.path", "i.variant", "i.is_primary")


def photo_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.overview(_folders(spark, sf_dir), _links(spark, sf_dir), s.photo_products(spark, sf_dir))


def linked_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.linked(_folders(spark, sf_dir), s.photo_products(spark, sf_dir)).select("folder", "n_images", "id")


def link_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    links = table(spark, sf_dir, "part").where(k % 18 == 0).select(F.concat(F.lit("Cables/"), "p_name", F.when(k % 5 == 0, F.concat(F.lit(" P-"), k.cast("string"))).otherwise(F.concat(F.lit(" "), k.cast("string")))).alias("folder"), (k - 4).alias("id"))
    done = images.link(s.photo_products(spark, sf_dir), links, images.product_images(s.photo_files(spark, sf_dir)))
    return done.select("id", "image_source", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"))


def unlink_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.photo_products(spark, sf_dir)
    return images.unlink(rows, rows.where("id % 28 = 0")).select("id", "image_source")


def public_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = s.spec_maps(spark, sf_dir).select("id", detail.to_specs(F.col("specs")).alias("specs"))
    return shown.select("id", F.explode("specs").alias("name", "value"))


def public_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = s.spec_maps(spark, sf_dir).select("id", F.posexplode(detail.to_images(F.col("images"))).alias("place", "i"))
    return shown.select("id", "place", "i.url", "i.is_primary")


def _rows_of(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shown = s.spec_maps(spark, sf_dir).select("id", detail.to_specs(F.col("specs")).alias("specs"))
        return shown.select("id", F.posexplode(f(F.col("specs"))).alias("place", "r")).select("id", "place", "r.label", "r.value")

    return query


def spec_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.spec_maps(spark, sf_dir).select("id", detail.count_specs(F.col("specs")).alias("n_specs"))


def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = detail.structured_data(catalog.public(_scored(spark, sf_dir)))
    at = lambda path: F.get_json_object("json_ld", path)
    return made.select("id", at("$.name").alias("name"), at("$.brand.name").alias("brand"), at("$.offers.price").cast("double").alias("price"), at("$.offers.priceCurrency").alias("currency"), at("$.offers.availability").alias("availability"))


def featured_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").where("p_partkey <= 40").select(F.when(F.col("p_partkey") % 10 == 0, "No such").otherwise(F.col("p_type")).alias("category")).distinct()
    return detail.featured(wanted, catalog.facet(with_pricing(products(spark, sf_dir, supplier=False)), "category"))


def issues_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", F.array_join(quality.ranked_issues(F.col("issues")), ",").alias("codes"))


def rescore_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_collisions(with_pricing(products(spark, sf_dir, supplier=True))).select("id", "score", "n_critical")


def dedupe_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = s.repeated_drafts(spark, sf_dir)
    listed = ingest.other_sources(drafts).groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("file", "sheet", "row_index"))).alias("rows"))
    merged = ingest.dedupe(drafts).join(listed, "fingerprint", "left")
    sources = F.coalesce(F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["sheet"], r["row_index"].cast("string"))), ";"), F.lit(""))
    extras = F.array_join(F.transform(F.array_sort(F.map_entries("extras")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return merged.select("fingerprint", "score", "row_index", "brand", "rdp", "n_sources", _join("notes"), sources.alias("sources"), extras.alias("extras"))


def draft_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.other_sources(s.repeated_drafts(spark, sf_dir)).select("fingerprint", "sheet", "row_index")


def draft_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.draft_quality(_scored(spark, sf_dir))


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sheet_report(s.grid(spark, sf_dir)).select("sheet", "rows_read", "data", "section", "title", "total", "skipped")


def import_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.totals(ingest.sheet_report(ingest.chosen(s.grid(spark, sf_dir), exclude=["SHEET-4"])))


def skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.grid(spark, sf_dir)
    return imports.skipped_rows(ingest.classify_rows(rows, ingest.detect_headers(rows))).drop("file")


def import_runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports.runs_page(s.import_runs(spark, sf_dir), 2, 20)


def _patched(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = store.locked(with_pricing(products(spark, sf_dir, supplier=True)))
        done = f(rows, s.repeated_patches(spark, sf_dir))
        audit = F.array_join(F.transform("overrides", lambda o: F.concat_ws(":", o["field"], o["next"])), ";")
        return done.select("id", "name", "rdp", "margin", "score", F.array_join("locked_fields", ",").alias("locks"), audit.alias("audit"))

    return query


def remove_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir, supplier=False)
    return store.remove(rows, rows.where("id % 12 = 0")).select("id", "is_active", "lifecycle")


def remove_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir, supplier=False)
    return store.remove(rows, rows.where("id % 12 = 0"), hard=True).select("id")


def create_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of which two have each key; the first by its place is made."""
    stored = s.store_and_drafts(spark, sf_dir)[0]
    new = s.new_rows(spark, sf_dir).withColumn("seq", F.lit(1))
    again = new.withColumns({"seq": F.lit(0), "name": F.concat(F.lit("first "), F.col("name"))})
    return store.create(stored, new.unionByName(again)).where("outcome <> 'kept'").select("fingerprint", "name", "outcome")


def verify_waived(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = store.verify(_scored(spark, sf_dir), waived=("MISSING_COST", "SELLING_BELOW_COST"), by="ann")
    return done.select("id", "is_verified", "verified_by", F.array_join(F.array_sort("waived"), ",").alias("waived"))


def brand_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as people write them: other case, marks and spaces."""
    return products(spark, sf_dir, supplier=False).where(catalog.admin_filter(brand=" brand-12,BRAND#13")).select("id", "brand")


def display_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_pricing(products(spark, sf_dir, supplier=False))
    c = lambda f, of, *more: f(F.col(of), *more)
    return rows.select("id", c(display.money, "selling_price", F.col("currency")).alias("price"), c(display.money_compact, "norm_selling_price", F.lit("EGP")).alias("compact"), c(display.percent, "margin").alias("margin"), c(display.number, "quantity").alias("quantity"))


def posix_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.to_posix(F.concat(F.col("p_type"), F.lit("\\"), F.col("p_brand"))).alias("path"))


MORE = {
    "manifest_drafts": manifest_drafts, "manifest_open_questions": _entries(manifest.open_questions), "manifest_gap_split": _entries(manifest.gap_split), "manifest_blockers": _entries(manifest.blockers),
    "manifest_import": manifest_import, "manifest_quality": _entries(lambda e: manifest.quality_summary(manifest.drafts(e))), "manifest_priced": _entries(lambda e: manifest.priced(e).select("folder", "pricing.selling_price")),
    "photo_folders": _folders, "product_images": product_images, "photo_scores": _scores, "assign_folders": assign_folders, "photo_suggestions": lambda spark, sf_dir: images.suggestions(_scores(spark, sf_dir, best=3)),
    "photo_overview": photo_overview, "unmatched_folders": lambda spark, sf_dir: images.unmatched(_folders(spark, sf_dir), _links(spark, sf_dir, every=True)).select("folder"), "linked_folders": linked_folders, "link_folders": link_folders, "unlink_products": unlink_products,
    "public_specs": public_specs, "public_images": public_images, "spec_rows": _rows_of(detail.spec_rows), "spec_highlights": _rows_of(detail.highlights), "spec_counts": spec_counts, "json_ld": json_ld,
    "breadcrumbs": lambda spark, sf_dir: detail.trail(s.spec_maps(spark, sf_dir)), "featured_categories": featured_categories,
    "dashboard_derived": lambda spark, sf_dir: analytics.dashboard_derived(_scored(spark, sf_dir)), "chart_top": lambda spark, sf_dir: analytics.chart_top(analytics.inventory_value(with_pricing(products(spark, sf_dir, supplier=False)), "brand")).select("group", "cost", "retail"),
    "fix_queue": lambda spark, sf_dir: quality.fix_queue(_scored(spark, sf_dir)), "issues_ranked": issues_ranked, "collision_members": lambda spark, sf_dir: quality.collision_members(products(spark, sf_dir, supplier=False)), "rescore_collisions": rescore_collisions,
    "dedupe_full": dedupe_full, "draft_sources": draft_sources, "draft_quality": draft_quality, "import_report": import_report, "import_report_totals": import_report_totals, "skipped_rows": skipped_rows, "import_runs_page": import_runs_page,
    "patch_reprice": _patched(store.apply_patch), "patch_prices": _patched(store.update_price), "remove_soft": remove_soft, "remove_hard": remove_hard, "create_repeated": create_repeated, "verify_waived": verify_waived,
    "brand_filter": brand_filter, "public_subcategory": lambda spark, sf_dir: catalog.public_list(_scored(spark, sf_dir), subcategory=["STANDARD 1", "ECONOMY 2", "PROMO 0", "SMALL 1"], has_image=True).select("id", "slug", "shown_price"),
    "display_money": display_money, "posix_paths": posix_paths,
}
