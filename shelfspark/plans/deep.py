"""Named queries of substring joins, ranked search, workbooks, nested products, ordered merges and recalculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import identity
from shelfspark.operators import fold, imports, ingest, manifest, nested, pricing, reports, search
from shelfspark.operators.pricing import with_pricing
from shelfspark.plans import samples
from shelfspark.sources import scratch, workbook_format
from shelfspark.sources.testdata import products, table

def k() -> Column:
    return F.col("p_partkey")


def none() -> Column:
    return F.lit(None).cast("string")


def _text(*parts: object) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _of(n: int, *values: Column) -> Column:
    """One of the values, by the part's number."""
    return F.element_at(F.array(*values), (k() % n + 1).cast("int"))


def sku_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model cell for every part, of sixteen kinds that such cells have."""
    code = k() + 1000
    return table(spark, sf_dir, "part").select(k().alias("id"), _of(
        16, _text("JR-T", k()), _text("JR-QP", k(), " Mini"), _text("JR-PK", k(), " → JR-PR", k()), _text("Glow Mini (A", code, ")"), _text("A", code, " · RDP 880 / RRP 1,099"),
        _text("iP Series (model varies per phone, e.g. JR-PF", k(), ")"), F.lit("No verified EGP source yet"), F.lit("— (unassigned)"), _text("EGP 440 JR-PF", k()), _text("Varies A", code), _text("e.g. JR-PF", k()),
        _text("A1 A", code, " (B", code, ")"), _text("JR-A", k(), "/JR-B", k(), ", JR-C", k()), _text("USD $5-15 est., JR-X", k(), " JR-Y", k()), none(), _text("Old Series A", code, " and B", code),
    ).alias("cell"))


def normalize_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sku_cells(spark, sf_dir).select("id", identity.normalize_sku(F.col("cell")).alias("s"))
    return rows.select("id", "s.sku", "s.corrected_from", "s.is_ambiguous", F.array_join("s.alternates", ";").alias("alternates"))


def approval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets that approve every part for sale, with other columns in each, a banner and a blank row, and one sheet more."""
    sheet = F.when(k() % 2 == 0, "Must Buy").otherwise("Test Buy")
    sku = _of(5, _text("XM-", k(), "B"), _text("ZZ-", k()), _text("M-", k()), none(), _text("Set M-", k(), ", M-", k() + 1))
    price = F.when(k() % 7 != 0, F.format_string("%d", F.floor("p_retailprice")))
    margin, note = _of(3, F.lit("0.25"), F.lit("-0.1"), F.lit("n/a")), _text("checked\nby ", F.col("p_brand"))
    cells = F.when(k() % 2 == 0, F.array(F.col("p_name"), sku, F.lit("100"), F.lit("200"), price, margin, F.col("p_size").cast("string"), note)).otherwise(F.array(none(), price, sku, F.col("p_name"), F.lit("100"), F.lit("200"), F.col("p_size").cast("string"), margin))
    part = table(spark, sf_dir, "part").select(sheet.alias("sheet"), (k() + 10).cast("int").alias("row_index"), cells.alias("cells"))
    heads = {
        "Must Buy": ("Product", "Model / SKU", "RDP (verified)\nEGP", "RRP (verified) EGP", "Free-Ship List Price", "Margin % (after free ship)", "Qty", "Verification Notes"),
        "Test Buy": ("#", "FREE-SHIP list price", "Model / SKU of it", "Product name", "RDP (verified)", "RRP (verified)", "Qty", "Margin % (after free ship)"),
    }
    lit = lambda values: F.array(*(F.lit(v).cast("string") for v in values))
    one = spark.range(1)
    tops = [one.select(F.lit(s).alias("sheet"), F.lit(i).alias("row_index"), lit(v).alias("cells")) for s, h in heads.items() for i, v in ((1, ("Season",) + (None,) * 7), (2, (None,) * 8), (4, h))]
    tops.append(one.select(F.lit("Notes").alias("sheet"), F.lit(1).alias("row_index"), lit(("Product", "Model / SKU") + (None,) * 6).alias("cells")))
    rows = part
    for t in tops:
        rows = rows.unionByName(t)
    return rows.select(F.lit("plan.xlsx").alias("file"), "sheet", "row_index", "cells")


def approved_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.approved_skus(approval_grid(spark, sf_dir)).drop("file")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.manifest_entries(spark, sf_dir).select("sku")


def unlisted_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved rows whose SKU text holds no SKU of the manifest."""
    return reports.unlisted(reports.approved_skus(approval_grid(spark, sf_dir)), _listed(spark, sf_dir)).select("sheet", "row_index", "sku")


def admin_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(products(spark, sf_dir, supplier=False), "bolts P-77 -red", ("name", "brand", "sku"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best documents for a word of their texts: long fields, where words repeat."""
    return search.ranked(table(spark, sf_dir, "documents"), "tioning the", ("text",), "doc_id").orderBy(F.desc("score"), "doc_id").limit(25)


def report_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The report's three sheets: not live and why, approved but without photos, on sale."""
    entries = samples.manifest_entries(spark, sf_dir)
    sale = entries.where("pricing IS NOT NULL").orderBy(*reports.by_locale("category"), "pricing.selling_price", "folder")
    return {
        "Not live": manifest.blockers(entries).select(F.col("category").alias("Category"), F.col("name").alias("Product"), F.col("blocker").alias("Blocker"), F.col("action").alias("What would make it live"), F.col("folder").alias("Folder")),
        "Priced, no photos": reports.priced_no_photos(reports.approved_skus(approval_grid(spark, sf_dir)), entries.select("sku")),
        "On sale now": sale.select(F.col("category").alias("Category"), F.col("name").alias("Product"), F.col("sku").alias("SKU"), F.col("pricing.selling_price").alias("List price (EGP)"), F.col("pricing.rdp").alias("Cost (EGP)")),
    }


def report_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as a workbook and read again: every row of its sheets, in no order of its own."""
    path = scratch.fresh(spark, "report.xlsx")
    workbook_format.write(report_sheets(spark, sf_dir), path)
    rows = workbook_format.read(spark, path)
    return rows.select("sheet", "width", F.when(F.col("row_index") == 1, "head").otherwise("row").alias("kind"), F.array_join("cells", "|", "").alias("cells"))


def recalculate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = with_pricing(products(spark, sf_dir, supplier=False))
    stale = priced.withColumn("margin", F.when(F.col("id") % 5 == 0, F.col("margin") + 1).otherwise(F.col("margin")))
    return pricing.recalculated(stale).select("id", "margin", "band", "changed")


def import_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of an import's audit row, a row for each sheet and each kept skipped row."""
    rows = samples.grid(spark, sf_dir)
    skipped = imports.skipped_rows(ingest.classify_rows(rows, ingest.detect_headers(rows)))
    audit = imports.with_details(spark.range(1), ingest.sheet_report(rows), skipped)
    sheets = audit.select(F.explode("sheet_reports").alias("s")).select(F.lit("sheet").alias("kind"), "s.sheet", F.col("s.rows_read").alias("n"), F.lit(None).cast("string").alias("text"))
    return sheets.unionByName(audit.select(F.explode("skipped_rows").alias("s")).select(F.lit("skipped").alias("kind"), "s.sheet", F.col("s.row_index").cast("long").alias("n"), "s.text"))


def dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fold.dedupe(samples.repeated_drafts(spark, sf_dir), ["brand", "rdp"])
    return done.select("fingerprint", "sheet", "row_index", "brand", "rdp", "score", F.array_join("notes", ";").alias("notes"), "n_sources")


def nested_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored nested products of nine in ten parts: prices as a whole or the cost alone are locked in a few, some are verified."""
    locks = F.when(k() % 7 == 0, F.array(F.lit("pricing"))).when(k() % 7 == 1, F.array(F.lit("pricing.rdp"), F.lit("specs"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").where(k() % 10 != 0).select(
        _text("sku:p", k()).alias("fingerprint"), k().alias("id"), F.col("p_name").alias("name"),
        F.struct(F.lit("EGP").alias("currency"), F.col("p_retailprice").alias("rdp"), (F.col("p_retailprice") + 100).alias("selling_price")).alias("pricing"),
        F.struct(F.array(F.lit("old")).alias("features"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"), none().alias("color")).alias("specs"),
        F.struct(F.col("p_size").cast("long").alias("quantity"), F.struct(F.lit("A").alias("hall"), k().alias("shelf")).alias("place")).alias("inventory"),
        F.struct((k() % 3 == 0).alias("is_verified"), F.when(k() % 3 == 0, "approved").otherwise("review").alias("lifecycle")).alias("status"), F.struct(locks.alias("locked_fields")).alias("metadata"),
    )


def nested_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A re-import of nested drafts: locks hold their own path and all below it."""
    drafts = table(spark, sf_dir, "part").where(k() % 8 != 0).select(
        _text("sku:p", k()).alias("fingerprint"), k().alias("id"), F.struct((F.col("p_retailprice") + 1).alias("rdp"), (F.col("p_retailprice") + 200).alias("selling_price")).alias("pricing"),
        F.struct(F.array(F.lit("new"), F.lit("fast")).alias("features"), F.when(k() % 2 == 0, "red").alias("color")).alias("specs"), F.struct(F.struct((k() + 1).alias("shelf")).alias("place")).alias("inventory"),
        F.struct(F.lit(True).alias("is_verified"), F.lit("review").alias("lifecycle")).alias("status"),
    )
    done = nested.upsert(nested_products(spark, sf_dir), drafts)
    return done.select(
        "fingerprint", "name", "pricing.currency", "pricing.rdp", "pricing.selling_price", F.array_join("specs.features", ";").alias("features"), "specs.color", "inventory.place.hall", "inventory.place.shelf",
        "status.is_verified", "status.lifecycle", "outcome", "locks_kept",
    )


def nested_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of nested leaves: a cost, a list, a path that nobody edits, a cost that is no number, a name as it is."""
    part = table(spark, sf_dir, "part")
    edit = part.select(
        k().alias("id"), _of(5, F.lit("pricing.rdp"), F.lit("specs.features"), F.lit("status.is_verified"), F.lit("pricing.rdp"), F.lit("name")).alias("path"),
        _of(5, F.lit("1.5"), F.lit('["a","b"]'), F.lit("true"), F.lit("abc"), F.col("p_name")).alias("value"),
    )
    also = part.where(k() % 4 == 0).select(k().alias("id"), F.lit("specs.color").alias("path"), F.lit("blue").alias("value"))
    done = nested.patch(nested_products(spark, sf_dir), edit.unionByName(also))
    return done.select("id", "pricing.rdp", F.array_join("specs.features", ";").alias("features"), "specs.color", F.array_join("metadata.locked_fields", ";").alias("locks"), "outcome", F.array_join("changed", ";").alias("changed"), F.array_join("invalid", ";").alias("invalid"))


DEEP = {
    f.__name__: f
    for f in (normalize_sku, approved_skus, unlisted_skus, admin_search_ranked, search_documents, report_workbook, recalculate_rows, import_audit, dedupe_fold, nested_upsert, nested_patch)
}
