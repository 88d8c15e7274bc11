"""Missing-data reports: why a product is not for sale, open questions, and counts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.substrings import holding

#: What keeps a product from sale, the first that holds: condition over product columns, blocker, action.
BLOCKERS = (
    ("selling_price IS NULL AND rdp IS NULL", "no_price", "ask the supplier for a quote"),
    ("selling_price IS NULL", "no_selling_price", "set a selling price"),
    ("currency IS NULL", "no_currency", "find out the currency"),
    ("sku IS NULL", "no_sku", "find the model code"),
    ("NOT has_image", "no_image", "take photos"),
    ("NOT is_verified", "not_verified", "review and verify"),
)


def _ladder(at: int) -> Column:
    return F.coalesce(*(F.expr(f"CASE WHEN {b[0]} THEN '{b[at]}' END") for b in BLOCKERS), F.lit("none" if at == 1 else "nothing to do"))


def missing_report(priced: DataFrame) -> DataFrame:
    """Every product that is not live, with its first blocker and what to do."""
    live = F.col("is_active") & F.col("is_verified") & (F.coalesce("selling_price", F.lit(0.0)) > 0)
    return priced.where(~F.coalesce(live, F.lit(False))).select("id", "name", "category", _ladder(1).alias("blocker"), _ladder(2).alias("action"))


def blocker_counts(priced: DataFrame) -> DataFrame:
    return missing_report(priced).groupBy("blocker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "blocker")


def open_questions(scored: DataFrame) -> DataFrame:
    """Conflicts and gaps of every product, one row each."""
    conflicts = scored.select("id", F.lit("conflict").alias("kind"), F.explode(F.filter("issues", lambda c: c.isin("COST_MISMATCH", "AMBIGUOUS_SKU", "MARKET_BELOW_COST"))).alias("what"))
    gaps = scored.select("id", F.lit("gap").alias("kind"), F.explode("missing").alias("what"))
    return conflicts.unionByName(gaps)


def unlisted(workbook: DataFrame, listed: DataFrame) -> DataFrame:
    """Workbook rows whose SKU text holds none of the listed SKUs, as it stands and inside longer words too."""
    return holding(workbook, "sku", listed, "sku", none=True)


#: The sheets that approve products, and the labels that their columns' heads hold.
APPROVING = ("Must Buy", "Test Buy")
LABELS = {"product": "Product", "sku": "Model / SKU", "rdp": "RDP (verified", "rrp": "RRP (verified", "list": "Free-Ship List Price", "margin": "Margin % (after free ship)", "qty": "Qty", "note": "Verification Notes"}


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "))


def approved_skus(grid: DataFrame, sheets: tuple[str, ...] = APPROVING) -> DataFrame:
    """The products that the approving sheets of a grid (file, sheet, row_index, cells) list with a price.

    A sheet's head is its second row that is not blank, found by two minima a sheet; a column is the first
    whose head holds the label, in any case. Rows after it count if they have a product and a list price.
    Prices and quantities are as they stand; a margin that is no number is null.
    """
    rows = grid.where(F.col("sheet").isin(*sheets) & F.exists("cells", lambda c: c.isNotNull()))
    at = ["file", "sheet"]
    first = rows.groupBy(*at).agg(F.min("row_index").alias("_first"))
    head = rows.join(first, at).where("row_index > _first").groupBy(*at).agg(F.min_by("cells", "row_index").alias("_head"), F.min("row_index").alias("_at"))
    labels = F.transform("_head", lambda h: F.lower(_clean(h)))
    where = {n: _first_holding(labels, text.lower()) for n, text in LABELS.items()}
    placed = head.select(*at, "_at", *(w.alias(f"_{n}") for n, w in where.items()))
    cell = lambda n: F.when(F.col(f"_{n}") >= 0, F.get("cells", F.col(f"_{n}")))
    own = rows.join(placed, at).where("row_index > _at").select("file", "sheet", "row_index", *(cell(n).alias(n) for n in LABELS))
    own = own.where("product IS NOT NULL AND list IS NOT NULL AND list <> ''")
    return own.select(*at, "row_index", _clean(F.col("sku")).alias("sku"), _clean(F.col("product")).alias("product"), "rdp", "rrp", "list", F.col("margin").try_cast("double").alias("margin"), "qty", _clean(F.col("note")).alias("note"))


def _first_holding(labels: Column, text: str) -> Column:
    """The place of the first label that holds the text, -1 if none does."""
    return (F.array_position(F.transform(labels, lambda h: F.contains(h, F.lit(text))), F.lit(True)) - 1).cast("int")


#: What the report says of products that are approved but have no photos.
NO_PHOTOS = ("No photos in New Catalog/ — nothing to show a customer", "Add a folder of product photos under New Catalog/ and re-import.")
AT_A_LOSS = ("No photos in New Catalog/ — and it sells below cost at this list price", "Re-check the cost before anything else: at this list price the sale loses money. Then photograph it.")


def by_locale(*columns: str) -> list[Column]:
    """Sort keys in the order of a language's letters, whatever their case and accents: Spark's UNICODE collation."""
    return [F.collate(F.coalesce(F.col(c).cast("string"), F.lit("")), "UNICODE") for c in columns]


def priced_no_photos(approved: DataFrame, listed: DataFrame) -> DataFrame:
    """The report's sheet of approved products that no listed SKU claims, in the order of their SKUs."""
    loss = F.coalesce(F.col("margin") < 0, F.lit(False))
    rows = unlisted(approved, listed).orderBy(*by_locale("sku"), "file", "sheet", "row_index")
    return rows.select(
        F.col("sku").alias("SKU"), F.col("product").alias("Product"), F.col("sheet").alias("Approved on"), F.col("rdp").alias("Cost (EGP)"), F.col("rrp").alias("RRP (EGP)"), F.col("list").alias("List price (EGP)"),
        F.when(F.col("margin").isNull(), "").otherwise(F.concat(F.format_string("%.1f", F.col("margin") * 100), F.lit("%"))).alias("Margin after free ship"), F.col("qty").alias("Planned qty"),
        F.when(loss, AT_A_LOSS[0]).otherwise(NO_PHOTOS[0]).alias("Why it is not live"), F.when(loss, AT_A_LOSS[1]).otherwise(NO_PHOTOS[1]).alias("What would make it live"), F.col("note").alias("Workbook note"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("category", F.lit("(none)")).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
