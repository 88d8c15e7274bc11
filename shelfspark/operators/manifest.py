"""Curated entries to products: drafts with their conflicts and gaps, open questions, blockers and the import.

An entry: folder, sku, sku_evidence, name, brand, category, subcategory, pricing (currency, rdp, rrp,
selling_price, price_source) or null, procurement, quantity, supplier, is_generic, specs, conflicts, gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.money import js_round
from shelfspark.functions.text import fingerprint
from shelfspark.operators import store
from shelfspark.operators.detail import count_specs
from shelfspark.operators.pricing import with_pricing
from shelfspark.operators.quality import with_quality

SCHEMA = (
    "folder string, sku string, sku_evidence string, name string, brand string, category string, subcategory string, "
    "pricing struct<currency:string,rdp:double,rrp:double,selling_price:double,price_source:string>, procurement string, quantity long, supplier string, "
    "is_generic boolean, specs map<string,string>, conflicts array<string>, gaps array<string>"
)
#: What a gap says, the blocker it means and what to do, the first that holds.
BLOCKERS = (
    ("(?i)Not approved for sale", "Not approved for sale", "Decide whether to stock it despite the thin margin. If yes, agree a sell price and it lists like any other."),
    ("(?i)No agreed sell price", "No agreed sell price", "Agree a sell price. The list price is that plus 45 EGP shipping — the workbook quotes only a reference RRP, which is not a price we can charge."),
    ("(?i)Photos belong to", "Wrong photos, no price", "Photograph the actual unit, confirm the model code, then get a supplier quote. The photos here are of a different product."),
    ("(?i)Unbranded placeholder", "Unidentified product", "Say what this actually is — brand, model, length or wattage — then get a supplier quote. Nothing about it is known beyond the photo."),
    ("(?i)No model code confirmed|unresolved|disputed|different model", "Model code unconfirmed, no price", "Confirm which model this is, then get a supplier quote for that exact code."),
)
OTHERWISE = ("No price quoted", "Get a supplier quote, then agree a sell price.")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON, one a line."""
    return spark.read.schema(SCHEMA).json(path)


def priced(entries: DataFrame) -> DataFrame:
    return entries.where("pricing IS NOT NULL")


def placeholder_sku(folder: Column) -> Column:
    """The last three words of the folder, at most 20 characters of them, and a short digest of all of it."""
    words = F.split(F.trim(F.regexp_replace(folder, "[^A-Za-z0-9]+", " ")), " ")
    last = F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(3))
    return F.concat(F.lit("BH-"), F.substring(F.upper(F.array_join(last, "-")), 1, 20), F.lit("-"), F.upper(F.substring(F.sha1(folder.cast("binary")), 1, 4)))


def _texts(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def drafts(entries: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """A scored draft of every entry; each conflict is a SOURCE_CONFLICT and each gap an INCOMPLETE_SOURCE_DATA of its own.

    `images` has folder and images (see images.product_images). Entries without a price stay without one.
    """
    labelled = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    notes = F.concat(F.array_compact(F.array(labelled("SKU evidence", F.col("sku_evidence")), labelled("Price source", F.col("pricing.price_source")))), _texts("conflicts"), _texts("gaps"))
    specs = F.coalesce("specs", F.create_map().cast("map<string,string>"))
    own_sku = F.nullif("sku", F.lit(""))
    known = F.coalesce(own_sku, placeholder_sku(F.col("folder")))
    rows = entries if images is None else entries.join(images.select("folder", "images"), "folder", "left")
    shown = F.coalesce("images", F.array()) if images is not None else F.array()
    p = lambda name: F.col(f"pricing.{name}").alias(name)
    no = F.lit(False)
    flat = rows.select(
        "folder", fingerprint(known, F.col("brand"), F.col("name")).alias("fingerprint"), "name", "brand", known.alias("sku"), own_sku.isNull().alias("sku_generated"), "category", "subcategory",
        F.array_compact(F.array("category", "subcategory")).alias("category_path"), F.coalesce("pricing.currency", F.lit("EGP")).alias("currency"), p("rdp"), p("rrp"), p("selling_price"), p("price_source"),
        F.coalesce("quantity", F.lit(0)).cast("long").alias("quantity"), F.coalesce("supplier", "brand").alias("supplier"), F.lit(True).alias("is_active"), F.coalesce("is_generic", no).alias("is_generic"), no.alias("is_draft"), no.alias("is_verified"),
        F.lit("review").alias("lifecycle"), F.coalesce("procurement", F.lit("unclassified")).alias("procurement"), F.coalesce(F.element_at(specs, "condition"), F.lit("unknown")).alias("condition"), (count_specs(specs) > 0).alias("has_specs"),
        (F.size(shown) > 0).alias("has_image"), no.alias("has_description"), F.lit(None).cast("double").alias("market_high"), *(no.alias(c) for c in ("is_estimated", "is_range", "category_unmapped", "cost_mismatch", "sku_ambiguous", "sku_corrected")),
        notes.alias("notes"), _texts("conflicts").alias("conflicts"), _texts("gaps").alias("gaps"),
        F.concat(F.transform(_texts("conflicts"), lambda _: F.lit("SOURCE_CONFLICT")), F.transform(_texts("gaps"), lambda _: F.lit("INCOMPLETE_SOURCE_DATA"))).alias("extra_issues"),
    )
    return with_quality(with_pricing(flat))


def open_questions(entries: DataFrame) -> DataFrame:
    """A row for each conflict and each gap."""
    of = lambda kind, c: entries.select("folder", "name", F.lit(kind).alias("kind"), F.explode(_texts(c)).alias("text"))
    return of("conflict", "conflicts").unionByName(of("gap", "gaps"))


def gap_split(entries: DataFrame) -> DataFrame:
    """Open questions as the report has them: no price quoted, sources that disagree, gaps other than of the price."""
    unpriced = entries.where("pricing IS NULL").select("folder", F.lit("unpriced").alias("part"), F.col("name").alias("text"))
    asked = open_questions(entries).where(~((F.col("kind") == "gap") & F.col("text").rlike("(?i)price")))
    return unpriced.unionByName(asked.select("folder", F.when(F.col("kind") == "conflict", "conflict").otherwise("non_price_gap").alias("part"), "text"))


def blockers(entries: DataFrame) -> DataFrame:
    """Why an entry without a price is not for sale and what to do, by what its gaps say; by blocker, then category."""
    said = F.array_join(_texts("gaps"), " ")
    pick = lambda at: F.coalesce(*(F.when(said.rlike(b[0]), F.lit(b[at])) for b in BLOCKERS), F.lit(OTHERWISE[at - 1]))
    return entries.where("pricing IS NULL").select("folder", "name", "category", pick(1).alias("blocker"), pick(2).alias("action")).orderBy("blocker", "category", "folder")


def stored_state(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Each draft and whether it is stored already, by fingerprint."""
    known = stored.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    return drafts(entries).join(known, "fingerprint", "left").select("folder", "fingerprint", F.when(F.col("_known"), "update").otherwise("create").alias("plan"))


def import_entries(stored: DataFrame, made: DataFrame, archive: bool = True) -> DataFrame:
    """The stored table after an import of drafts, with each row's outcome; rows that no entry names are archived."""
    done = store.upsert(stored, made.select(*(c for c in made.columns if c in stored.columns)))
    return store.archive_stale(done, made) if archive else done.withColumn("archived", F.lit(False))


def quality_summary(made: DataFrame) -> DataFrame:
    """How many drafts, their mean score, and how many of their issues have each code."""
    codes = made.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    mean = made.agg(js_round(F.sum(F.col("score").cast("decimal(20,4)")).cast("double") / F.nullif(F.count("score"), F.lit(0)), 1).alias("avg_score"), F.count("*").alias("drafts"))
    return codes.join(F.broadcast(mean), how="cross").select("code", "n", "avg_score", "drafts")  # one row
