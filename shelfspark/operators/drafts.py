"""Typed product drafts of extracted rows: identity, prices, specifications, status and where they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import MONEY_FIELDS, POLICY, SHEET_PROCUREMENT
from shelfspark.functions import identity, money, specs
from shelfspark.functions.text import clean_text, fingerprint, given, let
from shelfspark.operators.spread import spread


def sheet_procurement(sheet: Column) -> Column:
    return reduce(lambda c, x: c.when(sheet.rlike(f"(?i){x[0]}"), x[1]), SHEET_PROCUREMENT[1:], F.when(sheet.rlike(f"(?i){SHEET_PROCUREMENT[0][0]}"), SHEET_PROCUREMENT[0][1]))


def _cell(name: str) -> Column:
    return given(clean_text(F.element_at("fields", name)))


def _section_category(section: Column) -> Column:
    """The category that a divider's text stands for, else the text."""
    return let(identity.normalize_category(section, F.lit("")), lambda c: F.when(c["matched"], c["category"]).otherwise(section))


def with_identity(rows: DataFrame) -> DataFrame:
    """Adds name, `_sku`, `_brand`, `_category`, `_generic` and supplier; rows without a name and an SKU cell go.

    A cell that joins supplier and SKU fills what its own columns leave open. The SKU cell, as it is written,
    stands for a missing name; the brand comes from its column, else the supplier, else the name.
    """
    split = identity.split_supplier_sku(_cell("supplier_sku"))
    out = rows.withColumn("_split", split)
    out = out.withColumns({"_supplier": F.coalesce(_cell("supplier"), "_split.supplier"), "_sku_cell": F.coalesce(_cell("sku"), "_split.sku")})
    out = out.withColumn("name", F.coalesce(_cell("name"), "_sku_cell")).where("name is not null")
    out = out.withColumn("_brand_cell", F.coalesce(_cell("brand"), "_supplier", identity.infer_brand(F.col("name"))))
    out = out.withColumns({
        "_brand": identity.normalize_brand(F.col("_brand_cell")), "_sku": identity.normalize_sku(F.col("_sku_cell")),
        "_category": identity.normalize_category(F.coalesce(_cell("category"), _section_category(F.col("section"))), F.col("name")),
    })
    notes = F.concat_ws(" ", _cell("notes"), _cell("action"))
    generic = identity.detect_generic(F.col("name"), F.col("_brand_cell"), notes, _cell("condition"), F.col("_sku.sku"))
    return out.withColumns({"supplier": F.coalesce("_supplier", "_brand.brand"), "_generic": generic}).drop("_split", "_supplier", "_sku_cell", "_brand_cell")


def with_amounts(rows: DataFrame) -> DataFrame:
    """Adds `_amounts`, parsed, in the order of MONEY_FIELDS; a column's own currency goes before that of its sheet."""
    hint = lambda name: F.element_at("hints", name)
    cells = F.array(*(F.struct(F.element_at("fields", a).alias("raw"), F.coalesce(hint(a)["currency"], F.col("sheet_currency")).alias("currency"), F.coalesce(hint(a)["is_estimate"], F.lit(False)).alias("is_estimate")) for a in MONEY_FIELDS))
    return rows.withColumn("_amounts", F.transform(cells, lambda c: money.parse_money(c["raw"], c["currency"], c["is_estimate"])))


def _amount(name: str) -> Column:
    return F.get("_amounts", F.lit(MONEY_FIELDS.index(name)))


def to_products(fields: DataFrame, currencies: DataFrame, default_currency: str = POLICY.base_currency) -> DataFrame:
    """Typed drafts, one for each data row with a name or an SKU.

    `fields` are the rows of `ingest.extract_fields`, `currencies` what each sheet's headers vote for. The
    currency is that of the cost, the price or the RRP, else the row's own, the sheet's, the default. Reported
    amounts stand in for missing ones; a quantity is at least 0, and null where none is told (imports count it
    as 0). Notes join the row's notes, its recommended action and what the market's cell says
    beside its numbers.
    """
    votes = currencies.select("file", "sheet", F.col("currency").alias("sheet_currency"))
    rows = with_amounts(with_identity(spread(fields.join(votes, ["file", "sheet"], "left"))))
    rows = rows.withColumn("specs", specs.extract_specs(lambda n: F.element_at("fields", n), F.col("_category.category")))
    value = lambda name: _amount(name)["value"]
    told = lambda name, *of: reduce(lambda a, b: a | b, (F.coalesce(_amount(o)[name], F.lit(False)) for o in of))
    priced = ("rdp", "selling_price", "rrp")
    currency = F.coalesce(*(_amount(p)["currency"] for p in priced), F.upper(_cell("currency")), "sheet_currency", F.lit(default_currency))
    rrp = F.coalesce(value("rrp"), value("rrp_reported"))
    sku = F.coalesce("_sku.sku", identity.generate_sku(F.col("name"), F.col("_brand.brand"), F.col("_category.category"), _cell("capacity")))
    market_note = F.concat(F.lit("market: "), _amount("market_price")["note"])
    action = F.coalesce(identity.detect_procurement(F.coalesce(_cell("action"), F.col("sheet"))), sheet_procurement(F.col("sheet")), F.lit("unclassified"))
    quantity = money.parse_integer(F.element_at("fields", "quantity"))
    tags = F.filter(F.split(F.coalesce(_cell("tags"), F.lit("")), r"\s*,\s*"), lambda t: t != "")
    return rows.select(
        fingerprint(sku, F.col("_brand.brand"), F.col("name")).alias("fingerprint"), "file", "sheet", "row_index", "name", F.col("_brand.brand").alias("brand"), F.col("_brand.is_multi").alias("brand_multi"),
        F.col("_category.category").alias("category"), F.col("_category.subcategory").alias("subcategory"), sku.alias("sku"), F.col("_sku.sku").isNull().alias("sku_generated"), F.col("_sku.alternates").alias("alternate_skus"), tags.alias("tags"),
        currency.alias("currency"), F.coalesce(value("rdp"), value("rdp_reported")).alias("rdp"), rrp.alias("rrp"), F.coalesce(value("selling_price"), rrp).alias("selling_price"),
        _amount("market_price")["min"].alias("market_low"), _amount("market_price")["max"].alias("market_high"), F.coalesce(_amount("selling_price")["variants"], _amount("rrp")["variants"], F.array().cast("array<struct<label:string,min:double,max:double,value:double,currency:string>>")).alias("variants"),
        F.when(quantity < 0, 0).otherwise(quantity).alias("quantity"), "supplier", _cell("warehouse").alias("warehouse"),
        (~F.col("_generic.is_draft")).alias("is_active"), F.col("_generic.is_draft").alias("is_draft"), (F.col("_generic.is_generic") | F.col("_brand.is_generic")).alias("is_generic"), action.alias("procurement"),
        told("is_estimated", *priced).alias("is_estimated"), told("is_range", *priced).alias("is_range"), (~F.col("_category.matched")).alias("category_unmapped"),
        F.coalesce(value("rdp") != value("rdp_reported"), F.lit(False)).alias("cost_mismatch"), F.col("_sku.is_ambiguous").alias("sku_ambiguous"), F.col("_sku.corrected_from").isNotNull().alias("sku_corrected"), F.col("_sku.corrected_from").alias("sku_corrected_from"),
        "specs", F.col("specs.condition").alias("condition"), F.size("specs.features").alias("n_features"), _cell("short_description").alias("description"), _cell("long_description").alias("long_description"),
        F.nullif(F.concat_ws("\n", _cell("notes"), _cell("action"), market_note), F.lit("")).alias("notes"), money.parse_percent(F.element_at("fields", "margin_reported")).alias("reported_margin"), value("extended_cost").alias("extended_cost"),
        "mapping_confidence", F.map_keys("extras").alias("unmapped_columns"), "extras",
    )
