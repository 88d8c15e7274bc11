"""What a shop shows of one product: specifications, images, specification rows, the trail and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import humanize

#: Fixed values, in the order in which they are shown: specification, label, unit.
FIELDS = (
    ("power_wattage", "Power output", " W"), ("battery_capacity", "Battery capacity", " mAh"), ("capacity", "Capacity", ""), ("capacity_gb", "Capacity", " GB"), ("cable_type", "Connector", ""), ("length_m", "Length", " m"),
    ("interface", "Interface", ""), ("form_factor", "Form factor", ""), ("color", "Colour", ""), ("condition", "Condition", ""), ("warranty_months", "Warranty", " months"), ("compatibility", "Works with", ""),
)
SCALARS = ("power_wattage", "cable_type", "battery_capacity", "capacity", "capacity_gb", "interface", "form_factor", "length_m", "color", "warranty_months")
#: Those that count as specifications; more than these are attributes.
COUNTED = ("power_wattage", "cable_type", "battery_capacity", "capacity", "interface", "form_factor", "length_m", "color", "warranty_months")
LISTS = ("compatibility", "features")


def _there(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def to_specs(specs: Column) -> Column:
    """A map of texts without what is null or empty, an unknown condition or an empty list; slugs read as words."""
    own = F.map_filter(specs, lambda k, v: _there(v) & ~((k == "condition") & (v == "unknown")))
    label = lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.regexp_replace(F.replace(v, F.lit("_"), F.lit(" ")), "^.", ""))
    return F.transform_values(own, lambda k, v: F.when(k == "condition", label(v)).otherwise(v))


def to_images(images: Column) -> Column:
    """Addresses only, those without one left out, the primary ones first and otherwise in their order."""
    usable = F.transform(F.filter(images, lambda i: i.isNotNull() & (_there(i["url"]) | _there(i["path"]))), lambda i: F.struct(F.coalesce(i["url"], F.concat(F.lit("/"), i["path"])).alias("url"), F.coalesce(i["is_primary"], F.lit(False)).alias("is_primary")))
    return F.concat(F.filter(usable, lambda i: i["is_primary"]), F.filter(usable, lambda i: ~i["is_primary"]))


def count_specs(specs: Column) -> Column:
    """Specifications of a map: each counted one that is there, a list as one, and every attribute beside them."""
    known = F.map_filter(specs, lambda k, v: k.isin(*COUNTED, *LISTS) & _there(v))
    more = F.map_filter(specs, lambda k, _: ~k.isin(*(f for f, _, _ in FIELDS), *LISTS))
    return F.size(known) + F.size(more)


def spec_rows(specs: Column) -> Column:
    """Label and value of each specification in the order shown, a label once, then the attributes."""
    value = lambda f: F.element_at(specs, f)
    rows = []
    for i, (f, label, unit) in enumerate(FIELDS):
        earlier = [g for g, other, _ in FIELDS[:i] if other == label]
        free = ~F.coalesce(_there(value(earlier[0])), F.lit(False)) if earlier else F.lit(True)
        rows.append(F.when(_there(value(f)) & free, F.struct(F.lit(label).alias("label"), F.concat(value(f), F.lit(unit)).alias("value"))))
    own = {f for f, _, _ in FIELDS} | set(LISTS)
    more = F.transform(F.array_sort(F.map_entries(F.map_filter(specs, lambda k, v: ~k.isin(*own) & _there(v)))), lambda e: F.struct(humanize(e["key"]).alias("label"), e["value"].alias("value")))
    return F.concat(F.array_compact(F.array(*rows)), more)


def highlights(specs: Column, most: int = 3) -> Column:
    return F.slice(F.filter(spec_rows(specs), lambda r: ~r["label"].isin("Condition", "Colour")), 1, most)


def trail(df: DataFrame) -> DataFrame:
    """Home, category and product, each with where it leads; the product itself leads nowhere."""
    step = lambda label, href: F.struct(label.alias("label"), href.alias("href"))
    category = F.when(_there(F.col("category")), step(F.col("category"), F.concat(F.lit("/products?category="), F.replace(F.url_encode("category"), F.lit("+"), F.lit("%20")))))
    steps = F.array_compact(F.array(step(F.lit("Home"), F.lit("/")), step(F.lit("Products"), F.lit("/products")), category, step(F.col("name"), F.lit(None).cast("string"))))
    return df.select("id", F.posexplode(steps).alias("place", "step")).select("id", "place", "step.label", "step.href")


def structured_data(shown: DataFrame) -> DataFrame:
    """A product as JSON-LD; an offer is there only if the price is over 0."""
    offer = F.when(F.col("shown_price") > 0, F.struct(F.lit("Offer").alias("@type"), F.col("shown_price").alias("price"), F.coalesce("shown_currency", F.lit("EGP")).alias("priceCurrency"), F.concat(F.lit("https://schema.org/"), F.when(F.col("in_stock"), "InStock").otherwise("OutOfStock")).alias("availability")))
    brand = F.when(_there(F.col("brand")), F.struct(F.lit("Brand").alias("@type"), F.col("brand").alias("name")))
    return shown.select("id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), "name", "sku", "category", brand.alias("brand"), offer.alias("offers"))).alias("json_ld"))


def featured(categories: DataFrame, counts: DataFrame) -> DataFrame:
    """The featured categories with how many products each has; null where none has it."""
    return categories.join(counts.select(F.col("value").alias("category"), "n"), "category", "left")
