"""Admin and public listings: filters, sorts, pages, facets and the projection that may be shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import normalize_key, sku_key, slugify
from shelfspark.operators.quality import severity_of

MEMBER = {"category": "category", "subcategory": "subcategory", "supplier": "supplier", "source_catalog": "source_catalog", "procurement": "procurement", "lifecycle": "lifecycle", "currency": "currency"}
FLAGS = ("is_active", "is_verified", "is_generic", "is_draft")
RANGES = {"price": "norm_selling_price", "margin": "margin", "quality": "score", "quantity": "quantity"}
ADMIN_SORTS = {"name": "name", "brand": "brand", "category": "category", "price": "norm_selling_price", "cost": "norm_rdp", "margin": "margin", "quantity": "quantity", "quality": "score", "updated": "updated", "sku": "sku", "supplier": "supplier"}
PUBLIC_SORTS = {"featured": (("score", False), ("updated", False)), "price_asc": (("shown_price", True),), "price_desc": (("shown_price", False),), "name": (("name", True),), "newest": (("updated", False),)}


def sellable() -> Column:
    return F.col("is_active") & ~F.coalesce("is_draft", F.lit(False)) & (F.col("selling_price") > 0)


def published() -> Column:
    return sellable() & F.coalesce("is_verified", F.lit(False))


def awaiting_verification() -> Column:
    return sellable() & ~F.coalesce("is_verified", F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _is_brand(names: list[str]) -> Column:
    """Both sides as keys, so that case, marks and spaces do not tell."""
    return F.array_contains(F.array(*(normalize_key(F.lit(n)) for n in names)), normalize_key(F.col("brand")))


def admin_filter(searched: tuple[str, ...] = ("name", "brand", "sku"), **q) -> Column:
    """Conditions of the admin list: search (in the columns `searched`, description too where a table has it), brand, sku, members, flags, issue_code, issue_severity, has_issues, min_ and max_ of price, margin, quality, quantity."""
    out: list[Column] = []
    as_list = lambda v: v.split(",") if isinstance(v, str) else list(v)
    for key, v in q.items():
        if v is None:
            continue
        if key == "search":
            words = F.split(normalize_key(F.lit(v)), " ")
            out.append(F.arrays_overlap(F.split(normalize_key(F.concat_ws(" ", *searched)), " "), words))
        elif key == "brand":
            out.append(_is_brand(as_list(v)))
        elif key == "sku":
            out.append(sku_key(F.col("sku")) == sku_key(F.lit(v)))
        elif key in MEMBER:
            out.append(F.col(MEMBER[key]).isin(as_list(v)))
        elif key in FLAGS:
            out.append(F.col(key) == bool(v))
        elif key == "issue_code":
            out.append(F.arrays_overlap("issues", F.array(*(F.lit(x) for x in as_list(v)))))
        elif key == "issue_severity":
            out.append(F.arrays_overlap(F.transform("issues", severity_of), F.array(*(F.lit(x) for x in as_list(v)))))
        elif key == "has_issues":
            out.append((F.size("issues") > 0) == bool(v))
        elif key[:4] in ("min_", "max_") and key[4:] in RANGES:
            c = F.col(RANGES[key[4:]])
            out.append(c >= v if key.startswith("min_") else c <= v)
        else:
            raise ValueError(f"no filter {key}")
    return _all(out)


def page(df: DataFrame, number: int = 1, limit: int = 25, most: int = 200) -> DataFrame:
    limit = max(1, min(limit, most))
    return df.offset((max(number, 1) - 1) * limit).limit(limit)


def admin_sort(df: DataFrame, keys: str = "-updated") -> DataFrame:
    """Allowed keys, `-` for descending; others are ignored, and the id ends every order."""
    order = [F.desc(ADMIN_SORTS[k[1:]]) if k.startswith("-") else F.asc(ADMIN_SORTS[k]) for k in keys.split(",") if k.lstrip("-") in ADMIN_SORTS]
    return df.orderBy(*(order or [F.desc("updated")]), "id")


def public(df: DataFrame) -> DataFrame:
    """What a shop may show, of published rows only; costs, margins and suppliers are not among it."""
    shown = F.coalesce("norm_selling_price", "selling_price")
    return df.where(published()).select(
        "id", (F.col("slug") if "slug" in df.columns else slugify(F.concat_ws(" ", "name", F.col("id").cast("string")))).alias("slug"), "name", "brand", "category", "sku", shown.alias("shown_price"),
        F.when(F.col("norm_selling_price").isNotNull(), "EGP").otherwise(F.col("currency")).alias("shown_currency"), (F.col("quantity") - F.coalesce("reserved", F.lit(0)) > 0).alias("in_stock"), "has_image", "score", "updated",
    )


def public_list(df: DataFrame, search: str | None = None, category: list[str] | None = None, subcategory: list[str] | None = None, brand: list[str] | None = None, min_price: float | None = None, max_price: float | None = None, in_stock: bool | None = None, has_image: bool | None = None, sort: str = "featured") -> DataFrame:
    """Published rows. `in_stock` and `has_image` ask for rows that have a quantity or an image; false asks for nothing."""
    if subcategory:
        df = df.where(F.col("subcategory").isin(subcategory))
    if in_stock:
        df = df.where("quantity > 0")
    out, rows = [], public(df)
    if search:
        out.append(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(search.lower())), F.lit(False)) for c in ("name", "brand", "sku"))))
    if category:
        out.append(F.col("category").isin(category))
    if brand:
        out.append(_is_brand(brand))
    if min_price is not None:
        out.append(F.col("shown_price") >= min_price)
    if max_price is not None:
        out.append(F.col("shown_price") <= max_price)
    if has_image:
        out.append(F.col("has_image"))
    return rows.where(_all(out)).orderBy(*(F.asc(c) if up else F.desc(c) for c, up in PUBLIC_SORTS[sort]), "id")


def by_handle(df: DataFrame, handle: str) -> DataFrame:
    """The published row with this slug or id; none if it is not published."""
    return public(df).where((F.col("slug") == handle.lower()) | (F.col("id").cast("string") == handle))


def find(df: DataFrame, wanted: DataFrame, asked: str, by: str = "fingerprint") -> DataFrame:
    """The rows of `df` that each value of `asked` names: by fingerprint, or by SKU whatever its case and marks.

    A join on the key, so that any number of lookups is one pass; several rows may share an SKU, and all of
    them come. Values asked for twice count once; null and empty ones name nothing.
    """
    key = sku_key if by == "sku" else (lambda c: F.nullif(c, F.lit("")))
    keys = wanted.select(asked).distinct().withColumn("_key", key(F.col(asked))).where("_key is not null")
    return keys.join(df.withColumn("_key", key(F.col(by))), "_key").drop("_key")


def facet(df: DataFrame, column: str) -> DataFrame:
    return df.where(published() & (F.coalesce(column, F.lit("")) != "")).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def facet_price_range(df: DataFrame) -> DataFrame:
    p = F.col("norm_selling_price")
    return df.where(published() & (p > 0)).agg(F.floor(F.min(p)).alias("low"), F.ceil(F.max(p)).alias("high"), F.count("*").alias("n"))


def sitemap(df: DataFrame) -> DataFrame:
    return public(df).where("slug <> ''").select("slug", "updated").orderBy(F.desc("updated"), "slug")


def related(df: DataFrame, limit: int = 4) -> DataFrame:
    """For each published row the first others of its category, best quality first.

    Only the limit + 1 best rows of a category can be named, so they are found by a grouped top-k of a
    fixed size and joined back; no row is paired with its whole category.
    """
    shown = public(df).select("id", "category", "score").where("category is not null")
    salted = shown.select("category", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"), F.struct((-F.col("score")).alias("s"), "id").alias("r"))
    rank = F.row_number().over(Window.partitionBy("category", "salt").orderBy("r"))
    best = salted.withColumn("k", rank).where(F.col("k") <= limit + 1).groupBy("category").agg(F.slice(F.sort_array(F.collect_list("r")), 1, limit + 1).alias("rs"))
    out = shown.join(best, "category").select("id", F.slice(F.filter("rs", lambda r: r["id"] != F.col("id")), 1, limit).alias("others"))
    return out.select("id", F.posexplode(F.transform("others", lambda r: r["id"])).alias("rank", "related_id"))
