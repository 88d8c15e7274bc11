"""Inventory, profitability, supplier and procurement roll-ups over priced and scored products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.config import POLICY, Policy
from shelfspark.functions.money import js_round, non_zero, total

DIMENSIONS = {"category": "category", "subcategory": "subcategory", "brand": "brand", "supplier": "supplier", "procurement": "procurement", "source": "source_catalog", "currency": "currency"}


def _value(price: str) -> Column:
    return F.coalesce(price, F.lit(0.0)) * F.coalesce("quantity", F.lit(0))


def _mean(c: str) -> Column:
    """An average whose sum is exact, so that it does not depend on the order of rows."""
    return non_zero(js_round(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.nullif(F.count(c), F.lit(0))))


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def _measures() -> list[Column]:
    cost, retail = total(_value("norm_rdp")), total(_value("norm_selling_price"))
    return [F.count("*").alias("products"), F.sum("quantity").alias("units"), js_round(cost).alias("cost"), js_round(retail).alias("retail"), _mean("margin").alias("avg_margin"), js_round(retail - cost).alias("profit")]


def summary(scored: DataFrame) -> DataFrame:
    return scored.where("is_active").agg(*_measures(), _mean("gross_margin").alias("avg_gross_margin"), _mean("score").alias("avg_score"), _count(F.col("is_verified")).alias("verified"), _count(F.col("is_generic")).alias("generic"), _count(F.col("selling_price") > 0).alias("priced"))


def inventory_value(priced: DataFrame, by: str = "category") -> DataFrame:
    """Value by one of seven dimensions; rows without it are `(unassigned)`. Largest cost first."""
    if by not in DIMENSIONS:
        raise ValueError(f"group by one of {', '.join(DIMENSIONS)}")
    return priced.where("is_active").groupBy(F.coalesce(DIMENSIONS[by], F.lit("(unassigned)")).alias("group")).agg(*_measures()).orderBy(F.desc("cost"), "group")


def top_profitable(priced: DataFrame, limit: int = 20, by: str = "total", min_margin: float | None = None) -> DataFrame:
    if by not in ("total", "unit") or not 1 <= limit <= 100:
        raise ValueError("by is total or unit, and the limit from 1 to 100")
    rows = priced.where("is_active and norm_rdp > 0 and norm_selling_price > 0")
    rows = rows if min_margin is None else rows.where(F.col("margin") >= min_margin)
    unit = F.col("norm_selling_price") - F.col("norm_rdp")
    out = rows.select("id", "name", "brand", "margin", "quantity", F.bround(unit, 2).alias("unit_profit"), F.bround(unit * F.coalesce("quantity", F.lit(0)), 2).alias("total_profit"))
    return out.orderBy(F.desc(f"{by}_profit"), "id").limit(limit)


def margin_bands(priced: DataFrame) -> DataFrame:
    rows = priced.where("is_active and margin is not null")
    return rows.groupBy("band").agg(F.count("*").alias("products"), _mean("margin").alias("avg_margin"), js_round(total(_value("norm_rdp"))).alias("cost")).orderBy("avg_margin", "band")


def low_margin(priced: DataFrame, threshold: float | None = None, limit: int | None = 25, policy: Policy = POLICY) -> DataFrame:
    rows = priced.where(F.col("is_active") & (F.col("margin") < (policy.margin_warn if threshold is None else threshold)))
    out = rows.select("id", "name", "margin", "band", F.bround(_value("norm_rdp"), 2).alias("exposure")).orderBy(F.desc("exposure"), "margin", "id")
    return out.limit(limit) if limit else out


def supplier_breakdown(scored: DataFrame) -> DataFrame:
    return (
        scored.where("is_active").groupBy(F.coalesce("supplier", F.lit("(unknown)")).alias("supplier"))
        .agg(
            F.count("*").alias("products"), F.sum("quantity").alias("units"), js_round(total(_value("norm_rdp"))).alias("spend"), _mean("margin").alias("avg_margin"), _mean("score").alias("avg_score"),
            _count(F.col("procurement") == "must_buy").alias("must_buy"), _count(F.col("procurement") == "avoid").alias("avoid"),
        ).orderBy(F.desc("spend"), "supplier")
    )


def procurement_baskets(priced: DataFrame) -> DataFrame:
    """All rows, inactive ones too."""
    return priced.groupBy("procurement").agg(*_measures()).orderBy("procurement")


def committed_total(priced: DataFrame) -> DataFrame:
    """What is bought for sure or on trial, from the baskets as they are rounded."""
    rows = procurement_baskets(priced).where(F.col("procurement").isin("must_buy", "test_buy"))
    return rows.agg(F.sum("products").alias("products"), F.sum("units").alias("units"), js_round(total(F.col("cost"))).alias("committed"))


def dashboard_groups(scored: DataFrame) -> DataFrame:
    """The grouped views of the start page from one pass over the rows: all active products, and these by category, margin band and supplier, and every product by procurement.

    A row goes to each view that it is part of, and partial sums are made before anything is shuffled. Each
    view shows the measures of inventory_value and those of summary and supplier_breakdown.
    """
    part = lambda view, group, when: F.when(when, F.struct(F.lit(view).alias("view"), group.alias("group")))
    active, named = F.col("is_active"), lambda c, none: F.coalesce(c, F.lit(none))
    views = F.array_compact(F.array(
        part("summary", F.lit("all"), active), part("category", named("category", "(unassigned)"), active), part("band", F.col("band"), active & F.col("margin").isNotNull()),
        part("supplier", named("supplier", "(unknown)"), active), part("procurement", F.col("procurement"), F.lit(True)),
    ))
    own = ("quantity", "norm_rdp", "norm_selling_price", "margin", "gross_margin", "score", "is_verified", "is_generic", "selling_price", "procurement")
    rows = scored.select(F.explode(views).alias("_v"), *own).select("_v.view", "_v.group", *own)
    return rows.groupBy("view", "group").agg(
        *_measures(), _mean("gross_margin").alias("avg_gross_margin"), _mean("score").alias("avg_score"), _count(F.col("is_verified")).alias("verified"), _count(F.col("is_generic")).alias("generic"), _count(F.col("selling_price") > 0).alias("priced"),
        _count(F.col("procurement") == "must_buy").alias("must_buy"), _count(F.col("procurement") == "avoid").alias("avoid"),
    )


def dashboard(scored: DataFrame) -> dict[str, DataFrame]:
    """The start page: all grouped views in one pass, and two lists of the first few."""
    return {"groups": dashboard_groups(scored), "top_profitable": top_profitable(scored, 10), "low_margin": low_margin(scored, limit=10)}


def dashboard_derived(scored: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Active products that are not publishable yet, and how many of the alerts are loss makers."""
    ready = (F.col("score") >= policy.min_quality) & ~F.col("is_blocked")
    return scored.where("is_active").agg(F.count("*").alias("products"), _count(~ready).alias("needs_work"), _count(F.col("band") == "loss").alias("loss_makers"))


def chart_top(groups: DataFrame, most: int = 12) -> DataFrame:
    """The first groups that have any value, the dearest first."""
    return groups.where("cost > 0 OR retail > 0").orderBy(F.desc("cost"), "group").limit(most)
