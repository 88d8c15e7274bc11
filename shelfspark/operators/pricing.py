"""Margins, currencies, price alerts and suggestions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfspark.config import POLICY, Policy
from shelfspark.functions.money import classify_margin, convert, js_round, margin_on_cost, margin_on_revenue, price_for_margin, rate_for, total


def with_pricing(df: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds margins, band and prices in the base currency; a missing selling price falls back to the RRP."""
    base = policy.base_currency
    df = df.withColumns({"currency": F.upper("currency"), "selling_price": F.coalesce("selling_price", "rrp")})
    df = df.withColumns({
        "margin": margin_on_cost(F.col("rdp"), F.col("selling_price")), "gross_margin": margin_on_revenue(F.col("rdp"), F.col("selling_price")),
        "margin_value": js_round(F.col("selling_price") - F.col("rdp")), "fx_rate": rate_for(F.col("currency"), policy),
        **{f"norm_{c}": convert(F.col(c), F.col("currency"), base, policy) for c in ("rdp", "rrp", "selling_price")},
    })
    return df.withColumn("band", classify_margin(F.col("margin"), policy))


def alert_rules(policy: Policy = POLICY) -> list[tuple[str, Column]]:
    """Code and condition of each pricing alert, in order."""
    cost, price, rrp, high, m = (F.col(c) for c in ("rdp", "selling_price", "rrp", "market_high", "margin"))
    known = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("NEGATIVE_PRICE", known(cost < 0) | known(price < 0)),
        ("MISSING_COST", F.coalesce(cost, F.lit(0.0)) == 0),
        ("MISSING_SELLING_PRICE", F.coalesce(price, F.lit(0.0)) == 0),
        ("MISSING_CURRENCY", F.col("currency").isNull() & (cost.isNotNull() | price.isNotNull() | rrp.isNotNull())),
        ("RRP_BELOW_COST", (rrp > 0) & (rrp < cost)),
        ("SELLING_BELOW_COST", (price > 0) & (price < cost)),
        ("MARKET_BELOW_COST", high < cost),
        ("IMPLAUSIBLE_MARGIN", m > policy.margin_implausible),
        ("CRITICAL_MARGIN", (m >= 0) & (m < policy.margin_critical)),
        ("LOW_MARGIN", (m >= policy.margin_critical) & (m < policy.margin_warn)),
        ("ESTIMATED_PRICE", F.col("is_estimated")),
    ]
    return [(code, known(c)) for code, c in rules]


def fx_normalized(priced: DataFrame) -> DataFrame:
    return priced.select("id", "currency", "fx_rate", "norm_rdp", "norm_rrp", "norm_selling_price", "margin", "gross_margin", "margin_value", "band")


def alerts(priced: DataFrame, bands: tuple[str, ...] = ("loss", "critical", "low", "implausible"), limit: int | None = 50, include_inactive: bool = False, policy: Policy = POLICY) -> DataFrame:
    """Products in the bands: exposure and the price that would reach the warning margin; worst margin first."""
    rows = priced.where(F.col("margin").isNotNull() & F.col("band").isin(*bands))
    if not include_inactive:
        rows = rows.where("is_active")
    exposure = js_round(F.coalesce("norm_rdp", F.lit(0.0)) * F.coalesce("quantity", F.lit(0)))
    out = rows.select("id", "name", "brand", "sku", "rdp", "selling_price", "margin", "band", exposure.alias("exposure"), price_for_margin(F.col("rdp"), policy.margin_warn).alias("suggested_price"))
    return out.orderBy("margin", "id").limit(limit) if limit else out


def loss_makers(priced: DataFrame, limit: int | None = 50) -> DataFrame:
    """Active products that sell below cost. One with a cost and no price counts, marked `is_unpriced`."""
    rows = priced.where(F.col("is_active") & (F.col("rdp") > 0) & (F.col("selling_price").isNull() | (F.col("selling_price") < F.col("rdp"))))
    loss = js_round(F.col("rdp") - F.coalesce("selling_price", F.lit(0.0)))
    out = rows.select("id", "name", "rdp", "selling_price", "quantity", loss.alias("loss_per_unit"), js_round(loss * F.col("quantity")).alias("exposure"), F.col("selling_price").isNull().alias("is_unpriced"))
    return out.orderBy(F.desc("exposure"), "id").limit(limit) if limit else out


def suggestions(priced: DataFrame, target: float | None = None, policy: Policy = POLICY) -> DataFrame:
    """The price for a target margin, how far it is from today's, and whether the market's high is below it."""
    goal = policy.margin_target if target is None else target
    price = price_for_margin(F.col("rdp"), goal)
    return priced.where("rdp > 0").select(
        "id", "rdp", "selling_price", "margin", F.lit(float(goal)).alias("target_margin"), price.alias("suggested_price"), js_round(price - F.col("selling_price")).alias("delta"),
        F.when(F.col("market_high").isNotNull(), price > F.col("market_high")).alias("exceeds_market_high"), classify_margin(F.lit(float(goal)), policy).alias("target_band"),
    )


def quotes(rows: DataFrame, target: float | None = None, policy: Policy = POLICY) -> DataFrame:
    """What-if for every row (rdp, rrp, selling_price, currency): margins, break-even, and prices at the target and the warning margin.

    Without a selling price the RRP counts as one; a row with neither has no margins, one without a cost above 0 no prices.
    """
    goal = policy.margin_target if target is None else target
    at = lambda margin: price_for_margin(F.col("rdp"), margin)
    return with_pricing(rows, policy).withColumns({"break_even": js_round(F.when(F.col("rdp") > 0, F.col("rdp"))), "price_at_target": at(goal), "price_at_warn": at(policy.margin_warn)})


def quote(spark: SparkSession, rdp: float, selling_price: float | None = None, rrp: float | None = None, currency: str = "EGP", target: float | None = None, policy: Policy = POLICY) -> DataFrame:
    """The what-if of one product."""
    if rdp < 0 or (selling_price is None and rrp is None):
        raise ValueError("a quote needs a cost of at least 0 and a selling price or an RRP")
    row = spark.createDataFrame([(float(rdp), None if selling_price is None else float(selling_price), None if rrp is None else float(rrp), currency)], "rdp double, selling_price double, rrp double, currency string")
    return quotes(row, target, policy)


def policy_table(spark: SparkSession, policy: Policy = POLICY) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in vars(policy).items()], "setting string, value string")


def recalculate_counts(stored: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """How many rows a recalculation would change, by comparing stored margins and bands with new ones."""
    now = with_pricing(stored.withColumnsRenamed({"margin": "was_margin", "band": "was_band"}), policy)
    changed = ~F.col("margin").eqNullSafe(F.col("was_margin")) | ~F.col("band").eqNullSafe(F.col("was_band"))
    return now.agg(F.count("*").alias("scanned"), F.sum(changed.cast("long")).alias("changed"), total(F.col("margin")).alias("margin_total"))


def recalculated(stored: DataFrame, policy: Policy = POLICY, rescore: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All rows priced anew, and scored by `rescore` where given, with `changed`: another margin, band or score than was stored."""
    was = [c for c in ("margin", "band", "score") if c in stored.columns]
    now = with_pricing(stored.withColumnsRenamed({c: f"was_{c}" for c in was}), policy)
    now = rescore(now) if rescore else now
    changed = F.lit(False)
    for c in was:
        if c in now.columns:
            changed = changed | ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    return now.withColumn("changed", changed).drop(*(f"was_{c}" for c in was))


def recalculate(stored: DataFrame, write: Callable[[DataFrame], None] | None, policy: Policy = POLICY, rescore: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, object]:
    """Writes all rows priced anew, in the stored columns, and tells how many were examined, changed and written.

    One pass: the counts are observed while the rows are written. Without `write` it is a dry run, which
    computes the rows and writes none. `write` must write what it gets, once.
    """
    seen = Observation()
    rows = recalculated(stored, policy, rescore).observe(seen, F.count("*").alias("examined"), F.count_if("changed").alias("changed"))
    own = rows.select(*stored.columns)
    if write is None:
        own.write.format("noop").mode("overwrite").save()
    else:
        write(own)
    n = seen.get
    return {"examined": n["examined"], "changed": n["changed"], "written": 0 if write is None else n["examined"], "dry_run": write is None}
