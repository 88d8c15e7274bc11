"""Amounts: rounding, currencies, and prices, percentages and counts read from cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.config import NULL_TOKENS, POLICY, Policy
from shelfspark.functions.text import B0, B1, clean_text, let, normalize_dashes, normalize_digits

EPSILON = 2.220446049250313e-16
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_RANGE = rf"(?i)({_NUMBER})\s*(?:-|to|إلى)\s*[$£€]?\s*(?:ج\.?\s*م\s*)?({_NUMBER})"
_ESTIMATE = rf"(?i){B0}(est|estimate[d]?|approx|around|about|circa|guess){B1}|~"


def js_round(c: Column, places: int = 2) -> Column:
    """Halves go up, towards plus infinity; NaN and infinities become null."""
    x = c.cast("double")
    scale = float(10**places)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor((x + EPSILON) * scale + 0.5) / scale)


def total(c: Column, scale: int = 4) -> Column:
    """A sum in decimals, the same in any order; of nothing 0."""
    return F.coalesce(F.sum(F.coalesce(c, F.lit(0.0)).cast(f"decimal(20,{scale})")), F.lit(0)).cast("double")


def rate_for(currency: Column, policy: Policy = POLICY) -> Column:
    """Units of the base currency for one unit."""
    usd = policy.usd_rate if policy.base_currency == "EGP" else 1.0
    egp = 1.0 if policy.base_currency == "EGP" else 1 / policy.usd_rate
    return F.when(currency == "USD", F.lit(usd)).when(currency == "EGP", F.lit(egp))


def convert(amount: Column, source: Column, target: str, policy: Policy = POLICY) -> Column:
    """Null for a null amount or an unknown currency."""
    via = amount * rate_for(source, policy) / rate_for(F.lit(target), policy)
    return js_round(F.when(source == target, amount).otherwise(via))


def detect_currency(text: Column, fallback: Column | None = None) -> Column:
    found = F.when(text.rlike(rf"(?i)\$|{B0}usd{B1}|dollar"), "USD").when(text.rlike(rf"(?i)ج\.?\s*م|{B0}egp{B1}|جنيه|{B0}le{B1}"), "EGP")
    return found if fallback is None else F.coalesce(found, fallback)


def to_number(token: Column) -> Column:
    digits = F.regexp_replace(token, r"[^\d.]", "")
    return F.regexp_extract(digits, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def bounds(fragment: Column) -> Column:
    """min, max, value and is_range of a price fragment; null if it has no number."""
    return let(F.trim(normalize_dashes(normalize_digits(fragment))), lambda t: let(_ends(t), _bounds))


def _ends(t: Column) -> Column:
    low, high = to_number(F.regexp_extract(t, _RANGE, 1)), to_number(F.regexp_extract(t, _RANGE, 2))
    value = let(F.regexp_extract(t, rf"-?{_NUMBER}", 0), lambda one: F.when(F.startswith(one, F.lit("-")), -to_number(one)).otherwise(to_number(one)))
    return F.struct(low.alias("low"), high.alias("high"), value.alias("value"))


def _bounds(e: Column) -> Column:
    low, high, value = e["low"], e["high"], e["value"]
    ranged = low.isNotNull() & high.isNotNull()
    as_range = F.struct(F.least(low, high).alias("min"), F.greatest(low, high).alias("max"), js_round((low + high) / 2).alias("value"), F.lit(True).alias("is_range"))
    single = F.struct(value.alias("min"), value.alias("max"), value.alias("value"), F.lit(False).alias("is_range"))
    return F.when(ranged, as_range).when(value.isNotNull(), single)


def parse_money(raw: Column, default_currency: Column | None = None, assume_estimate: bool | Column = False) -> Column:
    """value, min, max, is_range, is_estimated, currency, variants, note and ok of a text cell."""
    default = F.lit(None).cast("string") if default_currency is None else default_currency
    cell = F.struct(raw.alias("raw"), clean_text(raw).alias("text"), default.alias("default"))
    # most cells of a row are empty: those need no reading
    return F.when(raw.isNotNull(), let(cell, lambda c: let(_split_note(c, assume_estimate), lambda n: let(_read(n), _money)))).otherwise(_no_money())


def _no_money() -> Column:
    """The fields of a cell without anything."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        none("double").alias("value"), none("double").alias("min"), none("double").alias("max"), F.lit(False).alias("is_range"), F.lit(False).alias("is_estimated"), none("string").alias("currency"),
        none("array<struct<label:string,min:double,max:double,value:double,currency:string>>").alias("variants"), none("string").alias("note"), F.lit(False).alias("ok"),
    )


def _split_note(c: Column, assume_estimate: bool | Column) -> Column:
    text = c["text"]
    rest = F.when(text.rlike(r"\([^)]*\)"), F.regexp_replace(text, r"\([^)]*\)", " ")).otherwise(text)
    return F.struct(
        c["raw"].alias("raw"), text.alias("text"), F.nullif(clean_text(F.regexp_extract(text, r"\(([^)]*)\)", 1)), F.lit("")).alias("inner"), rest.alias("rest"),
        detect_currency(text, c["default"]).alias("currency"), (F.lit(assume_estimate) | text.rlike(_ESTIMATE)).alias("estimated"),
    )


def _read(n: Column) -> Column:
    rest = n["rest"]
    part = lambda s, i: F.coalesce(F.get(F.split(s, ":"), F.lit(i)), F.lit(""))
    segments = F.filter(F.split(rest, r"\|"), lambda s: (part(s, 0) != "") & (part(s, 1) != ""))
    found = F.transform(segments, lambda s: F.struct(clean_text(part(s, 0)).alias("label"), bounds(part(s, 1)).alias("b"), detect_currency(part(s, 1), n["currency"]).alias("currency")))
    variants = F.transform(F.filter(found, lambda v: v["b"].isNotNull()), lambda v: F.struct(v["label"].alias("label"), v["b"]["min"].alias("min"), v["b"]["max"].alias("max"), v["b"]["value"].alias("value"), v["currency"].alias("currency")))
    listed = F.contains(rest, F.lit("|")) & F.contains(rest, F.lit(":"))
    return F.struct(
        *(n[c].alias(c) for c in ("raw", "text", "inner", "currency", "estimated")), bounds(rest).alias("b"), F.when(listed, variants).alias("variants"),
        F.lower(clean_text(F.regexp_extract(rest, r"^([^0-9]*?)-\s*(.+)$", 1))).alias("head"), clean_text(F.regexp_extract(rest, r"^([^0-9]*?)-\s*(.+)$", 2)).alias("tail"),
    )


def _money(m: Column) -> Column:
    is_null, commentary = F.lower(m["text"]).isin(*NULL_TOKENS), (m["head"] != "") & m["head"].isin(*NULL_TOKENS)
    many = F.coalesce(F.size(m["variants"]) > 0, F.lit(False))
    kind = F.when(m["raw"].isNull() | is_null | commentary, "none").when(many, "variants").when(m["b"].isNotNull(), "single").otherwise("none")
    low, high = F.array_min(F.transform(m["variants"], lambda v: v["min"])), F.array_max(F.transform(m["variants"], lambda v: v["max"]))
    note = (
        F.when(m["raw"].isNull(), None).when(is_null, F.nullif(m["text"], F.lit(""))).when(commentary, F.when(m["inner"].isNotNull(), F.concat(m["tail"], F.lit(" ("), m["inner"], F.lit(")"))).otherwise(m["tail"]))
        .when(many, F.coalesce(m["inner"], F.concat(F.size(m["variants"]).cast("string"), F.lit(" price variants")))).when(m["b"].isNotNull(), m["inner"]).otherwise(F.coalesce(m["inner"], m["text"]))
    )

    def out(k: Column) -> Column:
        pick = lambda v, s: F.when(k == "variants", v).when(k == "single", s)
        yes = F.lit(True)
        return F.struct(
            pick(low, m["b"]["value"]).alias("value"), pick(low, m["b"]["min"]).alias("min"), pick(high, m["b"]["max"]).alias("max"), F.coalesce(pick(yes, m["b"]["is_range"]), F.lit(False)).alias("is_range"),
            F.coalesce(pick(yes, m["estimated"] | m["b"]["is_range"]), F.lit(False)).alias("is_estimated"), pick(m["currency"], m["currency"]).alias("currency"), pick(m["variants"], F.filter(m["variants"], lambda v: F.lit(False))).alias("variants"),
            note.alias("note"), (k != "none").alias("ok"),
        )

    return let(kind, out)


def money_of_number(n: Column, default_currency: Column, assume_estimate: bool = False) -> Column:
    """The same fields for a numeric cell."""
    v = js_round(n)
    return F.struct(v.alias("value"), v.alias("min"), v.alias("max"), F.lit(False).alias("is_range"), F.lit(assume_estimate).alias("is_estimated"), default_currency.alias("currency"), v.isNotNull().alias("ok"))


def parse_percent(raw: Column) -> Column:
    """A text cell as per cent: literal with a sign, a fraction of at most 1 times 100 without."""
    t = clean_text(raw)
    n = F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return js_round(F.when(F.lower(t).isin(*NULL_TOKENS), None).when(~F.contains(t, F.lit("%")) & (F.abs(n) <= 1), n * 100).otherwise(n))


def parse_integer(raw: Column) -> Column:
    """The first signed run of digits, thousands separators aside."""
    return F.regexp_extract(F.replace(clean_text(raw), F.lit(","), F.lit("")), r"-?\d+", 0).try_cast("long")


def margin_on_cost(cost: Column, price: Column) -> Column:
    return js_round(F.when(cost > 0, (price - cost) / F.nullif(cost, F.lit(0.0)) * 100))


def margin_on_revenue(cost: Column, price: Column) -> Column:
    return js_round(F.when(price > 0, (price - cost) / F.nullif(price, F.lit(0.0)) * 100))


def classify_margin(m: Column, policy: Policy = POLICY) -> Column:
    return (
        F.when(m.isNull(), "unknown").when(m > policy.margin_implausible, "implausible").when(m < 0, "loss").when(m < policy.margin_critical, "critical")
        .when(m < policy.margin_warn, "low").when(m < policy.margin_target, "healthy").otherwise("target")
    )


def price_for_margin(cost: Column, target: Column | float) -> Column:
    t = F.lit(target) if isinstance(target, int | float) else target
    return js_round(F.when(cost > 0, cost * (1 + t / 100)))


def non_zero(average: Column) -> Column:
    """An average of exactly 0 is reported as none."""
    return F.when(average != 0, average)
