"""Numbers, money, shares and times as people read them; null is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "\u2014"


def _shown(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), F.lit(DASH)).otherwise(text)


def number(c: Column, decimals: int = 0) -> Column:
    return _shown(c, F.format_number(c, decimals))


def _plain(c: Column, decimals: int) -> Column:
    """Digits alone, rounded by the exact binary value, exact halves to even; a format string would round the shown decimals up."""
    return F.replace(F.format_number(c, decimals), F.lit(","), F.lit(""))


def _with_symbol(text: Column, currency: Column) -> Column:
    return F.when(currency == "USD", F.concat(F.lit("$"), text)).otherwise(F.concat(text, F.lit(" "), F.coalesce(currency, F.lit(""))))


def money(c: Column, currency: Column) -> Column:
    """Whole numbers, two decimals under 10; dollars before the number, other currencies after it."""
    small = (F.abs(c) > 0) & (F.abs(c) < 10)
    return _shown(c, _with_symbol(F.when(small, F.format_number(c, 2)).otherwise(F.format_number(c, 0)), currency))


def money_compact(c: Column, currency: Column) -> Column:
    """Thousands, millions and billions by a letter, with a decimal under 100 unless it is 0."""
    size = F.abs(c)
    unit = F.when(size >= 1e9, 1e9).when(size >= 1e6, 1e6).otherwise(1e3)
    letter = F.when(size >= 1e9, "B").when(size >= 1e6, "M").otherwise("K")
    scaled = c / unit
    text = F.when(scaled >= 100, _plain(scaled, 0)).otherwise(F.regexp_replace(_plain(scaled, 1), r"\.0$", ""))
    return F.when(size >= 1000, _with_symbol(F.concat(text, letter), currency)).otherwise(money(c, currency))


def percent(c: Column, sign: bool = False) -> Column:
    text = F.concat(F.regexp_replace(_plain(c, 1), r"\.0$", ""), F.lit("%"))
    return _shown(c, F.concat(F.when(c > 0, "+").otherwise(""), text) if sign else text)


def day(c: Column) -> Column:
    return _shown(c, F.date_format(c, "d MMM yyyy"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
