"""Text cleaning, keys and similarity."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2043\ufe58\ufe63\uff0d\u0640"
INVISIBLE = r"[\u200B-\u200F\u202A-\u202E\uFEFF]"
#: Word bounds as ASCII has them, whatever script stands beside.
B0, B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word bounds as ASCII has them: one before a letter, digit or group opens a word, others close it."""
    return re.sub(r"\\b(?=[\w(\[]|\\d)", lambda _: B0, pattern).replace(r"\b", B1)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` names it: large expressions stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def given(text: Column) -> Column:
    """The text, null if it is empty; computed once, where `nullif` names it twice."""
    return let(text, lambda t: F.when(t != "", t))


def constant(value: object, schema: str) -> Column:
    """A vocabulary as one foldable constant: the plan holds a literal, not an expression for each entry."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)


def normalize_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, "01234567890123456789")


def normalize_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def squish(c: Column) -> Column:
    """Null becomes empty; invisible marks go, white space of any kind folds to one space."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    return squish(normalize_dashes(normalize_digits(c)))


def contains_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike("[؀-ۿ]"), F.lit(False))


def normalize_key(c: Column) -> Column:
    """Lower-case letters, numbers and single spaces of any script."""
    t = F.regexp_replace(F.lower(clean_text(c)), r"(?U)[^\p{L}\p{N}\s]+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def slugify(c: Column) -> Column:
    t = F.regexp_replace(F.lower(clean_text(c)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(t, "^-+|-+$", ""), 1, 120)


def title_case(c: Column) -> Column:
    """The cleaned text with the first letter of each word raised if it is an ASCII one; words are runs of ASCII letters, digits and underscores."""
    runs = F.regexp_extract_all(clean_text(c), F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000_000))).otherwise(w)), "")


def similarity(a: Column, b: Column) -> Column:
    """0 to 1 on keys: the best of a blend of shared words and edits, and edits alone for longer keys."""
    x, y = normalize_key(a), normalize_key(b)
    return key_similarity(x, y)


def key_similarity(x: Column, y: Column) -> Column:
    """The same for columns that are keys already."""
    return let(F.struct(x.alias("x"), y.alias("y")), lambda k: _alike(k["x"], k["y"]))


def _alike(x: Column, y: Column) -> Column:
    wx, wy = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    jaccard = F.size(F.array_intersect(wx, wy)) / F.size(F.array_union(wx, wy))
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    long = (F.length(x) >= 6) & (F.length(y) >= 6)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.greatest(0.4 * jaccard + 0.6 * edit, F.when(long, 0.95 * edit).otherwise(0.0)))


def sku_key(c: Column) -> Column:
    return F.nullif(F.replace(normalize_key(c), F.lit(" "), F.lit("")), F.lit(""))


def fingerprint(sku: Column, brand: Column, name: Column) -> Column:
    """What makes two rows one product: the SKU, else brand and name."""
    brand_key = F.coalesce(F.nullif(normalize_key(brand), F.lit("")), F.lit("nobrand"))
    return F.when(sku_key(sku).isNotNull(), F.concat(F.lit("sku:"), sku_key(sku))).otherwise(F.concat(F.lit("nm:"), brand_key, F.lit("|"), normalize_key(name)))


def humanize(c: Column) -> Column:
    t = F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.regexp_replace(t, "^.", ""))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def encode_path(c: Column) -> Column:
    """Percent-encoded segments; slashes stay."""
    return F.array_join(F.transform(F.split(c, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def to_posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))
