"""What a product is: SKU, brand, category, placeholder and draft marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.config import BRAND_ALIASES, BRAND_PARENTS, CATEGORY_CODES, DRAFT_WORDS, GENERIC_BRANDS, GENERIC_WORDS, RESERVED_CODES, TAXONOMY
from shelfspark.functions.text import B0, B1, clean_text, constant, contains_arabic, let, normalize_key, title_case

#: The pattern of a model code, keys that stand for no SKU, and marks of prose.
MODEL_CODE = r"(?<![A-Za-z0-9_])(?=[A-Z0-9-]*\d)[A-Z][A-Z0-9-]{2,}(?![A-Za-z0-9_])"
PLACEHOLDERS = ("unassigned", "n a", "na", "none", "null", "tbd", "tba", "unknown", "no sku", "various", "generic", "not assigned", "pending")
PROSE = rf"(?i){B0}(rdp|rrp|est|price|source|matched|verified|no{B1}|none|yet|usd|egp){B1}|·|\$"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """A literal map; null if the key is not in it."""
    return F.element_at(constant(table, "map<string,string>"), key)


def codes_in(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(clean_text(text), F.lit(f"({MODEL_CODE})"), F.lit(1)))
    return F.filter(found, lambda c: ~F.upper(c).isin(*RESERVED_CODES))


def is_placeholder(text: Column) -> Column:
    key = normalize_key(text)
    return (key == "") | key.isin(*PLACEHOLDERS)


def normalize_sku(raw: Column) -> Column:
    """sku, corrected_from, is_ambiguous and alternates of a model cell.

    In turn: of a correction by an arrow the right side counts; the example of a family (one that varies, a
    series, one per phone) stands for it; one code alone in brackets is the SKU; of prose the first code is;
    else the cell without its brackets, or the first of several parted by slashes or commas.
    """
    return let(clean_text(raw), lambda text: F.when(is_placeholder(text), _sku(F.lit(None), F.lit(None), F.lit(False), None)).otherwise(let(_corrected(text), _read)))


def _sku(sku: Column, was: Column, unsure: Column, others: Column | None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(sku.cast("string").alias("sku"), was.cast("string").alias("corrected_from"), F.coalesce(unsure, F.lit(False)).alias("is_ambiguous"), (none if others is None else F.coalesce(others, none)).alias("alternates"))


def _corrected(text: Column) -> Column:
    """The text that counts, what it corrects, and the example that stands for a family."""
    arrow = r"^(.+?)\s*(?:→|=>|->)\s*(.+)$"
    is_fixed = text.rlike(arrow)
    now = F.when(is_fixed, clean_text(F.regexp_extract(text, arrow, 2))).otherwise(text)
    was = F.when(is_fixed, clean_text(F.regexp_extract(text, arrow, 1)))

    def with_example(working: Column) -> Column:
        sample = r"(?i)e\.?g\.?\s*([A-Za-z0-9][A-Za-z0-9._-]{2,})"
        family = working.rlike(sample) & working.rlike("(?i)varies|series|per phone")
        own = F.when(family, F.regexp_extract(working, sample, 1)).otherwise(working)
        return F.struct(own.alias("text"), was.alias("was"), family.alias("family"), F.when(family, F.array(working)).otherwise(F.array().cast("array<string>")).alias("others"), codes_in(own).alias("codes"))

    return let(now, with_example)


def _read(c: Column) -> Column:
    text, codes = c["text"], c["codes"]
    unsure = c["family"] | text.rlike(rf"(?i){B0}(varies|series){B1}")
    groups = F.transform(F.regexp_extract_all(text, F.lit(r"(\([^)]*\))"), F.lit(1)), codes_in)
    bracketed = F.get(F.get(F.filter(groups, lambda g: F.size(g) == 1), F.lit(0)), F.lit(0))
    prose = (F.size(F.split(text, r"\s+")) > 3) | text.rlike(PROSE)
    several = bracketed.isNull() & prose & (F.size(codes) > 1)
    others = F.when(several, F.concat(c["others"], F.slice(codes, 2, 1_000_000))).otherwise(c["others"])
    working = F.coalesce(bracketed, F.when(prose, F.get(codes, F.lit(0))), clean_text(F.regexp_replace(text, r"\([^)]*\)", " ")))

    def parted(w: Column) -> Column:
        parts = F.filter(F.transform(F.split(w["text"], r"\s*[/,]\s*"), clean_text), lambda p: p != "")
        many = F.size(parts) > 1
        sku = F.when(many, F.get(parts, F.lit(0))).otherwise(clean_text(w["text"]))
        known = ~is_placeholder(sku)
        return _sku(F.when(known, sku), c["was"], known & (w["unsure"] | many), F.when(many, F.concat(w["others"], F.slice(parts, 2, 1_000_000))).otherwise(w["others"]))

    return F.when(bracketed.isNull() & prose & (F.size(codes) == 0), _sku(F.lit(None), c["was"], unsure, c["others"])).otherwise(
        let(F.struct(working.alias("text"), (unsure | several).alias("unsure"), others.alias("others")), parted)
    )


def _code(value: Column) -> Column:
    letters = F.regexp_replace(normalize_key(value), "[^a-z0-9]", "")
    return F.when(letters == "", "GEN").otherwise(F.rpad(F.upper(F.substring(letters, 1, 3)), 3, "X"))


def generate_sku(name: Column, brand: Column, category: Column, capacity: Column) -> Column:
    """A placeholder from identity alone: the same product gets the same one on every import."""
    digest = F.upper(F.substring(F.sha1(F.concat_ws("|", normalize_key(brand), normalize_key(name), normalize_key(capacity))), 1, 6))
    return F.concat(F.lit("BH-"), F.coalesce(_lookup(category, CATEGORY_CODES), _code(category)), F.lit("-"), _code(brand), F.lit("-"), digest)


def is_generated_sku(sku: Column) -> Column:
    return F.coalesce(sku.rlike("^BH-[A-Z0-9]{3}-[A-Z0-9]{3}-[A-F0-9]{6}$"), F.lit(False))


def normalize_brand(raw: Column) -> Column:
    """brand, parent, is_generic, is_multi and all of a brand cell."""
    return let(F.struct(clean_text(raw).alias("text"), normalize_key(raw).alias("key")), lambda c: _brand(c["text"], c["key"]))


def _brand(text: Column, key: Column) -> Column:
    """Each step is computed once: what is named several times below would multiply inside a lambda."""
    parts = F.filter(F.transform(F.split(text, r"\s*[/,&]\s*|\s+\+\s+"), clean_text), lambda p: p != "")
    every = lambda parts: F.array_distinct(F.transform(parts, lambda p: F.coalesce(_lookup(normalize_key(p), BRAND_ALIASES), title_case(p))))
    shown = F.when(text.rlike("[a-z]") & text.rlike("[A-Z]"), text).otherwise(title_case(text))

    def kinds(c: Column) -> Column:
        kind = F.when(text == "", "none").when(key.isin(*GENERIC_BRANDS), "generic").when(c["known"].isNotNull(), "known").when(F.size(c["all"]) > 1, "multi").when(F.size(c["parts"]) > 1, "same").otherwise("one")
        return F.struct(kind.alias("kind"), c["known"].alias("known"), c["all"].alias("all"))

    def named(c: Column) -> Column:
        kind = c["kind"]
        brand = F.when(kind == "generic", "Generic").when(kind == "known", c["known"]).when(kind.isin("multi", "same"), F.get(c["all"], F.lit(0))).when(kind == "one", shown)
        return F.struct(kind.alias("kind"), brand.alias("brand"), c["all"].alias("all"))

    def out(c: Column) -> Column:
        kind, brand = c["kind"], c["brand"]
        return F.struct(
            brand.alias("brand"), F.when(kind.isin("known", "same"), _lookup(brand, BRAND_PARENTS)).alias("parent"), (kind == "generic").alias("is_generic"), (kind == "multi").alias("is_multi"),
            F.when(kind == "multi", c["all"]).when(brand.isNotNull(), F.array(brand)).otherwise(F.array().cast("array<string>")).alias("all"),
        )

    split = let(parts, lambda p: F.struct(p.alias("parts"), every(p).alias("all"), _lookup(key, BRAND_ALIASES).alias("known")))
    return let(let(let(split, kinds), named), out)


def infer_brand(name: Column) -> Column:
    """The longest known alias that stands in the name as whole words, the first of equals."""
    known = [{"alias": f" {a} ", "brand": BRAND_ALIASES[a]} for a in sorted(BRAND_ALIASES, key=len, reverse=True)]
    padded = F.concat(F.lit(" "), normalize_key(name), F.lit(" "))
    return let(padded, lambda p: F.get(F.filter(constant(known, "array<struct<alias:string,brand:string>>"), lambda k: F.contains(p, k["alias"])), F.lit(0))["brand"])


def _key(term: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\W_]+", " ", term.lower())).strip()


def _forms(term: str) -> list[str]:
    """The term between spaces, alone and as a plural."""
    return [f" {_key(term)}{end} " for end in ("", "s", "es")]


#: The taxonomy as one constant: the plan holds a literal, not an expression for each term.
_KINDS = [
    {"order": -i, "category": category, "terms": [{"base": f" {_key(t)}", "forms": _forms(t)} for t in terms], "subs": [{"name": name, "forms": [f for t in sub for f in _forms(t)]} for name, sub in subs.items()]}
    for i, (category, (terms, subs)) in enumerate(TAXONOMY.items())
]
_KINDS_SCHEMA = "array<struct<order:int,category:string,terms:array<struct<base:string,forms:array<string>>>,subs:array<struct<name:string,forms:array<string>>>>>"


def _has(padded: Column, forms: Column) -> Column:
    return F.exists(forms, lambda f: F.contains(padded, f))


def normalize_category(raw: Column, name: Column) -> Column:
    """category, subcategory, matched and confidence: terms in the category cell count 3, else those in the name 1.

    The best score wins, the earlier category among equals; a cell that fits none stays as it is.
    """
    pad = lambda *c: F.concat(F.lit(" "), F.concat_ws(" ", *c), F.lit(" "))
    keys = F.struct(clean_text(raw).alias("text"), normalize_key(raw).alias("cell"), normalize_key(name).alias("title"))
    return let(let(keys, lambda k: F.struct(k["text"].alias("text"), pad(k["cell"]).alias("cell"), pad(k["title"]).alias("title"), pad(k["cell"], k["title"]).alias("both"))), lambda c: _category(c["text"], c["cell"], c["title"], c["both"]))


def _category(text: Column, cell: Column, title: Column, both: Column) -> Column:
    """`cell`, `title` and `both` stand between spaces; the subcategory is looked for in the best category only."""

    def scored(kind: Column) -> Column:
        hits = lambda key: F.size(F.filter(kind["terms"], lambda t: F.contains(key, t["base"]) & _has(key, t["forms"])))
        return let(hits(cell), lambda n: F.struct(F.when(n > 0, 3 * n).otherwise(hits(title)).alias("score"), kind["order"].alias("order"), kind["category"].alias("category"), kind["subs"].alias("subs")))

    def out(best: Column) -> Column:
        hit = best["score"] > 0
        sub = F.get(F.filter(best["subs"], lambda s: _has(both, s["forms"])), F.lit(0))["name"]
        return F.struct(
            F.when(hit, best["category"]).otherwise(F.nullif(text, F.lit(""))).alias("category"), F.when(hit, sub).alias("subcategory"),
            hit.alias("matched"), F.when(hit, F.least(F.lit(1.0), best["score"] / 3)).otherwise(0.0).alias("confidence"),
        )

    return let(F.array_max(F.transform(constant(_KINDS, _KINDS_SCHEMA), scored)), out)


def _has_word(key: Column, words: tuple[str, ...]) -> Column:
    return key.rlike("(^| )(" + "|".join(sorted({_key(w) for w in words})) + ")( |$)")


def detect_generic(name: Column, brand: Column, notes: Column, condition: Column, sku: Column | None = None) -> Column:
    """is_generic, is_draft and reasons; a missing SKU is one only beside others, and only where `sku` is given."""
    keys = F.struct(clean_text(name).alias("shown"), normalize_key(name).alias("key"), normalize_key(notes).alias("note"))
    return let(keys, lambda k: _generic(k["shown"], k["key"], k["note"], brand, condition, sku))


def _generic(shown: Column, key: Column, note: Column, brand: Column, condition: Column, sku: Column | None) -> Column:
    reasons = F.array_compact(F.array(
        F.when(_has_word(key, GENERIC_WORDS), "name_contains_generic_token"),
        F.when(_has_word(normalize_key(brand), GENERIC_WORDS), "brand_is_generic"),
        F.when((F.length(shown) > 3) & ~contains_arabic(shown) & (shown == F.upper(shown)) & shown.rlike("[A-Z]") & ~shown.rlike(r"\d"), "name_is_all_caps_label"),
    ))
    if sku is not None:
        reasons = let(reasons, lambda r: F.when((F.size(r) > 0) & (F.coalesce(sku, F.lit("")) == ""), F.array_append(r, F.lit("no_sku"))).otherwise(r))
    draft = _has_word(key, DRAFT_WORDS) | _has_word(note, DRAFT_WORDS) | shown.rlike(r"(?i)\(مسودة\)|\(draft\)") | (normalize_key(condition) == "draft")
    return let(reasons, lambda r: F.struct((F.size(r) > 0).alias("is_generic"), draft.alias("is_draft"), r.alias("reasons")))


def detect_procurement(text: Column) -> Column:
    t = F.lower(clean_text(text))
    return (
        F.when(t.rlike(rf"{B0}(avoid|drop|delete){B1}|do not (buy|order)"), "avoid").when(t.rlike(rf"{B0}(hold|test|trial){B1}|sample"), "test_buy")
        .when(t.rlike(rf"{B0}(approve|order|buy){B1}|must buy"), "must_buy").when(t.rlike("opportunit|consider|upsell|cross-sell"), "opportunity")
    )


def split_supplier_sku(c: Column) -> Column:
    """supplier and sku of one cell: around a slash, or the first word and a rest with a digit; else all of it is the SKU."""

    def read(t: Column) -> Column:
        slash, word = r"^(.+?)\s*/\s*(.+)$", r"^(\S+)\s+(.*\d.*)$"
        both = lambda p: F.struct(F.nullif(clean_text(F.regexp_extract(t, p, 1)), F.lit("")).alias("supplier"), clean_text(F.regexp_extract(t, p, 2)).alias("sku"))
        return F.when(t.rlike(slash), both(slash)).when(t.rlike(word), both(word)).otherwise(F.struct(F.lit(None).cast("string").alias("supplier"), F.nullif(t, F.lit("")).alias("sku")))

    return let(clean_text(c), read)
