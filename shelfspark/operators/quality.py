"""Validation, completeness, scores, duplicates and their roll-ups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.config import COMPLETENESS, GRADES, ISSUES, POLICY, SEVERITIES, Policy
from shelfspark.functions.identity import is_generated_sku
from shelfspark.functions.money import js_round, non_zero
from shelfspark.functions.text import key_similarity, normalize_key, sku_key
from shelfspark.operators.pricing import alert_rules


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def rules(policy: Policy = POLICY, unparsed: bool = False) -> list[tuple[str, Column]]:
    """Code and condition of each defect, in the order in which they are listed; `unparsed` where the rows name columns that no field was found for."""
    own = is_generated_sku(F.col("sku"))
    return [
        ("MISSING_NAME", _blank("name")), ("MISSING_BRAND", _blank("brand")), ("MISSING_CATEGORY", _blank("category")),
        ("MISSING_SKU", _blank("sku")), ("GENERATED_SKU", ~_blank("sku") & own), *alert_rules(policy), ("PRICE_RANGE_ONLY", F.col("is_range")),
        ("MISSING_SPECS", ~F.col("has_specs")), ("MISSING_SUPPLIER", _blank("supplier")), ("MISSING_QUANTITY", F.coalesce("quantity", F.lit(0)) <= 0),
        ("MISSING_IMAGES", ~F.col("has_image")), ("GENERIC_ITEM", F.col("is_generic")), ("DRAFT_ITEM", F.col("is_draft")),
        *([("UNPARSED_COLUMNS", F.coalesce(F.size("unmapped_columns") > 0, F.lit(False)))] if unparsed else []), ("UNMAPPED_CATEGORY", F.col("category_unmapped")), ("SKU_CORRECTED", F.col("sku_corrected")), ("COST_MISMATCH", F.col("cost_mismatch")), ("AMBIGUOUS_SKU", F.col("sku_ambiguous")),
    ]


def present(policy: Policy = POLICY) -> dict[str, Column]:
    """Which fields count as there: 0 and false do, blanks do not."""
    return {
        **{c: ~_blank(c) for c in ("name", "brand", "sku", "category", "currency", "supplier")},
        **{c: F.col(c).isNotNull() for c in ("rdp", "selling_price")}, "market": F.col("market_high").isNotNull(), "any_spec": F.col("has_specs"),
        "condition": F.coalesce("condition", F.lit("unknown")) != "unknown", "description": F.col("has_description"), "quantity": F.coalesce("quantity", F.lit(0)) > 0, "images": F.col("has_image"),
    }


def severity_of(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, (s, _) in ISSUES.items() for x in (k, s))), code), F.lit("info"))


def penalty_of(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, (_, p) in ISSUES.items() for x in (k, p))), code), F.lit(0))


def _of_severity(severity: str) -> Column:
    return F.size(F.filter("issues", lambda c: severity_of(c) == severity)).cast("long")


def grade_for(score: Column) -> Column:
    return reduce(lambda c, g: c.when(score >= g[0], g[1]), GRADES[1:], F.when(score >= GRADES[0][0], GRADES[0][1])).otherwise("F")


def with_quality(priced: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds issue codes, completeness, penalties (each code once), score, grade and what blocks publishing."""
    there = present(policy)
    groups = {g: reduce(add, (F.when(there[f], w).otherwise(0) for f, w in fields.items())) for g, fields in COMPLETENESS.items()}
    missing = F.array_compact(F.array(*(F.when(~there[f], f) for fields in COMPLETENESS.values() for f in fields)))
    listed = F.array_compact(F.array(*(F.when(c, code) for code, c in rules(policy, "unmapped_columns" in priced.columns))))
    if "extra_issues" in priced.columns:  # codes that other rows or sources tell of
        listed = F.concat(listed, "extra_issues")
    df = priced.withColumns({"issues": listed, **{f"earned_{g}": c.cast("long") for g, c in groups.items()}, "missing": missing})
    df = df.withColumns({
        "completeness": reduce(add, (F.col(f"earned_{g}") for g in groups)).cast("double"),
        "penalties": F.aggregate(F.array_distinct("issues"), F.lit(0), lambda a, c: a + penalty_of(c)).cast("long"),
        **{f"n_{s}": _of_severity(s) for s in SEVERITIES},
    })
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round(F.col("completeness") - F.col("penalties"), 1))))
    return df.withColumns({"grade": grade_for(F.col("score")), "is_blocked": F.col("n_critical") > 0})


def overview(scored: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Totals over all rows, inactive ones too."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return scored.agg(
        F.count("*").alias("products"), non_zero(js_round(F.avg("score"), 1)).alias("avg_score"), non_zero(js_round(F.avg("completeness"), 1)).alias("avg_completeness"),
        n(F.col("is_verified")).alias("verified"), n(F.col("is_generic")).alias("generic"), n(F.col("is_draft")).alias("draft"),
        n(F.col("score") >= policy.min_quality).alias("publishable"), n(F.size("issues") > 0).alias("with_issues"),
    )


def issues_by_code(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n")).withColumn("severity", severity_of(F.col("code"))).orderBy(F.desc("n"), "code")


def issues_by_severity(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("issues").alias("code")).groupBy(severity_of(F.col("code")).alias("severity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "severity")


def score_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.when(F.col("score").isNull(), "unscored").otherwise(F.col("grade")).alias("grade")).agg(F.count("*").alias("n")).orderBy("grade")


def completeness_detail(scored: DataFrame) -> DataFrame:
    """The breakdown of each product's score."""
    return scored.select("id", *(f"earned_{g}" for g in COMPLETENESS), "completeness", "penalties", "score", "grade", *(f"n_{s}" for s in SEVERITIES), "is_blocked", F.array_join("issues", ",").alias("issue_codes"), F.array_join("missing", ",").alias("missing_fields"))


explain = completeness_detail


def worst(scored: DataFrame, limit: int = 25, severity: str | None = None) -> DataFrame:
    rows = scored.where(F.exists("issues", lambda c: severity_of(c) == severity)) if severity else scored
    return rows.select("id", "name", "score", F.size("issues").cast("long").alias("n_issues")).orderBy("score", "id").limit(limit)


def duplicate_skus(df: DataFrame) -> DataFrame:
    """SKUs of more than one row: how many, how many different names, and what that makes of them.

    Members are counted, not gathered, so that a SKU shared by millions of rows is one small group.
    """
    keyed = df.select(sku_key(F.col("sku")).alias("sku_key"), normalize_key(F.col("name")).alias("name_key"), "id").where("sku_key is not null")
    per_name = keyed.groupBy("sku_key", "name_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    out = per_name.groupBy("sku_key").agg(F.sum("n").alias("n"), F.count("*").alias("n_names"), F.min("first_id").alias("first_id")).where("n > 1")
    return out.withColumns({"kind": F.when(F.col("n_names") > 1, "conflict").otherwise("duplicate"), "severity": F.when(F.col("n_names") > 1, "critical").otherwise("high")}).orderBy(F.desc("n"), "sku_key")


def sku_collisions(df: DataFrame) -> DataFrame:
    """Rows whose SKU, other than a generated one, is also another row's: one row for each, with the group's size."""
    keyed = df.where(~is_generated_sku(F.col("sku"))).select("id", "name", "source_catalog", sku_key(F.col("sku")).alias("sku_key")).where("sku_key is not null")
    groups = keyed.groupBy("sku_key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(groups, "sku_key").select("id", "name", "source_catalog", "sku_key", "n", (F.col("n") - 1).alias("n_others"))


def collision_members(df: DataFrame) -> DataFrame:
    """Every member of every group of rows that share an SKU which is not generated: sku_key, id, name, source and n_others, its number of links.

    A row's others are the members of its group but itself, all of them; the groups are rows, so one of any size
    is whole and no row is paired with its whole group.
    """
    return sku_collisions(df).select("sku_key", "id", "name", "source_catalog", "n_others")


def with_collisions(priced: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Scored rows, where DUPLICATE_SKU is told of every row whose SKU another row has."""
    shared = sku_collisions(priced).select("id").withColumn("_shared", F.lit(True))
    rows = priced.join(shared, "id", "left").withColumn("extra_issues", F.when(F.col("_shared"), F.array(F.lit("DUPLICATE_SKU"))).otherwise(F.array().cast("array<string>")))
    return with_quality(rows.drop("_shared"), policy)


#: Issues that a value mends, by field, label and kind of value; and those that need a decision.
FIXABLE = {
    "MISSING_COST": ("rdp", "Wholesale cost", "money"), "MISSING_SELLING_PRICE": ("selling_price", "Selling price", "money"), "MISSING_CURRENCY": ("currency", "Currency", "currency"),
    "MISSING_QUANTITY": ("quantity", "Quantity", "integer"), "MISSING_SUPPLIER": ("supplier", "Supplier", "text"), "MISSING_BRAND": ("brand", "Brand", "text"), "MISSING_CATEGORY": ("category", "Category", "text"),
    "PRICE_RANGE_ONLY": ("selling_price", "Exact selling price", "money"), "ESTIMATED_PRICE": ("selling_price", "Confirmed selling price", "money"), "SELLING_BELOW_COST": ("selling_price", "Selling price", "money"),
    "MISSING_SPECS": ("capacity", "Capacity / spec", "text"),
}
DECISIONS = ("DUPLICATE_SKU", "AMBIGUOUS_SKU", "DUPLICATE_PRODUCT", "COST_MISMATCH", "MARKET_BELOW_COST", "IMPLAUSIBLE_MARGIN", "GENERIC_ITEM", "DRAFT_ITEM")


def fix_queue(scored: DataFrame) -> DataFrame:
    """Each issue of each row with what mends it: a value for a field, a decision, or neither."""
    code = F.col("code")
    of = lambda at: F.element_at(F.create_map(*(F.lit(x) for k, v in FIXABLE.items() for x in (k, v[at]))), code)
    kind = F.when(code.isin(*FIXABLE), "fix").when(code.isin(*DECISIONS), "decide").otherwise("other")
    return scored.select("id", F.explode("issues").alias("code")).select("id", "code", severity_of(code).alias("severity"), kind.alias("queue"), of(0).alias("field"), of(1).alias("label"), of(2).alias("type"))


def ranked_issues(issues: Column) -> Column:
    """Codes by severity, the gravest first, then by name."""
    rank = lambda c: F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity_of(c))
    return F.transform(F.array_sort(F.transform(issues, lambda c: F.struct(rank(c).alias("r"), c.alias("c")))), lambda x: x["c"])


def _by_words(classes: DataFrame, least: float) -> DataFrame:
    """Pairs of keys whose word sets may have a Jaccard similarity of `least`: they share one of their rarest words."""
    words = classes.select("brand_key", "name_key", F.explode(F.array_distinct(F.split("name_key", " "))).alias("word"))
    counts = words.groupBy("brand_key", "word").agg(F.count("*").alias("df"))
    own = words.join(counts, ["brand_key", "word"]).groupBy("brand_key", "name_key").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("words"))
    size = F.size("words")
    rare = own.select("brand_key", "name_key", size.alias("n"), F.explode(F.slice("words", F.lit(1), (size - F.ceil(least * size - 1e-9) + 1).cast("int"))).alias("w"))
    a, b = rare.select("brand_key", "name_key", "n", F.col("w.word").alias("word")), rare.select("brand_key", F.col("name_key").alias("other"), F.col("n").alias("m"), F.col("w.word").alias("word"))
    return a.join(b, ["brand_key", "word"]).where((F.col("name_key") < F.col("other")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)).select("brand_key", "name_key", "other")


def _by_pieces(classes: DataFrame, edit: float) -> DataFrame:
    """Pairs of keys that may be as alike as `edit` by edits: of one key cut in one piece more than edits allow, one stands unchanged in the other near its place."""
    most = F.floor((1 - edit) * F.length("name_key") / edit + 1e-9).cast("int")  # edits between this key and any other as alike
    cut = lambda i: F.floor(i * F.length("name_key") / (F.col("edits") + 1)).cast("int")
    own = classes.select("brand_key", "name_key", most.alias("edits")).select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i"))
    own = own.select("brand_key", "name_key", "edits", (cut(F.col("i")) + 1).alias("at"), F.substring(F.col("name_key"), cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("piece")).where("piece <> ''")
    sizes = own.select("brand_key", F.length("piece").alias("size")).distinct()
    places = F.transform(F.sequence(F.lit(1), F.length("name_key") - F.col("size") + 1), lambda p: F.struct(p.alias("at"), F.substring(F.col("name_key"), p, F.col("size")).alias("piece")))
    grams = classes.join(sizes, "brand_key").where(F.length("name_key") >= F.col("size")).select("brand_key", F.col("name_key").alias("other"), F.explode(places).alias("g"))
    grams = grams.select("brand_key", "other", F.col("g.at").alias("at_other"), F.col("g.piece").alias("piece"))
    x, y = F.length("name_key"), F.length("other")
    hits = own.join(grams, ["brand_key", "piece"]).where((F.abs(F.col("at") - F.col("at_other")) <= F.col("edits")) & (F.col("name_key") != F.col("other")) & (F.least(x, y) >= edit * F.greatest(x, y) - 1e-9))
    return hits.select("brand_key", F.least("name_key", "other").alias("name_key"), F.greatest("name_key", "other").alias("other"))


#: Share of common words under which two names are looked for by their edits alone.
LEAST_SHARED = 0.125


def near_duplicates(df: DataFrame, threshold: float = POLICY.similar) -> DataFrame:
    """Pairs of different name keys of one brand that are alike, with the rows of each. No pair is lost.

    Equal keys are one class, so copies never multiply. A pair reaches the threshold either by the blend
    0.4 words + 0.6 edits or by 0.95 edits alone. For the blend its word sets overlap by `shared`, or its
    edits make up for less: by (threshold - 0.4 shared) / 0.6. From 0.65 on only equal keys could do that; under
    it pairs with few common words count too, and the lower the threshold the shorter the pieces they are
    found by, so it costs more. Candidates of all ways are checked.
    """
    if not 0.5 <= threshold <= 1:
        raise ValueError("the threshold must be between 0.5 and 1")
    least = threshold - 0.0005  # similarities are rounded to three places
    shared = max((least - 0.6) / 0.4, LEAST_SHARED)
    keys = df.where("is_active").select(F.coalesce(normalize_key(F.col("brand")), F.lit("")).alias("brand_key"), normalize_key(F.col("name")).alias("name_key"), "id").where("name_key <> ''")
    classes = keys.groupBy("brand_key", "name_key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    found = _by_words(classes, shared)
    if shared == LEAST_SHARED:
        found = found.unionByName(_by_pieces(classes, (least - 0.4 * shared) / 0.6))
    if least <= 0.95:
        found = found.unionByName(_by_pieces(classes.where(F.length("name_key") >= 6), least / 0.95))
    near = found.distinct().withColumn("similarity", F.round(key_similarity(F.col("name_key"), F.col("other")), 3)).where(F.col("similarity") >= threshold)
    a = classes.select("brand_key", "name_key", F.col("n").alias("n_a"), F.col("id").alias("id_a"))
    b = classes.select("brand_key", F.col("name_key").alias("other"), F.col("n").alias("n_b"), F.col("id").alias("id_b"))
    out = near.join(a, ["brand_key", "name_key"]).join(b, ["brand_key", "other"])
    return out.select("brand_key", F.col("name_key").alias("name_a"), F.col("other").alias("name_b"), "id_a", "id_b", "n_a", "n_b", "similarity")


def rubric(spark: SparkSession) -> DataFrame:
    rows = [("penalty", c, s, float(p)) for c, (s, p) in ISSUES.items()] + [("weight", f, g, float(w)) for g, fields in COMPLETENESS.items() for f, w in fields.items()]
    return spark.createDataFrame(rows, "kind string, name string, grp string, points double")


def rubric_use(scored: DataFrame) -> DataFrame:
    """Every issue of the rubric with its severity and penalty, how many products have it, and the points it took from them; 0 where none has."""
    rules = rubric(scored.sparkSession).where("kind = 'penalty'").select(F.col("name").alias("code"), F.col("grp").alias("severity"), F.col("points").alias("penalty"))
    seen = scored.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return rules.join(seen, "code", "left").select("code", "severity", "penalty", n.alias("n"), (n * F.col("penalty")).alias("points"))


def rescore_counts(stored: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """What a rescore would change: `stored` has `score` as `was` beside the product columns."""
    now = with_quality(stored, policy)
    n = lambda c: F.sum(c.cast("long"))
    return now.agg(F.count("*").alias("scanned"), n(F.col("score") != F.col("was")).alias("changed"), n(F.col("score") > F.col("was")).alias("improved"), n(F.col("score") < F.col("was")).alias("degraded"))
