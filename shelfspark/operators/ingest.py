"""From grids to products: headers, columns, row kinds, sections, typed fields and the merge of repeated drafts.

A grid is (file, sheet, row_index, cells array<string>), one row a spreadsheet row. Sheets hold at most
1,048,576 rows, which bounds what a window over one sheet orders.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.config import ANCHORS, ESTIMATE_HEADER, HEADERS, NOTE_PREFIXES, POLICY, SHEET_SKIPPED, TOTAL_WORDS, Policy
from shelfspark.functions.text import B0, B1, ascii_bounds, clean_text, constant, key_similarity, let, normalize_key
from shelfspark.operators.drafts import to_products

_ALIASES: dict[str, tuple[str, int]] = {}
for _field, _weight, _names, _ in HEADERS:
    for _name in _names:
        if _name not in _ALIASES or _ALIASES[_name][1] < _weight:
            _ALIASES[_name] = (_field, _weight)
_NUMERIC = r"^[-+]?[\d\s,.$%]*\d[\d\s,.$%]*$"


def match_header(cell: Column, policy: Policy = POLICY) -> Column:
    """field, strategy, confidence and specificity of a header cell: an alias, else a pattern, else the nearest alias."""
    both = F.struct(F.lower(clean_text(cell)).alias("text"), normalize_key(cell).alias("key"))
    return let(both, lambda c: let(_header(c["text"], c["key"], policy), lambda m: m.withField("specificity", F.coalesce(F.element_at(constant(_WEIGHTS, "map<string,int>"), m["field"]), F.lit(0)))))


_WEIGHTS: dict[str, int] = {}
for _field, _weight, _, _ in HEADERS:
    _WEIGHTS[_field] = max(_weight, _WEIGHTS.get(_field, 0))


def _header(text: Column, key: Column, policy: Policy) -> Column:
    exact = F.element_at(constant({a: f for a, (f, _) in _ALIASES.items()}, "map<string,string>"), text)
    pattern = F.lit(None).cast("string")
    for field, _, _, found in sorted((h for h in HEADERS if h[3]), key=lambda h: h[1]):  # the most specific is asked first
        pattern = F.when(text.rlike("|".join(ascii_bounds(p) for p in found)), field).otherwise(pattern)
    names = constant([{"alias": re.sub(r"[\W_]+", " ", a).strip(), "field": f} for a, (f, _) in _ALIASES.items() if len(a) > 2 and a.isascii()], "array<struct<alias:string,field:string>>")
    near = F.array_max(F.transform(names, lambda a: F.struct(key_similarity(a["alias"], key).alias("s"), a["field"].alias("field"))))
    return let(near, lambda near: (
        F.when(text == "", F.struct(F.lit(None).cast("string").alias("field"), F.lit("none").alias("strategy"), F.lit(0.0).alias("confidence")))
        .when(exact.isNotNull(), F.struct(exact.alias("field"), F.lit("exact").alias("strategy"), F.lit(1.0).alias("confidence")))
        .when(pattern.isNotNull(), F.struct(pattern.alias("field"), F.lit("pattern").alias("strategy"), F.lit(0.9).alias("confidence")))
        .when(near["s"] >= policy.header_similar, F.struct(near["field"].alias("field"), F.lit("fuzzy").alias("strategy"), F.round(near["s"], 3).alias("confidence")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("field"), F.lit("none").alias("strategy"), F.lit(0.0).alias("confidence")))
    ))


def _header_cells(grid: DataFrame, policy: Policy) -> DataFrame:
    """The cells of the first rows with what each would name as a header; equal texts are matched once."""
    top = grid.where(F.col("row_index") <= policy.header_depth).select("file", "sheet", "row_index", F.posexplode("cells").alias("col", "cell")).where(F.trim(F.coalesce("cell", F.lit(""))) != "")
    known = top.select("cell").distinct().withColumn("m", match_header(F.col("cell"), policy))
    return top.join(known, "cell")


def detect_headers(grid: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """file, sheet, header_index and score: the best row among the first, the earliest of equals; sheets without one are left out."""
    text = clean_text(F.col("cell"))
    numeric = F.col("cell").rlike(_NUMERIC)
    long = ~numeric & ((F.length(text) > 60) | (F.size(F.split(text, " ")) > 10))
    mapped = ~numeric & ~long & F.col("m.field").isNotNull() & (F.col("m.confidence") >= 0.8)
    n = lambda c: F.sum(c.cast("int"))
    rows = _header_cells(grid, policy).groupBy("file", "sheet", "row_index").agg(
        n(mapped).alias("mapped"), n(mapped & F.col("m.field").isin(*ANCHORS)).alias("anchors"), F.count("*").alias("filled"), n(numeric).alias("numeric"), n(long).alias("long"),
    ).where(F.col("mapped") >= policy.header_min_mapped)
    score = 3 * F.col("mapped") + 2 * F.col("anchors") + 0.25 * F.col("filled") - 2 * F.col("numeric") - 3 * F.col("long")
    best = rows.withColumn("score", score.cast("double")).groupBy("file", "sheet").agg(F.max_by(F.struct("row_index", "score", "mapped", "anchors"), F.struct("score", -F.col("row_index"))).alias("b"))
    return best.where((F.col("b.anchors") > 0) | (F.col("b.mapped") >= 3)).select("file", "sheet", F.col("b.row_index").alias("header_index"), F.col("b.score").alias("score"))


def map_columns(grid: DataFrame, headers: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """file, sheet, col, header, field, confidence, currency, is_estimate, displaced_by: of columns that claim one field the best keeps it."""
    cells = _header_cells(grid, policy).join(headers.select("file", "sheet", F.col("header_index").alias("row_index")), ["file", "sheet", "row_index"])
    text = F.lower(clean_text(F.col("cell")))
    currency = F.when(text.rlike(rf"egp|{B0}le{B1}|ج\.?\s*م|جنيه"), "EGP").when(text.rlike(r"usd|\$|dollar"), "USD")
    own = cells.select("file", "sheet", "col", clean_text(F.col("cell")).alias("header"), text.rlike(ascii_bounds(ESTIMATE_HEADER)).alias("is_estimate"), F.col("m.field").alias("claim"), F.col("m.confidence").alias("confidence"), F.col("m.specificity").alias("specificity"), currency.alias("currency"))
    best = own.where("claim is not null").groupBy("file", "sheet", "claim").agg(F.max_by("col", F.struct(F.col("specificity") * 10 + F.col("confidence"), -F.col("col"))).alias("winner"))
    out = own.join(best, ["file", "sheet", "claim"], "left")
    wins = F.col("col") == F.col("winner")
    return out.select("file", "sheet", "col", "header", F.when(wins, F.col("claim")).alias("field"), F.when(wins, F.col("confidence")).otherwise(0.0).alias("confidence"), "currency", "is_estimate", F.when(~wins, F.col("winner")).alias("displaced_by"))


def sheet_currency(mapping: DataFrame) -> DataFrame:
    """The currency that most columns of a sheet name; the leftmost wins among equals."""
    votes = mapping.where("currency is not null").groupBy("file", "sheet", "currency").agg(F.count("*").alias("n"), F.min("col").alias("first"))
    return votes.groupBy("file", "sheet").agg(F.max_by("currency", F.struct("n", -F.col("first"))).alias("currency"))


def classify_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds header_index, kind (empty, header, total, section, title, data) and the section a row belongs to."""
    rows = grid.join(headers.select("file", "sheet", "header_index"), ["file", "sheet"])
    filled = F.filter("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    texts = F.filter(filled, lambda c: ~c.rlike(_NUMERIC))
    n, first = F.size(filled), clean_text(F.get(filled, F.lit(0)))
    place = F.array_position(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), True)
    is_total = F.exists(texts, lambda c: normalize_key(c).isin(*TOTAL_WORDS)) & (n <= F.greatest(F.lit(3), F.ceil(F.size("cells") / 3)))
    note = reduce(lambda a, b: a | b, (F.startswith(F.lower(first), F.lit(p)) for p in NOTE_PREFIXES))
    before = F.col("row_index") < F.col("header_index")
    long = (F.length(first) > 90) | (F.size(F.split(first, " ")) > 12)
    second = clean_text(F.get(filled, F.lit(1)))
    kind = (
        F.when(n == 0, "empty").when(F.col("row_index") == F.col("header_index"), "header").when(is_total, "total")
        .when((n == 1) & (F.size(texts) == 0), "empty").when((n == 1) & (before | note | long | (place > 2)), "title").when(n == 1, "section")
        .when((n == 2) & (F.size(texts) == 2) & (F.length(first) <= 2) & (F.length(second) > 60), "title").when(before, "title").when(F.size(texts) == 0, "total").otherwise("data")
    )
    rows = rows.withColumns({"kind": kind, "_text": first})
    upto = Window.partitionBy("file", "sheet").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("_text")), ignorenulls=True).over(upto)).drop("_text")


def skip_reason(sheet: Column) -> Column:
    return reduce(lambda c, x: c.when(sheet.rlike(f"(?i){x[0]}"), x[1]), SHEET_SKIPPED[1:], F.when(sheet.rlike(f"(?i){SHEET_SKIPPED[0][0]}"), SHEET_SKIPPED[0][1]))


def extract_fields(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Data rows with `fields` (name to text), `hints` (name to what its header says of money) and `extras` (unmapped header to text).

    A sheet's column map, with the mean confidence of what it mapped, joins once per sheet.
    """
    mapped = F.col("field").isNotNull()
    maps = mapping.groupBy("file", "sheet").agg(  # at most a sheet's width
        F.sort_array(F.collect_list(F.struct("col", "field", "header", "currency", "is_estimate"))).alias("columns"), F.coalesce(F.round(F.avg(F.when(mapped, F.col("confidence"))), 3), F.lit(0.0)).alias("mapping_confidence"),
    )
    data = rows.where("kind = 'data'").join(maps, ["file", "sheet"])
    cell = lambda m: F.get("cells", m["col"])
    there = lambda m: F.trim(F.coalesce(cell(m), F.lit(""))) != ""
    kept = F.filter("columns", lambda m: m["field"].isNotNull())
    fields = F.map_from_entries(F.transform(F.filter(kept, there), lambda m: F.struct(m["field"], cell(m))))
    hints = F.map_from_entries(F.transform(kept, lambda m: F.struct(m["field"], F.struct(m["currency"].alias("currency"), m["is_estimate"].alias("is_estimate")))))
    extras = F.aggregate(F.filter("columns", lambda m: m["field"].isNull() & there(m)), F.create_map().cast("map<string,string>"), lambda a, m: F.map_concat(F.map_filter(a, lambda k, _: k != m["header"]), F.create_map(m["header"], clean_text(cell(m)))))
    return data.select("file", "sheet", "row_index", "section", fields.alias("fields"), hints.alias("hints"), extras.alias("extras"), "mapping_confidence")


def dedupe(drafts: DataFrame, score: str = "score", key: str = "fingerprint", order: tuple[str, ...] = ("file", "sheet", "row_index")) -> DataFrame:
    """One row a key: the best score wins, the earlier of equals; what it lacks comes from the next best that has it.

    Plain aggregates with partial sums on the map side, whatever the size of a group. A map has the entries
    of all rows, of one name the best row's. `notes`, where there are, are those of all rows, each once;
    `n_sources` counts the rows, `other_sources` lists them. With three rows or more, later rows are compared
    with the winner's own score, not with that of the row merged so far; a strict left-to-right fold could
    pick another row there.
    """
    place = F.struct((-F.col(score)).alias("s"), *order)
    types = dict(drafts.dtypes)
    maps = [c for c, t in types.items() if t.startswith("map")]
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in types if c not in (key, "notes", *maps)]
    notes = F.array_compact(F.array("notes")) if types.get("notes") == "string" else F.col("notes")
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(notes)))).alias("notes")] if "notes" in types else []
    out = drafts.groupBy(key).agg(*filled, *union, F.count("*").alias("n_sources"))
    for c in maps:  # as many entries as there are names, not rows
        entries = drafts.select(F.col(key).alias("_key"), place.alias("_at"), F.explode(c).alias("_name", "_value"))
        best = entries.groupBy("_key", "_name").agg(F.min_by("_value", "_at").alias("_value"))
        merged = best.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias(c))
        out = out.join(merged, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(c, F.coalesce(c, F.create_map().cast(types[c])))
    return out


def other_sources(drafts: DataFrame, score: str = "score", key: str = "fingerprint", order: tuple[str, ...] = ("file", "sheet", "row_index")) -> DataFrame:
    """The place of every draft that another one of its key was merged over: a row each, as a product may have any number."""
    row = F.struct(*order)
    won = drafts.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct((-F.col(score)).alias("s"), *order)).alias("_won"))
    return drafts.join(won, F.col(key).eqNullSafe(F.col("_key"))).where(~row.eqNullSafe(F.col("_won"))).select(key, *order)


def chosen(grid: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The rows of the sheets asked for, whatever the case of their names; the excluded ones go last."""
    low = F.lower(F.trim("sheet"))
    out = grid.where(low.isin([x.strip().lower() for x in only])) if only else grid
    return out.where(~low.isin([x.strip().lower() for x in exclude])) if exclude else out


def parse(grid: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Product drafts of all sheets that hold products."""
    own = grid.where(skip_reason(F.col("sheet")).isNull())
    headers = detect_headers(own, policy)
    mapping = map_columns(own, headers, policy)
    return to_products(extract_fields(classify_rows(own, headers), mapping), sheet_currency(mapping))


def sheet_report(grid: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Rows read and rows of each kind, for each sheet; skipped sheets with their reason."""
    own = grid.where(skip_reason(F.col("sheet")).isNull())
    kinds = classify_rows(own, detect_headers(own, policy)).groupBy("file", "sheet").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("data", "section", "title", "total", "empty")))
    return grid.groupBy("file", "sheet").agg(F.count("*").alias("rows_read")).join(kinds, ["file", "sheet"], "left").withColumn("skipped", F.coalesce(skip_reason(F.col("sheet")), F.when(F.col("data").isNull(), "no_header")))
