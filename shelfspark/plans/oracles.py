"""DuckDB SQL for the named queries: the product view as common table expressions, then one SELECT each."""

from __future__ import annotations

from shelfspark.config import COMPLETENESS, ISSUES

DIMENSIONS = {"category": "category", "subcategory": "subcategory", "brand": "brand", "supplier": "supplier", "procurement": "procurement", "source": "source_catalog", "currency": "currency"}


def r1(x: str, places: int = 2) -> str:
    scale = float(10**places)
    return f"(floor(({x} + 2.220446049250313e-16) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE)"


def fx(x: str) -> str:
    return f"CASE WHEN currency = 'USD' THEN {r1(f'{x} * 48.5::DOUBLE')} WHEN currency = 'EGP' THEN {r1(x)} END"


def band(m: str) -> str:
    return f"CASE WHEN {m} IS NULL THEN 'unknown' WHEN {m} > 900 THEN 'implausible' WHEN {m} < 0 THEN 'loss' WHEN {m} < 10 THEN 'critical' WHEN {m} < 25 THEN 'low' WHEN {m} < 54 THEN 'healthy' ELSE 'target' END"


def total(x: str) -> str:
    return f"coalesce(sum(coalesce({x}, 0)::DECIMAL(20,4)), 0)::DOUBLE"


def mean(c: str) -> str:
    return f"nullif({r1(f'(sum({c}::DECIMAL(20,4))::DOUBLE / nullif(count({c}), 0))')}, 0)"


VIEW = f"""WITH units AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS u FROM lineitem GROUP BY ALL),
best AS (SELECT l_partkey, l_suppkey FROM units QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY u DESC, l_suppkey) = 1),
sup AS (SELECT l_partkey AS sid, s_name AS supplier FROM best JOIN supplier ON s_suppkey = l_suppkey),
raw AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 40 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category,
  CASE WHEN p_partkey % 37 <> 0 THEN 'P-' || (p_partkey % 900) END AS sku,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 BETWEEN 1 AND 3 THEN 'USD' ELSE 'EGP' END AS currency,
  CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS rdp, CASE WHEN p_partkey % 7 = 0 THEN {r1('p_retailprice * 1.6::DOUBLE')} END AS rrp,
  CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 101 = 0 THEN p_retailprice * 12 ELSE {r1('p_retailprice * (85 + (p_partkey * 7) % 90) / 100')} END AS asked,
  CASE WHEN p_partkey % 6 = 0 THEN {r1('p_retailprice * (70 + (p_partkey * 3) % 60) / 100')} END AS market_high,
  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END::BIGINT AS quantity, p_partkey % 3 AS reserved, p_partkey % 19 <> 0 AS is_active, p_partkey % 3 = 0 AS is_verified,
  p_partkey % 23 = 0 AS is_draft, p_partkey % 29 = 0 AS is_generic, ['must_buy','test_buy','avoid','opportunity','unclassified'][p_partkey % 5 + 1] AS procurement,
  ['new','used','unknown','refurbished'][p_partkey % 4 + 1] AS condition, p_partkey % 4 <> 0 AS has_image, p_partkey % 9 <> 0 AS has_specs, p_partkey % 3 <> 0 AS has_description,
  p_partkey % 31 = 0 AS is_estimated, p_partkey % 43 = 0 AS is_range, p_partkey % 47 = 0 AS category_unmapped, p_partkey % 53 = 0 AS cost_mismatch, p_partkey % 59 = 0 AS sku_ambiguous,
  p_partkey % 61 = 0 AS sku_corrected, 'catalog-' || (p_partkey % 4) AS source_catalog, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'review' END AS lifecycle,
  p_name || ' ' || p_brand || ' ' || p_type AS text, CASE WHEN p_partkey % 21 <> 0 THEN p_type || ' ' || (p_partkey % 3) END AS subcategory, (p_partkey * 7919) % 100003 AS updated, supplier FROM part LEFT JOIN sup ON sid = p_partkey),
p0 AS (SELECT *, coalesce(asked, rrp) AS selling_price FROM raw),
products AS (SELECT *, CASE WHEN rdp > 0 THEN {r1('(selling_price - rdp) / rdp * 100')} END AS margin, CASE WHEN selling_price > 0 THEN {r1('(selling_price - rdp) / selling_price * 100')} END AS gross_margin,
  {r1('selling_price - rdp')} AS margin_value, CASE WHEN currency = 'USD' THEN 48.5::DOUBLE WHEN currency = 'EGP' THEN 1::DOUBLE END AS fx_rate, {fx('rdp')} AS norm_rdp, {fx('rrp')} AS norm_rrp, {fx('selling_price')} AS norm_selling_price,
  {band("CASE WHEN rdp > 0 THEN " + r1('(selling_price - rdp) / rdp * 100') + " END")} AS band FROM p0)"""

#: In the order of the rules.
CONDITIONS = {
    "MISSING_NAME": "trim(coalesce(name, '')) = ''", "MISSING_BRAND": "brand IS NULL", "MISSING_CATEGORY": "category IS NULL", "MISSING_SKU": "sku IS NULL",
    "GENERATED_SKU": "regexp_matches(sku, '^BH-[A-Z0-9]{3}-[A-Z0-9]{3}-[A-F0-9]{6}$')", "NEGATIVE_PRICE": "rdp < 0 OR selling_price < 0", "MISSING_COST": "coalesce(rdp, 0) = 0",
    "MISSING_SELLING_PRICE": "coalesce(selling_price, 0) = 0", "MISSING_CURRENCY": "currency IS NULL AND (rdp IS NOT NULL OR selling_price IS NOT NULL OR rrp IS NOT NULL)",
    "RRP_BELOW_COST": "rrp > 0 AND rrp < rdp", "SELLING_BELOW_COST": "selling_price > 0 AND selling_price < rdp", "MARKET_BELOW_COST": "market_high < rdp", "IMPLAUSIBLE_MARGIN": "margin > 900",
    "CRITICAL_MARGIN": "margin >= 0 AND margin < 10", "LOW_MARGIN": "margin >= 10 AND margin < 25", "ESTIMATED_PRICE": "is_estimated", "PRICE_RANGE_ONLY": "is_range", "MISSING_SPECS": "NOT has_specs",
    "MISSING_SUPPLIER": "supplier IS NULL", "MISSING_QUANTITY": "quantity <= 0", "MISSING_IMAGES": "NOT has_image", "GENERIC_ITEM": "is_generic", "DRAFT_ITEM": "is_draft",
    "UNMAPPED_CATEGORY": "category_unmapped", "SKU_CORRECTED": "sku_corrected", "COST_MISMATCH": "cost_mismatch", "AMBIGUOUS_SKU": "sku_ambiguous",
}
PRESENT = {
    "name": "name <> ''", "brand": "brand IS NOT NULL", "sku": "sku IS NOT NULL", "category": "category IS NOT NULL", "currency": "currency IS NOT NULL", "rdp": "rdp IS NOT NULL",
    "selling_price": "selling_price IS NOT NULL", "market": "market_high IS NOT NULL", "any_spec": "has_specs", "condition": "condition <> 'unknown'", "description": "has_description",
    "supplier": "supplier IS NOT NULL", "quantity": "quantity > 0", "images": "has_image",
}
_earned = ", ".join("(" + " + ".join(f"CASE WHEN {PRESENT[f]} THEN {w} ELSE 0 END" for f, w in fields.items()) + f")::BIGINT AS earned_{g}" for g, fields in COMPLETENESS.items())
_missing = "coalesce(array_to_string([" + ", ".join(f"CASE WHEN {PRESENT[f]} THEN NULL ELSE '{f}' END" for fields in COMPLETENESS.values() for f in fields) + "], ','), '') AS missing_fields"
_codes = "[" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in CONDITIONS.items()) + "] AS issues"
_penalty = "(" + " + ".join(f"CASE WHEN {c} THEN {ISSUES[k][1]} ELSE 0 END" for k, c in CONDITIONS.items()) + ")::BIGINT AS penalties"
_counts = ", ".join("(" + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for k, c in CONDITIONS.items() if ISSUES[k][0] == s) + f")::BIGINT AS n_{s}" for s in ("critical", "high", "medium", "low", "info"))
_sum = " + ".join(f"earned_{g}" for g in COMPLETENESS)
SCORED = f"""{VIEW}, s0 AS (SELECT *, {_earned}, {_missing}, {_codes}, {_penalty}, {_counts} FROM products),
s1 AS (SELECT *, ({_sum})::DOUBLE AS completeness, greatest(0::DOUBLE, least(100::DOUBLE, {r1(f'({_sum})::DOUBLE - penalties', 1)})) AS score FROM s0),
scored AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, n_critical > 0 AS is_blocked FROM s1)"""
_severity = "CASE " + " ".join(f"WHEN code = '{k}' THEN '{s}'" for k, (s, _) in ISSUES.items()) + " END"
_cost, _retail = total("coalesce(norm_rdp, 0) * coalesce(quantity, 0)"), total("coalesce(norm_selling_price, 0) * coalesce(quantity, 0)")
MEASURES = f"count(*) AS products, sum(quantity)::BIGINT AS units, {r1(_cost)} AS cost, {r1(_retail)} AS retail, {mean('margin')} AS avg_margin, {r1(f'{_retail} - {_cost}')} AS profit"
KEY = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
SLUG = lambda c: f"left(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 120)"
SKU_KEY = f"nullif(replace({KEY('sku')}, ' ', ''), '')"
FINGERPRINT = f"CASE WHEN {SKU_KEY} IS NOT NULL THEN 'sku:' || {SKU_KEY} ELSE 'nm:' || coalesce(nullif({KEY('brand')}, ''), 'nobrand') || '|' || {KEY('name')} END"
PUBLISHED = "is_active AND NOT is_draft AND selling_price > 0 AND is_verified"
SHOWN = "coalesce(norm_selling_price, selling_price)"


def top(columns: str, where: str, by: str) -> str:
    unit, every = "(norm_selling_price - norm_rdp)", "(norm_selling_price - norm_rdp) * coalesce(quantity, 0)"
    return f"{VIEW} SELECT id, name, brand, margin, quantity, round_even({unit}, 2) AS unit_profit, round_even({every}, 2) AS total_profit FROM products WHERE is_active AND norm_rdp > 0 AND norm_selling_price > 0 {where} ORDER BY {by}_profit DESC, id LIMIT 20"


PUBLIC = f""", pub AS (SELECT id, {SLUG("name || ' ' || id")} AS slug, name, brand, category, sku, {SHOWN} AS shown_price, CASE WHEN norm_selling_price IS NOT NULL THEN 'EGP' ELSE currency END AS shown_currency,
  quantity - reserved > 0 AS in_stock, has_image, score, updated, quantity AS own_quantity FROM scored WHERE {PUBLISHED})"""
_ladder = (
    ("selling_price IS NULL AND rdp IS NULL", "no_price", "ask the supplier for a quote"), ("selling_price IS NULL", "no_selling_price", "set a selling price"), ("currency IS NULL", "no_currency", "find out the currency"),
    ("sku IS NULL", "no_sku", "find the model code"), ("NOT has_image", "no_image", "take photos"), ("NOT is_verified", "not_verified", "review and verify"),
)
BLOCKER = "CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b, _ in _ladder) + " ELSE 'none' END"
ACTION = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, _, a in _ladder) + " ELSE 'nothing to do' END"
CLEAN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
CODE3 = lambda c: f"rpad(upper(left(regexp_replace({KEY(c)}, '[^a-z0-9]', '', 'g'), 3)), 3, 'X')"
MONEY = """WITH b AS (SELECT p_partkey AS id, p_partkey % 7 AS k, floor(p_retailprice) AS p, p_size::DOUBLE AS z FROM part),
v AS (SELECT id, k, CASE k WHEN 0 THEN p + 25 WHEN 3 THEN NULL WHEN 4 THEN -z WHEN 5 THEN 1000 + z + 0.5 ELSE p END::DOUBLE AS value, p FROM b)
SELECT id, value, CASE WHEN k = 0 THEN p ELSE value END::DOUBLE AS "min", CASE WHEN k = 0 THEN p + 50 ELSE value END::DOUBLE AS "max", k = 0 AS is_range, k IN (0, 2) AS is_estimated, CASE k WHEN 1 THEN 'USD' WHEN 2 THEN 'EGP' END AS currency, k <> 3 AS ok FROM v"""
GRID = """g AS (SELECT 'sheet-' || (p_partkey % 5) AS sheet, (p_partkey + 10)::INT AS row_index, CASE WHEN (p_partkey // 5) % 20 = 0 THEN 'section' WHEN (p_partkey // 5) % 20 = 19 THEN 'total' ELSE 'data' END AS kind,
  'Section ' || (p_partkey // 100) AS txt, p_partkey, p_name, p_brand, p_retailprice, p_size FROM part
  UNION ALL SELECT 'sheet-' || r, i, CASE WHEN i = 1 THEN 'title' ELSE 'header' END, NULL, NULL, NULL, NULL, NULL, NULL FROM range(5) t(r), (VALUES (1), (2)) n(i))"""
UPSERT = """WITH u AS (SELECT 'sku:p' || p_partkey AS fingerprint, p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 2 = 0 AND NOT (p_partkey % 10 <> 0 AND p_partkey % 7 = 0) THEN p_retailprice + 1 ELSE p_retailprice END AS rdp,
  p_size::BIGINT AS quantity, p_partkey % 10 <> 0 AND p_partkey % 3 = 0 AS is_verified, TRUE AS is_active, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 = 0 THEN 'approved' ELSE 'review' END AS lifecycle,
  CASE WHEN p_partkey % 10 = 0 THEN 'created' WHEN p_partkey % 8 = 0 THEN 'kept' WHEN p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 'updated' ELSE 'unchanged' END AS outcome,
  CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 8 <> 0 THEN (CASE WHEN p_partkey % 7 = 0 AND p_partkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS locks_kept
  FROM part WHERE p_partkey % 10 <> 0 OR p_partkey % 8 <> 0)"""
ORACLES: dict[str, str] = {
    "summary": f"{SCORED} SELECT {MEASURES}, {mean('gross_margin')} AS avg_gross_margin, {mean('score')} AS avg_score, count(*) FILTER (is_verified) AS verified, count(*) FILTER (is_generic) AS generic, count(*) FILTER (selling_price > 0) AS priced FROM scored WHERE is_active",
    **{f"inventory_by_{d}": f"{VIEW} SELECT coalesce({c}, '(unassigned)') AS \"group\", {MEASURES} FROM products WHERE is_active GROUP BY 1" for d, c in DIMENSIONS.items()},
    "top_profitable_total": top("", "", "total"), "top_profitable_unit": top("", "", "unit"), "top_profitable_min_margin": top("", "AND margin >= 40", "total"),
    "margin_bands": f"{VIEW} SELECT band, count(*) AS products, {mean('margin')} AS avg_margin, {r1(_cost)} AS cost FROM products WHERE is_active AND margin IS NOT NULL GROUP BY band",
    "low_margin_alerts": f"{VIEW} SELECT id, name, margin, band, round_even(coalesce(norm_rdp, 0) * coalesce(quantity, 0), 2) AS exposure FROM products WHERE is_active AND margin < 25",
    "supplier_breakdown": f"{SCORED} SELECT coalesce(supplier, '(unknown)') AS supplier, count(*) AS products, sum(quantity)::BIGINT AS units, {r1(_cost)} AS spend, {mean('margin')} AS avg_margin, {mean('score')} AS avg_score, count(*) FILTER (procurement = 'must_buy') AS must_buy, count(*) FILTER (procurement = 'avoid') AS avoid FROM scored WHERE is_active GROUP BY 1",
    "procurement_baskets": f"{VIEW} SELECT procurement, {MEASURES} FROM products GROUP BY procurement",
    "committed_total": f"{VIEW}, b AS (SELECT procurement, {MEASURES} FROM products GROUP BY procurement) SELECT sum(products)::BIGINT AS products, sum(units)::BIGINT AS units, {r1(total('cost'))} AS committed FROM b WHERE procurement IN ('must_buy', 'test_buy')",
    "pricing_alerts": f"{VIEW} SELECT id, name, brand, sku, rdp, selling_price, margin, band, {r1('coalesce(norm_rdp, 0) * coalesce(quantity, 0)')} AS exposure, CASE WHEN rdp > 0 THEN {r1('rdp * (1 + 25::DOUBLE / 100)')} END AS suggested_price FROM products WHERE is_active AND margin IS NOT NULL AND band IN ('loss', 'critical', 'low', 'implausible')",
    "loss_makers": f"{VIEW}, l AS (SELECT *, {r1('rdp - coalesce(selling_price, 0)')} AS loss_per_unit FROM products WHERE is_active AND rdp > 0 AND (selling_price IS NULL OR selling_price < rdp)) SELECT id, name, rdp, selling_price, quantity, loss_per_unit, {r1('loss_per_unit * quantity')} AS exposure, selling_price IS NULL AS is_unpriced FROM l",
    "price_suggestions": f"{VIEW}, l AS (SELECT *, {r1('rdp * (1 + 54::DOUBLE / 100)')} AS suggested_price FROM products WHERE rdp > 0) SELECT id, rdp, selling_price, margin, 54::DOUBLE AS target_margin, suggested_price, {r1('suggested_price - selling_price')} AS delta, suggested_price > market_high AS exceeds_market_high, 'target' AS target_band FROM l",
    "fx_normalized": f"{VIEW} SELECT id, currency, fx_rate, norm_rdp, norm_rrp, norm_selling_price, margin, gross_margin, margin_value, band FROM products",
    "recalculate_counts": f"{VIEW} SELECT count(*) AS scanned, count(*) FILTER (id % 5 = 0 AND margin IS NOT NULL) AS changed, {total('margin')} AS margin_total FROM products",
    "quality_overview": f"{SCORED} SELECT count(*) AS products, nullif({r1('avg(score)', 1)}, 0) AS avg_score, nullif({r1('avg(completeness)', 1)}, 0) AS avg_completeness, count(*) FILTER (is_verified) AS verified, count(*) FILTER (is_generic) AS generic, count(*) FILTER (is_draft) AS draft, count(*) FILTER (score >= 70) AS publishable, count(*) FILTER (array_to_string(issues, ',') <> '') AS with_issues FROM scored",
    "issues_by_code": f"{SCORED} SELECT code, count(*) AS n, {_severity} AS severity FROM (SELECT unnest(issues) AS code FROM scored) WHERE code IS NOT NULL GROUP BY code",
    "issues_by_severity": f"{SCORED} SELECT {_severity} AS severity, count(*) AS n FROM (SELECT unnest(issues) AS code FROM scored) WHERE code IS NOT NULL GROUP BY 1",
    "score_distribution": f"{SCORED} SELECT grade, count(*) AS n FROM scored GROUP BY grade",
    "completeness": f"{SCORED} SELECT id, {', '.join(f'earned_{g}' for g in COMPLETENESS)}, completeness, penalties, score, grade, n_critical, n_high, n_medium, n_low, n_info, is_blocked, coalesce(array_to_string(issues, ','), '') AS issue_codes, missing_fields FROM scored",
    "worst_products": f"{SCORED} SELECT id, name, score, (n_critical + n_high + n_medium + n_low + n_info)::BIGINT AS n_issues FROM scored ORDER BY score, id LIMIT 25",
    "worst_high_severity": f"{SCORED} SELECT id, name, score, (n_critical + n_high + n_medium + n_low + n_info)::BIGINT AS n_issues FROM scored WHERE n_high > 0 ORDER BY score, id LIMIT 25",
    "duplicate_skus": f"{VIEW} SELECT sku_key, count(*) AS n, count(DISTINCT name_key) AS n_names, min(id) AS first_id, CASE WHEN count(DISTINCT name_key) > 1 THEN 'conflict' ELSE 'duplicate' END AS kind, CASE WHEN count(DISTINCT name_key) > 1 THEN 'critical' ELSE 'high' END AS severity FROM (SELECT {SKU_KEY} AS sku_key, {KEY('name')} AS name_key, id FROM products) WHERE sku_key IS NOT NULL GROUP BY sku_key HAVING count(*) > 1",
    "sku_collisions": f"{VIEW} SELECT * FROM (SELECT id, name, source_catalog, sku_key, count(*) OVER (PARTITION BY sku_key) AS n, count(*) OVER (PARTITION BY sku_key) - 1 AS n_others FROM (SELECT *, {SKU_KEY} AS sku_key FROM products) WHERE sku_key IS NOT NULL) WHERE n > 1",
    "near_duplicates": f"""{VIEW}, k AS (SELECT {KEY('brand')} AS b, {KEY('name')} AS x, count(*) AS n, min(id) AS id FROM products WHERE is_active GROUP BY ALL),
pr AS (SELECT a.b AS brand_key, a.x AS name_a, c.x AS name_b, a.id AS id_a, c.id AS id_b, a.n AS n_a, c.n AS n_b, 1 - levenshtein(a.x, c.x)::DOUBLE / greatest(length(a.x), length(c.x)) AS e,
  len(list_intersect(list_distinct(string_split(a.x, ' ')), list_distinct(string_split(c.x, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(a.x, ' '), string_split(c.x, ' ')))) AS j FROM k a JOIN k c ON a.b = c.b AND a.x < c.x)
SELECT brand_key, name_a, name_b, id_a, id_b, n_a, n_b, round(greatest(0.4::DOUBLE * j + 0.6::DOUBLE * e, CASE WHEN length(name_a) >= 6 AND length(name_b) >= 6 THEN 0.95::DOUBLE * e ELSE 0 END), 3) AS similarity FROM pr WHERE round(greatest(0.4::DOUBLE * j + 0.6::DOUBLE * e, CASE WHEN length(name_a) >= 6 AND length(name_b) >= 6 THEN 0.95::DOUBLE * e ELSE 0 END), 3) >= 0.7""",
    "rescore_counts": f"{SCORED}, o AS (SELECT score, CASE WHEN id % 4 = 0 THEN score - 1 WHEN id % 4 = 1 THEN score + 1 ELSE score END AS was FROM scored) SELECT count(*) AS scanned, count(*) FILTER (score <> was) AS changed, count(*) FILTER (score > was) AS improved, count(*) FILTER (score < was) AS degraded FROM o",
    "admin_list_filtered": f"{SCORED} SELECT id, name, margin, quantity, procurement FROM scored WHERE procurement IN ('must_buy', 'test_buy') AND is_active AND margin >= 10 AND quantity <= 40 AND coalesce(array_to_string(issues, ','), '') <> ''",
    "admin_search": f"{VIEW} SELECT id, sku FROM products WHERE list_contains(string_split({KEY("concat_ws(' ', name, brand, sku)")}, ' '), 'p') OR list_contains(string_split({KEY("concat_ws(' ', name, brand, sku)")}, ' '), '77')",
    "admin_list_sorted_page": f"{VIEW} SELECT id, name, margin FROM products ORDER BY margin DESC NULLS LAST, name, id LIMIT 25 OFFSET 25",
    "issue_code_filter": f"{SCORED} SELECT id, name FROM scored WHERE coalesce(rdp, 0) = 0 AND n_high > 0",
    "public_list": f"{SCORED} {PUBLIC} SELECT * EXCLUDE (own_quantity) FROM pub ORDER BY score DESC, updated DESC, id LIMIT 60",
    "public_search": f"{SCORED} {PUBLIC} SELECT * EXCLUDE (own_quantity) FROM pub WHERE contains(lower(name), 'p-7') OR contains(lower(brand), 'p-7') OR contains(lower(sku), 'p-7')",
    "public_price_range": f"{SCORED} {PUBLIC} SELECT * EXCLUDE (own_quantity) FROM pub WHERE shown_price BETWEEN 1000 AND 20000 AND own_quantity > 0",
    "public_detail": f"{SCORED} {PUBLIC} SELECT * EXCLUDE (own_quantity) FROM pub WHERE id = 3",
    "facet_categories": f"{VIEW} SELECT category AS value, count(*) AS n FROM products WHERE {PUBLISHED} AND category IS NOT NULL GROUP BY 1",
    "facet_brands": f"{VIEW} SELECT brand AS value, count(*) AS n FROM products WHERE {PUBLISHED} AND brand IS NOT NULL GROUP BY 1",
    "facet_price_range": f"{VIEW} SELECT floor(min(norm_selling_price))::BIGINT AS low, ceil(max(norm_selling_price))::BIGINT AS high, count(*) AS n FROM products WHERE {PUBLISHED} AND norm_selling_price > 0",
    "sitemap": f"{SCORED} {PUBLIC} SELECT slug, updated FROM pub",
    "related_products": f"{SCORED} {PUBLIC}, named AS (SELECT id AS rid, category AS rc, score AS rs FROM pub WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, id) <= 5) SELECT id, (row_number() OVER (PARTITION BY id ORDER BY rs DESC, rid) - 1)::INT AS rank, rid AS related_id FROM pub JOIN named ON category = rc AND id <> rid QUALIFY row_number() OVER (PARTITION BY id ORDER BY rs DESC, rid) <= 4",
    "publish_candidates": f"{SCORED} SELECT id, name, category, CASE WHEN is_blocked THEN 'blocked' ELSE 'ready' END AS state FROM scored WHERE is_active AND NOT is_draft AND selling_price > 0 AND NOT is_verified",
    "publish_blocked_by_issue": f"{SCORED} SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM scored WHERE is_active AND NOT is_draft AND selling_price > 0 AND NOT is_verified AND is_blocked) WHERE {_severity} = 'critical' GROUP BY code",
    "backfill_missing": f"{VIEW} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS missing FROM products" for c in ("brand", "category", "sku", "currency", "rdp", "rrp", "selling_price")),
    "missing_report": f"{VIEW} SELECT id, name, category, {BLOCKER} AS blocker, {ACTION} AS action FROM products WHERE NOT (is_active AND is_verified AND coalesce(selling_price, 0) > 0)",
    "blocker_counts": f"{VIEW} SELECT {BLOCKER} AS blocker, count(*) AS n FROM products WHERE NOT (is_active AND is_verified AND coalesce(selling_price, 0) > 0) GROUP BY 1",
    "open_questions": f"{SCORED} SELECT id, 'conflict' AS kind, code AS what FROM (SELECT id, unnest(issues) AS code FROM scored) WHERE code IN ('COST_MISMATCH', 'AMBIGUOUS_SKU', 'MARKET_BELOW_COST') UNION ALL SELECT id, 'gap', unnest(string_split(missing_fields, ',')) FROM scored WHERE missing_fields <> ''",
    "category_counts": f"{VIEW} SELECT coalesce(category, '(none)') AS category, count(*) AS n FROM products GROUP BY 1",
    "normalize_key": f"SELECT doc_id, md5({KEY('text')}) AS key_md5 FROM documents",
    "slugify": f"SELECT doc_id, {SLUG(CLEAN)} AS slug FROM documents",
    "fingerprint": f"{VIEW} SELECT id, {FINGERPRINT} AS fingerprint FROM products",
    "similarity_pairs": f"WITH k AS (SELECT p_partkey AS id, {KEY('p_name')} AS x, {KEY("p_name || ' ' || p_brand")} AS y FROM part), m AS (SELECT *, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS e, len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) AS j FROM k) SELECT id, round(greatest(0.4::DOUBLE * j + 0.6::DOUBLE * e, CASE WHEN length(x) >= 6 AND length(y) >= 6 THEN 0.95::DOUBLE * e ELSE 0 END), 3) AS similarity FROM m",
    "generate_sku": f"SELECT p_partkey AS id, 'BH-' || {CODE3('p_type')} || '-' || {CODE3('p_brand')} || '-' || upper(left(sha1({KEY('p_brand')} || '|' || {KEY('p_name')} || '|'), 6)) AS sku FROM part",
    "parse_money": MONEY, "parse_percent": f"SELECT p_partkey AS id, {r1('CASE WHEN p_partkey % 3 = 0 THEN p_size + 0.5::DOUBLE WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE / 100 * 100 WHEN p_size <= 1 THEN p_size * 100::DOUBLE ELSE p_size END')} AS percent FROM part",
    "parse_integer": "SELECT p_partkey AS id, 1000 + p_size::BIGINT AS quantity FROM part",
    "extract_wattage": "SELECT p_partkey AS id, p_size::DOUBLE AS wattage FROM part", "extract_length": f"SELECT p_partkey AS id, {r1('p_size * 0.01::DOUBLE', 3)} AS length_m FROM part",
    "extract_capacity": "SELECT p_partkey AS id, p_size || 'GB' AS capacity, p_size::DOUBLE AS capacity_gb FROM part", "extract_warranty": "SELECT p_partkey AS id, 12 * (p_partkey % 5 + 1) AS months FROM part",
    "extract_condition": "SELECT p_partkey AS id, ['new','refurbished','used','original_pull'][p_partkey % 4 + 1] AS condition FROM part",
    "split_features": "SELECT p_partkey AS id, p_name || '#' || p_size || ' ports#' || p_brand AS features FROM part",
    "normalize_brand": "SELECT p_partkey AS id, p_brand AS brand, FALSE AS is_generic, FALSE AS is_multi FROM part",
    "normalize_category": "SELECT p_partkey AS id, 'Cables' AS category, 'Charging Cables' AS subcategory, TRUE AS matched FROM part",
    "detect_generic": f"SELECT p_partkey AS id, regexp_matches({KEY('p_name')}, '(^| )(general|generic|assorted|various|misc|miscellaneous|placeholder|sample|example|unassigned|tbd|tba|unknown|any|standard type)( |$)') OR (length(p_name) > 3 AND p_name = upper(p_name) AND regexp_matches(p_name, '[A-Z]') AND NOT regexp_matches(p_name, '[0-9]')) AS is_generic, FALSE AS is_draft FROM part",
    "header_detect": "SELECT 'sheet-' || r AS sheet, 2 AS header_index FROM range(5) t(r)",
    "column_claims": "SELECT 'sheet-' || r AS sheet, c.* FROM range(4) t(r), (VALUES (0::BIGINT, 'Product', 'name', NULL), (1, 'Brand', 'brand', NULL), (2, 'SKU', 'sku', NULL), (3, 'Price (EGP)', 'selling_price', 'EGP'), (4, 'Qty', 'quantity', NULL)) c(col, header, field, currency) UNION ALL SELECT 'sheet-4', c.* FROM (VALUES (0::BIGINT, 'Product', 'name', NULL), (1, 'Brand', 'brand', NULL), (2, 'Model', 'sku', NULL), (3, 'RDP (USD)', 'rdp', 'USD'), (4, 'RRP ($)', 'rrp', 'USD')) c(col, header, field, currency)",
    "sheet_currency_vote": "SELECT 'sheet-' || r AS sheet, CASE WHEN r = 4 THEN 'USD' ELSE 'EGP' END AS currency FROM range(5) t(r)",
    "section_fill_forward": f"WITH {GRID} SELECT sheet, row_index, kind, last_value(CASE WHEN kind = 'section' THEN txt END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_index ROWS UNBOUNDED PRECEDING) AS section FROM g",
    "import_products": f"WITH {GRID} SELECT sheet, row_index, p_name AS name, p_brand AS brand, 'P-' || p_partkey AS sku, CASE WHEN sheet = 'sheet-4' THEN 'USD' ELSE 'EGP' END AS currency, CASE WHEN sheet = 'sheet-4' THEN floor(p_retailprice) END AS rdp, CASE WHEN sheet = 'sheet-4' THEN p_size::DOUBLE END AS rrp, CASE WHEN sheet = 'sheet-4' THEN p_size::DOUBLE ELSE floor(p_retailprice) END AS selling_price, CASE WHEN sheet <> 'sheet-4' THEN p_size::BIGINT END AS quantity FROM g WHERE kind = 'data'",
    "upsert_locked": f"{UPSERT} SELECT fingerprint, id, name, rdp, quantity, is_verified, is_active, lifecycle, outcome, locks_kept FROM u",
    "import_totals": f"{UPSERT} SELECT 'parts' AS source, count(*) AS rows, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'kept') AS kept, sum(locks_kept)::BIGINT AS locks_kept FROM u",
    "archive_stale": "SELECT 'sku:p' || p_partkey AS fingerprint, p_partkey % 8 <> 0 AS is_active, p_partkey % 3 = 0 AND p_partkey % 8 <> 0 AS is_verified, CASE WHEN p_partkey % 8 = 0 THEN 'archived' WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'review' END AS lifecycle, p_partkey % 8 = 0 AS archived FROM part WHERE p_partkey % 10 <> 0",
    "resolve_slugs": f"""WITH d AS (SELECT 'sku:p' || p_partkey AS fingerprint, p_partkey AS k, {SLUG("p_name || ' ' || p_brand")} AS wanted, {SLUG("p_name || ' ' || p_brand || ' P-' || (p_partkey % 3)")} AS base FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY k) = 1 AS keeps FROM d), l AS (SELECT *, row_number() OVER (PARTITION BY base, keeps ORDER BY k) AS n FROM c)
SELECT fingerprint, wanted, CASE WHEN keeps THEN wanted WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM l""",
    "patch_fields": "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 1.5 ELSE p_retailprice END AS rdp, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 4 = 0 THEN 'rdp' ELSE '' END AS locks, CASE WHEN p_partkey % 4 = 0 THEN 'rdp' ELSE '' END AS changed FROM part WHERE p_partkey % 10 <> 0",
    "patch_outcomes": "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN 'name' WHEN 2 THEN 'score' ELSE 'rdp' END AS field, CASE WHEN p_partkey % 10 = 0 OR p_partkey % 4 >= 2 THEN 'failed' WHEN p_partkey % 4 = 1 THEN 'unchanged' ELSE 'updated' END AS outcome FROM part",
    "unlock_fields": "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'rdp' ELSE '' END AS unlocked, 0::BIGINT AS n_locked FROM part WHERE p_partkey % 10 <> 0",
    "create_products": "SELECT 'sku:p' || p_partkey AS fingerprint, p_name AS name, p_retailprice AS rdp, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'review' END AS lifecycle, p_partkey % 3 = 0 AS is_verified, CASE WHEN p_partkey % 7 = 0 THEN 'rdp' ELSE '' END AS locks, 'kept' AS outcome FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'sku:p' || p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END, 'draft', FALSE, CASE WHEN p_partkey % 3 = 0 THEN 'name,rdp' ELSE 'name' END, CASE WHEN p_partkey % 10 = 0 THEN 'created' ELSE 'conflict' END FROM part WHERE p_partkey % 5 = 0",
    "verify_products": f"{SCORED} SELECT id, NOT is_blocked AS is_verified, CASE WHEN is_blocked THEN 'review' ELSE 'approved' END AS lifecycle, is_blocked AS refused FROM scored",
    "dedupe_merge": "SELECT lower(p_name) AS fingerprint, max(p_partkey % 7)::DOUBLE AS score, arg_min(p_partkey, -(p_partkey % 7) * 1000000000 + p_partkey) AS row_index, arg_min(p_brand, -(p_partkey % 7) * 1000000000 + p_partkey) FILTER (p_partkey % 3 = 0) AS brand, arg_min(p_retailprice, -(p_partkey % 7) * 1000000000 + p_partkey) FILTER (p_partkey % 2 = 0) AS rdp, count(*) AS n_sources FROM part GROUP BY 1",
    "market_segments": f"SELECT r_name, c_mktsegment, count(*) AS orders, {r1(total('o_totalprice'))} AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
}
