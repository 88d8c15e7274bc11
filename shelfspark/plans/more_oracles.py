"""DuckDB SQL for the named queries of `more`."""

from __future__ import annotations

from shelfspark.config import ISSUES, SEVERITIES
from shelfspark.plans.oracles import KEY, PUBLIC, SCORED, SKU_KEY, SLUG, VIEW, _severity, r1

_priced = VIEW[VIEW.index("products AS (") :]
_scoring = SCORED[len(VIEW) :]

ENTRIES = """e AS (SELECT 'Cables/' || p_name || ' No. ' || p_partkey AS folder, CASE WHEN p_partkey % 3 <> 0 THEN 'M-' || p_partkey END AS own_sku, p_partkey % 4 = 0 AS has_evidence, p_name AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand,
  p_type AS category, p_partkey % 2 = 0 AS has_price, p_retailprice, p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 THEN ['two sources give other costs'] ELSE [] END AS conflicts,
  CASE p_partkey % 9 WHEN 0 THEN ['Not approved for sale'] WHEN 1 THEN ['No agreed sell price'] WHEN 2 THEN ['Photos belong to another unit'] WHEN 3 THEN ['Unbranded placeholder'] WHEN 4 THEN ['No model code confirmed']
    WHEN 5 THEN ['Model DISPUTED'] WHEN 6 THEN ['price missing'] WHEN 7 THEN [] ELSE ['length unknown', 'price missing'] END AS gaps FROM part WHERE p_partkey % 4 <> 3)"""
_words = "string_split(trim(regexp_replace(folder, '[^A-Za-z0-9]+', ' ', 'g')), ' ')"
DRAFTS = f"""WITH {ENTRIES}, raw AS (SELECT *, coalesce(own_sku, 'BH-' || left(upper(array_to_string({_words}[-3:], '-')), 20) || '-' || upper(left(sha1(folder), 4))) AS sku, own_sku IS NULL AS sku_generated, 'EGP' AS currency,
  CASE WHEN has_price THEN p_retailprice - 100 END AS rdp, NULL::DOUBLE AS rrp, CASE WHEN has_price THEN p_retailprice END AS selling_price, CASE WHEN p_partkey % 6 <> 0 THEN p_size ELSE 0 END::BIGINT AS quantity, brand AS supplier,
  TRUE AS is_active, p_partkey % 11 = 0 AS is_generic, FALSE AS is_draft, FALSE AS is_verified, CASE WHEN p_partkey % 7 = 1 THEN 'must_buy' ELSE 'unclassified' END AS procurement, 'unknown' AS condition, p_partkey % 8 = 0 AS has_specs, FALSE AS has_image,
  FALSE AS has_description, NULL::DOUBLE AS market_high, FALSE AS is_estimated, FALSE AS is_range, FALSE AS category_unmapped, FALSE AS cost_mismatch, FALSE AS sku_ambiguous, FALSE AS sku_corrected, p_partkey AS id,
  list_concat(list_concat(CASE WHEN has_evidence THEN ['SKU evidence: label'] ELSE [] END, CASE WHEN has_price THEN ['Price source: quote ' || p_partkey] ELSE [] END), list_concat(conflicts, gaps)) AS notes FROM e), p0 AS (SELECT * FROM raw), {_priced}{_scoring},
draft AS (SELECT * REPLACE (list_concat(list_filter(issues, lambda c: c IS NOT NULL), list_concat(list_transform(conflicts, lambda c: 'SOURCE_CONFLICT'), list_transform(gaps, lambda c: 'INCOMPLETE_SOURCE_DATA'))) AS issues,
  greatest(0::DOUBLE, least(100::DOUBLE, {r1("completeness - penalties - CASE WHEN len(conflicts) > 0 THEN 8 ELSE 0 END", 1)})) AS score) FROM scored)"""
OPEN = f"WITH {ENTRIES}, q AS (SELECT folder, name, 'conflict' AS kind, unnest(conflicts) AS text FROM e UNION ALL SELECT folder, name, 'gap', unnest(gaps) FROM e)"
_said = "array_to_string(gaps, ' ')"
_ladder = (
    ("not approved for sale", "Not approved for sale", "Decide whether to stock it despite the thin margin. If yes, agree a sell price and it lists like any other."),
    ("no agreed sell price", "No agreed sell price", "Agree a sell price. The list price is that plus 45 EGP shipping — the workbook quotes only a reference RRP, which is not a price we can charge."),
    ("photos belong to", "Wrong photos, no price", "Photograph the actual unit, confirm the model code, then get a supplier quote. The photos here are of a different product."),
    ("unbranded placeholder", "Unidentified product", "Say what this actually is — brand, model, length or wattage — then get a supplier quote. Nothing about it is known beyond the photo."),
    ("no model code confirmed|unresolved|disputed|different model", "Model code unconfirmed, no price", "Confirm which model this is, then get a supplier quote for that exact code."),
)
_pick = lambda at, other: "CASE " + " ".join(f"WHEN regexp_matches(lower({_said}), '{b[0]}') THEN '{b[at]}'" for b in _ladder) + f" ELSE '{other}' END"

PHOTO_NAME = "p_name || CASE WHEN p_partkey % 5 = 0 THEN ' P-' ELSE ' ' END || p_partkey"
FOLDERS = f"f AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Cables' ELSE 'Other' END || '/' || {PHOTO_NAME} AS folder, {PHOTO_NAME} AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Cables' END AS category, NULL::VARCHAR AS subcategory, 3::BIGINT AS n_images, p_partkey AS fid FROM part WHERE p_partkey % 3 = 0)"
OWNERS = "p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'item ' || p_partkey ELSE p_name || ' ' || p_partkey END AS name, 'P-' || p_partkey AS sku, CASE WHEN p_partkey % 4 = 0 THEN 'Cables' ELSE p_type END AS category, CASE WHEN p_partkey % 14 = 0 THEN 'Cables/' || p_name || ' ' || (p_partkey + 4) END AS image_source FROM part WHERE p_partkey % 2 = 0)"
_set = lambda c: f"list_distinct(string_split({c}, ' '))"


def alike(x: str, y: str) -> str:
    both = f"len(list_intersect({_set(x)}, {_set(y)}))::DOUBLE"
    edit = f"(1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})))"
    blend = f"0.4::DOUBLE * ({both} / (len({_set(x)}) + len({_set(y)}) - {both})) + 0.6::DOUBLE * {edit}"
    return f"CASE WHEN {x} = {y} THEN 1 ELSE greatest({blend}, CASE WHEN length({x}) >= 6 AND length({y}) >= 6 THEN 0.95::DOUBLE * {edit} ELSE 0 END) END"


_short, _long = (f"CASE WHEN length(fk) <= length(pk) THEN {a} ELSE {b} END" for a, b in (("fk", "pk"), ("pk", "fk")))
_worded = f"""JOIN pk ON len(list_intersect({_set("fk")}, {_set("pk || ' ' || sk")})) > 0"""
SCORES = f"""{FOLDERS}, {OWNERS}, fk AS (SELECT *, {KEY("title")} AS fk FROM f), pk AS (SELECT id, category AS pc, {KEY("name")} AS pk, {KEY("sku")} AS sk FROM p),
c AS (SELECT folder, id, greatest({alike("fk", "pk")}, {alike("fk", "sk")}, CASE WHEN length(sk) >= 4 AND contains(fk, sk) THEN 0.95 ELSE 0 END, CASE WHEN len(list_filter({_set(_short)}, lambda w: NOT list_contains({_set(_long)}, w))) = 0 THEN 0.78 ELSE 0 END)
  + CASE WHEN category = pc THEN 0.08 ELSE 0 END AS s FROM fk {_worded}),
scores AS MATERIALIZED (SELECT folder, id, round(greatest(0::DOUBLE, least(1::DOUBLE, s)), 3) AS score FROM c WHERE round(least(1::DOUBLE, s), 3) >= 0.7)"""
#: The same for every pair, with a common word or without.
EVERY = SCORES.replace(_worded, "CROSS JOIN pk")
#: Greedy links, a pair a step in the order score, folder, id.
_links = lambda scores: f"""WITH RECURSIVE {scores}, o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, folder, id) AS n FROM scores),
g(n, folder, id, score, used_f, used_i) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE, []::VARCHAR[], []::BIGINT[]
  UNION ALL SELECT x.n, x.folder, x.id, x.score, list_append(g.used_f, x.folder), list_append(g.used_i, x.id) FROM g, LATERAL (SELECT * FROM o WHERE o.n > g.n AND NOT list_contains(g.used_f, o.folder) AND NOT list_contains(g.used_i, o.id) ORDER BY o.n LIMIT 1) AS x
), links AS (SELECT folder, id, score FROM g WHERE n > 0)"""  # noqa: E731
LINKS, LINKS_OF_EVERY = _links(SCORES), _links(EVERY)
SPECS = """m AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 50 <> 0 THEN p_type END AS category, p_size::VARCHAR AS z, p_partkey AS k FROM part),
all_specs AS (SELECT id, z, k, unnest(['power_wattage', 'battery_capacity', 'capacity', 'capacity_gb', 'condition', 'interface', 'color', 'warranty_months', 'features', 'screen_size']) AS name FROM m),
specs AS (SELECT id, name, CASE name WHEN 'power_wattage' THEN CASE WHEN k % 2 = 0 THEN z END WHEN 'capacity' THEN CASE WHEN k % 3 = 0 THEN z || 'GB' END WHEN 'capacity_gb' THEN CASE WHEN k % 5 = 0 THEN z END
  WHEN 'condition' THEN [NULL, 'Original pull', 'New'][k % 3 + 1] WHEN 'color' THEN CASE WHEN k % 7 = 0 THEN 'Black' END WHEN 'warranty_months' THEN CASE WHEN k % 4 = 0 THEN z END WHEN 'features' THEN CASE WHEN k % 8 = 0 THEN 'fast|small' END
  WHEN 'screen_size' THEN CASE WHEN k % 9 = 0 THEN '6 in' END END AS value FROM all_specs),
rows AS (SELECT s.id, s.name, t.label, s.value || t.unit AS value, t.o FROM specs s JOIN (VALUES ('power_wattage', 'Power output', ' W', 1), ('capacity', 'Capacity', '', 3), ('capacity_gb', 'Capacity', ' GB', 4), ('color', 'Colour', '', 9), ('condition', 'Condition', '', 10), ('warranty_months', 'Warranty', ' months', 11), ('screen_size', 'Screen size', '', 20)) AS t(name, label, unit, o) ON s.name = t.name
  WHERE s.value IS NOT NULL AND NOT (s.name = 'capacity_gb' AND s.id % 3 = 0))"""
_place = "(row_number() OVER (PARTITION BY id ORDER BY o) - 1)::INT AS place"
_rank = "list_position([" + ", ".join(f"'{s}'" for s in SEVERITIES) + f"], {_severity})"
_queue = {
    "MISSING_COST": ("rdp", "Wholesale cost", "money"), "MISSING_SELLING_PRICE": ("selling_price", "Selling price", "money"), "MISSING_CURRENCY": ("currency", "Currency", "currency"), "MISSING_QUANTITY": ("quantity", "Quantity", "integer"),
    "MISSING_SUPPLIER": ("supplier", "Supplier", "text"), "MISSING_BRAND": ("brand", "Brand", "text"), "MISSING_CATEGORY": ("category", "Category", "text"), "PRICE_RANGE_ONLY": ("selling_price", "Exact selling price", "money"),
    "ESTIMATED_PRICE": ("selling_price", "Confirmed selling price", "money"), "SELLING_BELOW_COST": ("selling_price", "Selling price", "money"), "MISSING_SPECS": ("capacity", "Capacity / spec", "text"),
}
_of = lambda at: "CASE code " + " ".join(f"WHEN '{k}' THEN '{v[at]}'" for k, v in _queue.items()) + " END"
_decide = "('DUPLICATE_SKU', 'AMBIGUOUS_SKU', 'DUPLICATE_PRODUCT', 'COST_MISMATCH', 'MARKET_BELOW_COST', 'IMPLAUSIBLE_MARGIN', 'GENERIC_ITEM', 'DRAFT_ITEM')"
CODES = f"{SCORED}, codes AS (SELECT id, unnest(list_filter(issues, lambda c: c IS NOT NULL)) AS code FROM scored)"
GRID_ROWS = """g AS (SELECT 'sheet-' || (p_partkey % 5) AS sheet, (p_partkey + 10)::INT AS row_index, CASE WHEN (p_partkey // 5) % 20 = 0 THEN 'section' WHEN (p_partkey // 5) % 20 = 19 THEN 'total' ELSE 'data' END AS kind,
  CASE WHEN (p_partkey // 5) % 20 = 0 THEN 'Section ' || (p_partkey // 100) WHEN (p_partkey // 5) % 20 = 19 THEN 'Total | 100' END AS text FROM part
  UNION ALL SELECT 'sheet-' || r, i, CASE WHEN i = 1 THEN 'title' ELSE 'header' END, CASE WHEN i = 1 THEN 'Price list of the season' END FROM range(5) t(r), (VALUES (1), (2)) n(i))"""
REPORT = f"WITH {GRID_ROWS}, r AS (SELECT sheet, count(*) AS rows_read, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("data", "section", "title", "total")) + ", NULL::VARCHAR AS skipped FROM g GROUP BY sheet)"


def patched(name: str, changed: str) -> str:
    """The product view after the last edit of each field, scored anew."""
    view = VIEW.replace("p0 AS (SELECT *, coalesce(asked, rrp) AS selling_price FROM raw)", f"p0 AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 10 ELSE rdp END AS rdp, {name} AS name), coalesce(asked, rrp) AS selling_price FROM raw)")
    return f"{view}{_scoring} SELECT id, name, rdp, margin, score, CASE WHEN id % 3 = 0 THEN '{changed}' ELSE '' END AS locks, CASE WHEN id % 3 = 0 THEN {'' if changed == 'rdp' else chr(39) + 'name:new ' + chr(39) + ' || id || ' + chr(39) + ';' + chr(39) + ' || '}'rdp:10.0' ELSE '' END AS audit FROM scored"


def _commas(c: str, places: str) -> str:
    return f"format('{{:,.{places}f}}', {c})"


_money = f"CASE WHEN selling_price IS NULL THEN '—' WHEN currency = 'USD' THEN '$' || {_commas('selling_price', '0')} ELSE {_commas('selling_price', '0')} || ' ' || coalesce(currency, '') END"
_k = "norm_selling_price / 1000"
_compact = f"CASE WHEN norm_selling_price IS NULL THEN '—' WHEN norm_selling_price < 1000 THEN {_commas('norm_selling_price', '0')} || ' EGP' WHEN {_k} >= 100 THEN printf('%.0f', {_k}) || 'K EGP' ELSE regexp_replace(printf('%.1f', {_k}), '\\.0$', '') || 'K EGP' END"
_penalty = lambda code: ISSUES[code][1]
_waived = "list_sort(list_filter(['MISSING_COST', 'SELLING_BELOW_COST'], lambda c: list_contains(crit, c)))"

ORACLES: dict[str, str] = {
    "manifest_drafts": f"{DRAFTS} SELECT folder, 'sku:' || {SKU_KEY} AS fingerprint, sku, sku_generated, currency, selling_price, margin, quantity, supplier, procurement, has_specs, score, array_to_string(notes, ';') AS notes, array_to_string(issues, ';') AS issues FROM draft",
    "manifest_open_questions": f"{OPEN} SELECT * FROM q",
    "manifest_gap_split": f"{OPEN} SELECT folder, 'unpriced' AS part, name AS text FROM e WHERE NOT has_price UNION ALL SELECT folder, CASE WHEN kind = 'conflict' THEN 'conflict' ELSE 'non_price_gap' END, text FROM q WHERE NOT (kind = 'gap' AND lower(text) LIKE '%price%')",
    "manifest_blockers": f"WITH {ENTRIES} SELECT folder, name, category, {_pick(1, 'No price quoted')} AS blocker, {_pick(2, 'Get a supplier quote, then agree a sell price.')} AS action FROM e WHERE NOT has_price",
    "manifest_import": f"""{DRAFTS}, d AS (SELECT 'sku:' || {SKU_KEY} AS fingerprint, selling_price AS new_price, name AS new_name, lifecycle FROM (SELECT *, 'review' AS lifecycle FROM draft)),
st AS (SELECT 'sku:m' || p_partkey AS fingerprint, p_name AS name, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE p_retailprice END::DOUBLE AS selling_price, p_partkey % 10 = 0 AS held FROM part WHERE p_partkey % 2 = 0)
SELECT fingerprint, CASE WHEN st.name IS NULL THEN new_price WHEN new_name IS NULL OR held THEN st.selling_price ELSE new_price END AS selling_price, CASE WHEN new_name IS NULL THEN 'archived' ELSE 'review' END AS lifecycle, new_name IS NOT NULL AS is_active,
  CASE WHEN st.name IS NULL THEN 'created' WHEN new_name IS NULL THEN 'kept' WHEN NOT held AND st.selling_price IS DISTINCT FROM new_price THEN 'updated' ELSE 'unchanged' END AS outcome, new_name IS NULL AS archived FROM st FULL JOIN d USING (fingerprint)""",
    "manifest_quality": f"{DRAFTS} SELECT code, count(*) AS n, (SELECT {r1('avg(score)', 1)} FROM draft) AS avg_score, (SELECT count(*) FROM draft) AS drafts FROM (SELECT unnest(issues) AS code FROM draft) GROUP BY code",
    "manifest_priced": f"WITH {ENTRIES} SELECT folder, p_retailprice AS selling_price FROM e WHERE has_price",
    "photo_folders": f"WITH {FOLDERS} SELECT folder, title, category, subcategory, n_images, folder || '/1.png' AS primary_image FROM f",
    "product_images": f"WITH {FOLDERS} SELECT folder, i.place, folder || i.tail AS path, i.variant, i.place = 0 AS is_primary FROM f, (VALUES (0, '/1.png', NULL), (1, '/2.jpg', NULL), (2, '/Black/1.JPG', 'Black')) AS i(place, tail, variant)",
    "photo_scores": f"WITH {SCORES} SELECT * FROM scores",
    "assign_folders": f"{LINKS_OF_EVERY} SELECT * FROM links",
    "photo_suggestions": f"WITH {SCORES} SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, id)::INT AS rank FROM scores WHERE score > 0.2 QUALIFY rank <= 3",
    "photo_overview": f"{LINKS} SELECT count(*) AS folders, sum(n_images)::BIGINT AS images, count(*) FILTER (folder IN (SELECT folder FROM links)) AS linked, count(*) FILTER (folder NOT IN (SELECT folder FROM links)) AS unlinked, (SELECT count(*) FROM p WHERE id NOT IN (SELECT id FROM links)) AS products_without_images FROM f",
    "unmatched_folders": f"{LINKS_OF_EVERY} SELECT folder FROM f WHERE folder NOT IN (SELECT folder FROM links)",
    "linked_folders": f"WITH {FOLDERS}, {OWNERS} SELECT folder, n_images, (SELECT max(id) FROM p WHERE image_source = folder) AS id FROM f",
    "link_folders": f"WITH {FOLDERS}, {OWNERS}, l AS (SELECT folder, fid - 4 AS id FROM f WHERE fid % 18 = 0) SELECT p.id, CASE WHEN l.folder IS NOT NULL THEN l.folder WHEN image_source IN (SELECT folder FROM l) THEN NULL ELSE image_source END AS image_source, CASE WHEN l.folder IS NOT NULL THEN 3 ELSE 0 END AS n_images FROM p LEFT JOIN l USING (id)",
    "unlink_products": f"WITH {OWNERS} SELECT id, CASE WHEN id % 28 <> 0 THEN image_source END AS image_source FROM p",
    "public_specs": f"WITH {SPECS} SELECT id, name, value FROM specs WHERE value IS NOT NULL",
    "public_images": """WITH i AS (SELECT p_partkey AS id, n, CASE WHEN n = 1 AND p_partkey % 2 = 0 OR n = 2 AND p_partkey % 2 = 1 THEN 'https://x/' || p_partkey || '-' || n WHEN p_partkey % 4 <> 3 THEN '/img/' || p_partkey || '-' || n END AS url, n = 2 AND p_partkey % 3 = 0 AS is_primary FROM part, (VALUES (1), (2), (3)) t(n))
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY is_primary DESC, n) - 1)::INT AS place, url, is_primary FROM i WHERE url IS NOT NULL""",
    "spec_rows": f"WITH {SPECS} SELECT id, {_place}, label, value FROM rows",
    "spec_highlights": f"WITH {SPECS} SELECT * FROM (SELECT id, {_place}, label, value FROM rows WHERE label NOT IN ('Condition', 'Colour')) WHERE place < 3",
    "spec_counts": f"WITH {SPECS} SELECT m.id, (SELECT count(*) FROM specs s WHERE s.id = m.id AND value IS NOT NULL AND name NOT IN ('condition', 'capacity_gb'))::INT AS n_specs FROM m",
    "json_ld": f"{SCORED} {PUBLIC} SELECT id, name, brand, shown_price AS price, shown_currency AS currency, 'https://schema.org/' || CASE WHEN in_stock THEN 'InStock' ELSE 'OutOfStock' END AS availability FROM (SELECT * REPLACE (coalesce(shown_currency, 'EGP') AS shown_currency) FROM pub)",
    "breadcrumbs": f"WITH {SPECS}, t AS (SELECT id, 0 AS o, 'Home' AS label, '/' AS href FROM m UNION ALL SELECT id, 1, 'Products', '/products' FROM m UNION ALL SELECT id, 2, category, '/products?category=' || category FROM m WHERE category IS NOT NULL UNION ALL SELECT id, 3, name, NULL FROM m) SELECT id, {_place}, label, href FROM t",
    "featured_categories": f"{VIEW}, w AS (SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN 'No such' ELSE p_type END AS category FROM part WHERE p_partkey <= 40) SELECT category, (SELECT nullif(count(*), 0) FROM products p WHERE p.category = w.category AND is_active AND NOT is_draft AND selling_price > 0 AND is_verified) AS n FROM w",
    "dashboard_derived": f"{SCORED} SELECT count(*) AS products, count(*) FILTER (NOT (score >= 70 AND NOT is_blocked)) AS needs_work, count(*) FILTER (band = 'loss') AS loss_makers FROM scored WHERE is_active",
    "chart_top": f"{VIEW}, g AS (SELECT coalesce(brand, '(unassigned)') AS \"group\", {r1('coalesce(sum((coalesce(norm_rdp, 0) * coalesce(quantity, 0))::DECIMAL(20,4)), 0)::DOUBLE')} AS cost, {r1('coalesce(sum((coalesce(norm_selling_price, 0) * coalesce(quantity, 0))::DECIMAL(20,4)), 0)::DOUBLE')} AS retail FROM products WHERE is_active GROUP BY 1) SELECT * FROM g WHERE cost > 0 OR retail > 0 ORDER BY cost DESC, \"group\" LIMIT 12",
    "fix_queue": f"{CODES} SELECT id, code, {_severity} AS severity, CASE WHEN {_of(0)} IS NOT NULL THEN 'fix' WHEN code IN {_decide} THEN 'decide' ELSE 'other' END AS queue, {_of(0)} AS field, {_of(1)} AS label, {_of(2)} AS type FROM codes",
    "issues_ranked": f"{CODES} SELECT s.id, coalesce(c.codes, '') AS codes FROM scored s LEFT JOIN (SELECT id, string_agg(code, ',' ORDER BY {_rank}, code) AS codes FROM codes GROUP BY id) c ON c.id = s.id",
    "collision_members": f"{VIEW}, k AS (SELECT *, {SKU_KEY} AS sku_key FROM products) SELECT * FROM (SELECT sku_key, id, name, source_catalog, count(*) OVER (PARTITION BY sku_key) - 1 AS n_others FROM k WHERE sku_key IS NOT NULL) WHERE n_others > 0",
    "rescore_collisions": f"{SCORED}, k AS (SELECT *, count(*) OVER (PARTITION BY {SKU_KEY}) > 1 AND sku IS NOT NULL AS shared FROM scored) SELECT id, greatest(0::DOUBLE, least(100::DOUBLE, {r1(f'completeness - penalties - CASE WHEN shared THEN {_penalty("DUPLICATE_SKU")} ELSE 0 END', 1)})) AS score, n_critical + shared::BIGINT AS n_critical FROM k",
    "dedupe_full": """WITH d AS (SELECT p_partkey % 700 AS g, p_partkey AS k, (p_partkey % 7)::DOUBLE AS score, 's' || (p_partkey % 2) AS sheet, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS rdp FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, sheet, k) AS place FROM d), x AS (SELECT g, k % 3 AS col, arg_min(k, place) AS v FROM r GROUP BY ALL)
SELECT 'sku:' || g AS fingerprint, max(score) AS score, arg_min(k, place) AS row_index, arg_min(brand, place) FILTER (brand IS NOT NULL) AS brand, arg_min(rdp, place) FILTER (rdp IS NOT NULL) AS rdp, count(*) AS n_sources,
  array_to_string(list_sort(list_distinct(list('note ' || (k % 4)))), ';') AS notes, coalesce(string_agg(sheet || ':' || k, ';' ORDER BY sheet, k) FILTER (place > 1), '') AS sources, (SELECT string_agg('col' || col || '=' || v, ';' ORDER BY col) FROM x WHERE x.g = r.g) AS extras FROM r GROUP BY g""",
    "draft_sources": "SELECT 'sku:' || (p_partkey % 700) AS fingerprint, 's' || (p_partkey % 2) AS sheet, p_partkey AS row_index FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey % 7 DESC, p_partkey % 2, p_partkey) > 1",
    "draft_quality": f"{CODES}, c AS (SELECT code, count(*) AS n FROM codes GROUP BY code) SELECT 'code' AS kind, code AS name, n, (SELECT {r1('avg(score)', 1)} FROM scored) AS avg_score FROM c UNION ALL SELECT 'severity', {_severity}, sum(n)::BIGINT, (SELECT {r1('avg(score)', 1)} FROM scored) FROM c GROUP BY 2",
    "import_report": f"{REPORT} SELECT * FROM r",
    "import_report_totals": f"{REPORT} SELECT count(*) AS sheets, count(*) AS processed, sum(rows_read)::BIGINT AS rows_read, sum(data)::BIGINT AS rows_data, sum(section + title + total)::BIGINT AS rows_skipped FROM r WHERE sheet <> 'sheet-4'",
    "skipped_rows": f"WITH {GRID_ROWS} SELECT sheet, row_index, kind AS reason, text FROM g WHERE kind NOT IN ('data', 'header')",
    "import_runs_page": "SELECT 'run-' || p_partkey AS run_id, CASE WHEN p_partkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, (p_partkey * 37) % 500 AS finished_at FROM part ORDER BY finished_at DESC, run_id LIMIT 20 OFFSET 20",
    "patch_reprice": patched("CASE WHEN id % 3 = 0 THEN 'new ' || id ELSE name END", "name,rdp"), "patch_prices": patched("name", "rdp"),
    "remove_soft": f"{VIEW} SELECT id, is_active AND id % 12 <> 0 AS is_active, CASE WHEN id % 12 = 0 THEN 'archived' ELSE lifecycle END AS lifecycle FROM products",
    "remove_hard": "SELECT p_partkey AS id FROM part WHERE p_partkey % 12 <> 0",
    "create_repeated": "SELECT 'sku:p' || p_partkey AS fingerprint, CASE WHEN n = 0 THEN 'first ' ELSE '' END || p_name AS name, CASE WHEN n = 0 AND p_partkey % 10 = 0 THEN 'created' ELSE 'conflict' END AS outcome FROM part, (VALUES (0), (1)) t(n) WHERE p_partkey % 5 = 0",
    "verify_waived": f"{SCORED}, c AS (SELECT id, list_filter(issues, lambda x: x IS NOT NULL AND (x = 'MISSING_COST' OR x = 'SELLING_BELOW_COST') AND list_contains([" + ", ".join(f"'{k}'" for k, (s, _) in ISSUES.items() if s == "critical") + f"], x)) AS crit, n_critical FROM scored) SELECT id, n_critical = len(crit) AS is_verified, CASE WHEN n_critical = len(crit) THEN 'ann' END AS verified_by, CASE WHEN n_critical = len(crit) THEN array_to_string({_waived}, ',') ELSE '' END AS waived FROM c",
    "brand_filter": f"{VIEW} SELECT id, brand FROM products WHERE brand IN ('Brand#12', 'Brand#13')",
    "public_subcategory": f"{SCORED} {PUBLIC} SELECT id, {SLUG("name || ' ' || id")} AS slug, shown_price FROM pub JOIN (SELECT id, subcategory FROM scored) USING (id) WHERE has_image AND subcategory IN ('STANDARD 1', 'ECONOMY 2', 'PROMO 0', 'SMALL 1')",
    "display_money": f"{VIEW} SELECT id, {_money} AS price, {_compact} AS compact, CASE WHEN margin IS NULL THEN '—' ELSE regexp_replace(printf('%.1f', margin), '\\.0$', '') || '%' END AS margin, {_commas('quantity::DOUBLE', '0')} AS quantity FROM products",
    "posix_paths": "SELECT p_partkey AS id, p_type || '/' || p_brand AS path FROM part",
}
