"""DuckDB SQL for the queries of `typed`: what the rules make of each kind of cell, by the part's number."""

from __future__ import annotations

from shelfspark.config import COLORS
from shelfspark.plans.oracles import FINGERPRINT, SLUG, VIEW

_COLOR = " ".join(f"WHEN regexp_matches(lower(title), '\\b{c}\\b') THEN '{c.title()}'" for c in sorted(COLORS, key=len, reverse=True))

#: A row for each part: the cells that decide, then what follows from them.
ROWS = f"""WITH cells AS (
  SELECT p_partkey AS k, floor(p_retailprice) AS price, p_size AS size, ['Must Buy', 'Trial list', 'Stock'][p_partkey % 3 + 1] AS sheet, (p_partkey + 10)::INT AS row_index,
    CASE WHEN p_partkey % 11 <> 0 THEN ['', 'Anker ', 'soundcore by Anker ', 'power bank '][p_partkey % 4 + 1] || p_name || ' ' || ['C-L', 'USB-A to HDMI', 'plain'][p_partkey % 3 + 1] END AS title,
    CASE p_partkey % 5 WHEN 3 THEN NULL WHEN 4 THEN p_partkey || 'X' ELSE 'JR-' || p_partkey END AS sku,
    CASE WHEN p_partkey % 6 = 0 THEN 'Cairo Trade' ELSE ['Joyroom', 'Joyroom', NULL, NULL, 'Acme'][p_partkey % 5 + 1] END AS told FROM part),
named AS (
  SELECT *, coalesce(title, sku) AS name, coalesce(['Generic', 'Dell', 'SanDisk', NULL, NULL, 'Acme-Pro', 'HP'][k % 7 + 1], told, CASE WHEN title IS NOT NULL THEN [NULL, 'Anker', 'Soundcore', NULL][k % 4 + 1] END) AS brand FROM cells WHERE coalesce(title, sku) IS NOT NULL),
given AS (
  SELECT *, CASE WHEN k % 9 <> 1 THEN price WHEN k % 4 = 0 THEN price WHEN k % 4 = 2 THEN 7.5 END::DOUBLE AS rdp, CASE WHEN k % 8 = 0 THEN (price + size * 1000) / 2 END::DOUBLE AS rrp,
    k % 9 <> 1 AND k % 4 = 2 AS cost_mismatch, k % 3 > 0 AND (title IS NULL OR k % 4 < 2) AS category_unmapped, (k % 9 <> 1 AND k % 3 = 1) OR k % 4 IN (1, 2) OR k % 8 = 0 AS is_estimated,
    CASE k % 6 WHEN 0 THEN size END::DOUBLE AS power_wattage, CASE WHEN title IS NOT NULL THEN ['USB-C to Lightning', 'USB-A to HDMI', NULL][k % 3 + 1] END AS cable_type,
    CASE WHEN k % 6 = 0 THEN 10000 WHEN k % 12 = 3 AND title IS NOT NULL THEN 20000 END::BIGINT AS battery_capacity,
    CASE WHEN k % 4 = 1 THEN size || 'GB' WHEN k % 4 = 2 THEN '2.5TB' WHEN k % 6 = 5 THEN '512GB' END AS capacity, CASE WHEN k % 4 = 1 THEN size WHEN k % 4 = 2 THEN 2560 WHEN k % 6 = 5 THEN 512 END::DOUBLE AS capacity_gb,
    CASE WHEN k % 10 = 3 THEN 'Type-C port' WHEN k % 6 = 1 THEN 'USB 3.2 GEN 2' WHEN k % 6 = 4 THEN 'NVME' END AS interface, NULL::VARCHAR AS form_factor, CASE WHEN k % 6 = 1 THEN round(size * 0.01, 3) END::DOUBLE AS length_m,
    CASE WHEN k % 7 = 2 THEN 'sky blue' WHEN k % 6 = 5 THEN 'Deep Red' WHEN k % 6 = 3 THEN 'Navy Blue' {_COLOR} END AS color,
    CASE WHEN k % 4 = 1 OR k % 12 = 4 THEN 24 WHEN k % 4 = 2 THEN 18 END::BIGINT AS warranty_months, ['unknown', 'original_pull', 'new', 'refurbished', 'unknown'][k % 5 + 1] AS condition,
    CASE k % 6 WHEN 0 THEN size || 'W#10,000mAh' WHEN 1 THEN size || ' cm#usb 3.2 gen 2' WHEN 2 THEN '' WHEN 3 THEN '20K navy blue case' WHEN 4 THEN '2 years, NVMe' ELSE 'colour: deep red#512GB' END AS features FROM named),
counted AS (
  SELECT *, (power_wattage IS NOT NULL)::INT + (cable_type IS NOT NULL)::INT + (battery_capacity IS NOT NULL)::INT + (capacity IS NOT NULL)::INT + (interface IS NOT NULL)::INT + (length_m IS NOT NULL)::INT + (color IS NOT NULL)::INT
    + (warranty_months IS NOT NULL)::INT + (features <> '')::INT + k % 2 AS n_specs FROM given)
"""
_N = lambda condition: f"count(*) FILTER (WHERE {condition})"
_OWN = "p_name || ' ' || p_brand || ' own ' || p_partkey"

ORACLES: dict[str, str] = {
    "typed_drafts": ROWS + """SELECT sheet, row_index, name, brand, k % 7 = 1 AS brand_multi, coalesce(told, brand) AS supplier, category_unmapped, sku, CASE WHEN k % 3 = 1 THEN 'USD' ELSE 'EGP' END AS currency, rdp, rrp,
  CASE WHEN k % 4 = 1 THEN price * 10 WHEN k % 4 = 2 THEN price ELSE rrp END::DOUBLE AS selling_price, CASE WHEN k % 5 = 0 THEN 5 END::DOUBLE AS market_low, CASE WHEN k % 5 = 0 THEN size * 100 END::DOUBLE AS market_high,
  [size, 0, NULL, 1200][k % 4 + 1]::BIGINT AS quantity, k % 5 <> 4 AS is_active, k % 7 = 0 AS is_generic, ['must_buy', 'avoid', 'test_buy', 'must_buy', 'opportunity', 'unclassified'][k % 6 + 1] AS procurement,
  is_estimated, k % 4 = 2 OR k % 8 = 0 AS is_range, cost_mismatch,
  nullif(concat_ws(chr(10), CASE WHEN k % 3 = 1 THEN 'checked' END, [NULL, 'Avoid', 'Hold for test', 'approve', 'consider', 'later'][k % 6 + 1], CASE WHEN k % 5 = 0 THEN 'market: street' END), '') AS notes,
  CASE WHEN k % 2 = 1 THEN 'Bin' ELSE '' END AS unmapped, CASE WHEN k % 4 = 2 THEN '1TB=' || price::BIGINT || ';2TB=' || price::BIGINT || '9' ELSE '' END AS variants FROM counted""",
    "typed_specs": ROWS + "SELECT sheet, row_index, power_wattage, cable_type, battery_capacity, capacity, interface, form_factor, length_m, color, warranty_months, capacity_gb, condition, features, n_specs::BIGINT AS n_specs FROM counted",
    "typed_issues": ROWS + f"""SELECT sheet, count(*) AS n, {_N('k % 2 = 1')} AS unparsed_columns, {_N('n_specs = 0')} AS missing_specs, {_N('cost_mismatch')} AS cost_mismatch, {_N('k % 7 = 0')} AS generic_item, {_N('k % 5 = 4')} AS draft_item,
  {_N('category_unmapped')} AS unmapped_category, {_N('is_estimated')} AS estimated_price, {_N('rdp IS NULL')} AS missing_cost FROM counted GROUP BY sheet""",
    "mapping_confidence": "SELECT DISTINCT ['Must Buy', 'Trial list', 'Stock'][p_partkey % 3 + 1] AS sheet, CASE WHEN p_partkey % 3 = 1 THEN 0.995 ELSE 1.0 END::DOUBLE AS confidence FROM part",
    "find_by_sku": VIEW + "SELECT ' p – ' || s_suppkey AS asked, id FROM supplier JOIN products ON sku = 'P-' || s_suppkey",
    "find_by_fingerprint": VIEW + f"SELECT 'sku:p' || s_suppkey AS asked, id FROM supplier JOIN products ON {FINGERPRINT} = 'sku:p' || s_suppkey",
    "slugs_held": f"""SELECT 'sku:p' || p_partkey AS fingerprint, {SLUG(_OWN)} AS wanted, CASE WHEN p_partkey % 4 = 1 THEN {SLUG(_OWN + " || ' P-' || (p_partkey % 3)")} ELSE {SLUG(_OWN)} END AS slug FROM part""",
    "infer_brand": "SELECT p_partkey AS id, ['Soundcore', 'Western Digital', 'HP', NULL, NULL][p_partkey % 5 + 1] AS brand FROM part",
    "split_supplier_sku": "SELECT p_partkey AS id, ['Joyroom', 'Anker', NULL, NULL, NULL, NULL][p_partkey % 6 + 1] AS supplier, CASE p_partkey % 6 WHEN 0 THEN 'JR-' || p_partkey WHEN 1 THEN 'A' || p_partkey WHEN 2 THEN 'A' || p_partkey WHEN 3 THEN 'two words' WHEN 5 THEN '/' || p_partkey END AS sku FROM part",
    "text_keys": """SELECT p_partkey AS id, p_partkey % 3 = 1 AS arabic, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', '-') || ['', ' كابل', ' A_b'][p_partkey % 3 + 1] AS title,
  'Part ' || lower(p_brand) AS label, CASE WHEN length(p_name) > 12 THEN rtrim(left(p_name, 11)) || '…' ELSE p_name END AS short, 'Photos/' || replace(p_name, ' ', '%20') || '/a%20b.jpg' AS path FROM part""",
}
