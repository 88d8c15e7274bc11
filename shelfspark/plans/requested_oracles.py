"""DuckDB SQL for the queries of `requested`."""

from __future__ import annotations

from shelfspark.config import ISSUES
from shelfspark.plans.more_oracles import GRID_ROWS, REPORT
from shelfspark.plans.oracles import MEASURES, PUBLIC, SCORED, band, mean, r1

_RUBRIC = ", ".join(f"('{c}', '{s}', {p}::DOUBLE)" for c, (s, p) in ISSUES.items())
_VIEWS = (
    ("'summary'", "'all'", "is_active"), ("'category'", "coalesce(category, '(unassigned)')", "is_active"), ("'band'", "band", "is_active AND margin IS NOT NULL"),
    ("'supplier'", "coalesce(supplier, '(unknown)')", "is_active"), ("'procurement'", "procurement", "true"),
)
_MARGIN, _GROSS = r1("(s - rdp) / rdp * 100"), r1("(s - rdp) / s * 100")

ORACLES: dict[str, str] = {
    "requests_checked": """WITH r AS (SELECT p_partkey AS k, p_size AS z, p_name, p_brand FROM part),
c AS (SELECT *, CASE WHEN k % 4 = 0 AND z <= 20 THEN z END::DOUBLE AS min_price, CASE k % 6 WHEN 2 THEN 40 WHEN 4 THEN 7 END::DOUBLE AS max_quantity, CASE k % 3 WHEN 0 THEN true WHEN 2 THEN false END AS is_active FROM r)
SELECT k AS id, CASE WHEN k % 7 IN (1, 3) THEN 2 ELSE 1 END::BIGINT AS page, CASE WHEN k % 5 = 1 THEN 10 ELSE 25 END::BIGINT AS "limit", '-updated' AS sort, CASE WHEN k % 8 = 0 THEN 'USD' END AS currency,
  coalesce(concat_ws(';', CASE WHEN k % 8 = 1 THEN 'currency: not one of EGP, USD' END, CASE WHEN k % 3 = 1 THEN 'is_active: neither true nor false' END, CASE WHEN k % 5 = 0 THEN 'limit: over 200' END,
    CASE WHEN k % 6 = 1 THEN 'max_quantity: not a whole number' END, CASE WHEN k % 4 = 1 THEN 'min_price: under 0' WHEN k % 4 = 3 THEN 'min_price: not a number' WHEN k % 4 = 0 AND z > 20 THEN 'min_price: over the maximum' END,
    CASE WHEN k % 6 = 0 THEN 'min_quality: over 100' END, CASE k % 7 WHEN 0 THEN 'page: under 1' WHEN 2 THEN 'page: not a number' END), '') AS errors,
  min_price, max_quantity, is_active, CASE WHEN k % 2 = 0 THEN p_brand || '|Acme' END AS brands, p_name AS search,
  ((min_price IS NOT NULL)::INT + (k % 4 = 0)::INT + (max_quantity IS NOT NULL)::INT + (is_active IS NOT NULL)::INT + (k % 2 = 0)::INT + 1)::BIGINT AS n FROM c""",
    "edits_checked": """SELECT p_partkey AS id, ['name', 'name', 'brand', 'rdp', 'rdp', 'quantity', 'currency', 'lifecycle', 'is_active', 'score', 'selling_price'][p_partkey % 11 + 1] AS field,
  CASE p_partkey % 11 WHEN 1 THEN 'under 2 characters' WHEN 2 THEN CASE WHEN length(p_name) * 9 > 120 THEN 'over 120 characters' END WHEN 4 THEN 'under 0' WHEN 5 THEN 'not a whole number' WHEN 6 THEN 'not a choice'
    WHEN 8 THEN 'neither true nor false' WHEN 9 THEN 'not editable' END AS error FROM part""",
    "requested_page": f"""{SCORED}, t AS (SELECT count(*) AS total FROM scored WHERE procurement IN ('must_buy', 'test_buy') AND is_active AND margin >= 10 AND quantity <= 40 AND coalesce(array_to_string(issues, ','), '') <> '')
SELECT total, 3::BIGINT AS page, 20::BIGINT AS "limit", ceil(total / 20)::BIGINT AS pages, total > 60 AS has_next, true AS has_prev FROM t""",
    "shop_page": f"{SCORED} {PUBLIC} SELECT id, brand, shown_price FROM pub WHERE brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND shown_price >= 1000 ORDER BY shown_price, id LIMIT 24",
    "quotes": f"""WITH a AS (SELECT p_partkey AS id, [p_retailprice, p_retailprice * 2, 0, NULL, p_retailprice][p_partkey % 5 + 1] AS rdp, coalesce([NULL, p_retailprice + 100, p_retailprice * 3][p_partkey % 3 + 1], CASE WHEN p_partkey % 2 = 0 THEN p_retailprice + 500 END) AS s FROM part),
m AS (SELECT *, CASE WHEN rdp > 0 THEN {_MARGIN} END AS margin, CASE WHEN s > 0 THEN {_GROSS} END AS gross_margin FROM a)
SELECT id, 'EGP' AS currency, s AS selling_price, margin, gross_margin, {r1("s - rdp")} AS margin_value, {band("margin")} AS band, CASE WHEN rdp > 0 THEN {r1("rdp")} END AS break_even, CASE WHEN rdp > 0 THEN {r1("rdp * 1.3::DOUBLE")} END AS price_at_target, CASE WHEN rdp > 0 THEN {r1("rdp * 1.25::DOUBLE")} END AS price_at_warn FROM m""",
    "preview_skipped": f"WITH {GRID_ROWS} SELECT sheet, row_index, kind AS reason, text FROM g WHERE kind NOT IN ('data', 'header') ORDER BY sheet, row_index LIMIT 100",
    "preview_sheets": f"{REPORT} SELECT count(*) AS sheets, count(*) AS processed, sum(rows_read)::BIGINT AS rows_read, sum(data)::BIGINT AS rows_data, sum(section + title + total)::BIGINT AS rows_skipped FROM r WHERE sheet IN ('sheet-1', 'sheet-2')",
    "dashboard_groups": f"{SCORED}, v AS (" + " UNION ALL ".join(f'SELECT {view} AS view, {group} AS "group", * FROM scored WHERE {when}' for view, group, when in _VIEWS) + f""") SELECT view, "group", {MEASURES}, {mean("gross_margin")} AS avg_gross_margin, {mean("score")} AS avg_score,
  count(*) FILTER (is_verified) AS verified, count(*) FILTER (is_generic) AS generic, count(*) FILTER (selling_price > 0) AS priced, count(*) FILTER (procurement = 'must_buy') AS must_buy, count(*) FILTER (procurement = 'avoid') AS avoid FROM v GROUP BY view, "group\"""",
    "rubric_use": f"{SCORED}, seen AS (SELECT code, count(*) AS n FROM (SELECT unnest(issues) AS code FROM scored) GROUP BY code) SELECT r.code, severity, penalty, coalesce(n, 0) AS n, coalesce(n, 0) * penalty AS points FROM (VALUES {_RUBRIC}) r(code, severity, penalty) LEFT JOIN seen ON seen.code = r.code",
    "order_days": "SELECT strftime(o_orderdate, '%-d %b %Y') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, count(*) AS n FROM orders GROUP BY ALL",
}
