"""DuckDB SQL for the queries of `deep`, from the rules and not from the operators."""

from __future__ import annotations

from shelfspark.operators.reports import AT_A_LOSS, NO_PHOTOS
from shelfspark.plans.more_oracles import ENTRIES, GRID_ROWS
from shelfspark.plans.more_oracles import ORACLES as MORE
from shelfspark.plans.oracles import VIEW

K = "p_partkey"

#: What the rules make of the sixteen kinds of cells: SKU, what it corrects, whether it is unsure, others.
SKUS = (
    (f"'JR-T' || {K}", "NULL", "false", "''"), (f"'JR-QP' || {K} || ' Mini'", "NULL", "false", "''"), (f"'JR-PR' || {K}", f"'JR-PK' || {K}", "false", "''"), (f"'A' || ({K} + 1000)", "NULL", "false", "''"), (f"'A' || ({K} + 1000)", "NULL", "false", "''"),
    (f"'JR-PF' || {K}", "NULL", "true", f"'iP Series (model varies per phone, e.g. JR-PF' || {K} || ')'"), ("NULL", "NULL", "false", "''"), ("NULL", "NULL", "false", "''"), (f"'JR-PF' || {K}", "NULL", "false", "''"),
    (f"'Varies A' || ({K} + 1000)", "NULL", "true", "''"), (f"'e.g. JR-PF' || {K}", "NULL", "false", "''"), (f"'B' || ({K} + 1000)", "NULL", "false", "''"), (f"'JR-A' || {K}", "NULL", "true", f"'JR-B' || {K} || ';JR-C' || {K}"),
    (f"'JR-X' || {K}", "NULL", "true", f"'JR-Y' || {K}"), ("NULL", "NULL", "false", "''"), (f"'A' || ({K} + 1000)", "NULL", "true", f"'B' || ({K} + 1000)"),
)


def _case(at: int) -> str:
    return f"CASE {K} % {len(SKUS)} " + " ".join(f"WHEN {i} THEN {row[at]}" for i, row in enumerate(SKUS)) + " END"


APPROVED = f"""a AS (
  SELECT CASE WHEN {K} % 2 = 0 THEN 'Must Buy' ELSE 'Test Buy' END AS sheet, CAST({K} + 10 AS INT) AS row_index,
    CASE {K} % 5 WHEN 0 THEN 'XM-' || {K} || 'B' WHEN 1 THEN 'ZZ-' || {K} WHEN 2 THEN 'M-' || {K} WHEN 3 THEN '' ELSE 'Set M-' || {K} || ', M-' || ({K} + 1) END AS sku, p_name AS product, '100' AS rdp, '200' AS rrp,
    CAST(floor(p_retailprice) AS BIGINT)::VARCHAR AS list, CASE {K} % 3 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN -0.1::DOUBLE END AS margin, p_size::VARCHAR AS qty, CASE WHEN {K} % 2 = 0 THEN 'checked by ' || p_brand ELSE '' END AS note FROM part WHERE {K} % 7 <> 0
)"""
UNLISTED = f"WITH {ENTRIES}, l AS (SELECT DISTINCT own_sku AS sku FROM e WHERE own_sku IS NOT NULL), {APPROVED}, u AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM l WHERE a.sku LIKE '%' || l.sku || '%'))"
_plain = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
REPORT = f"""{UNLISTED}, b AS ({MORE["manifest_blockers"].removeprefix(f"WITH {ENTRIES} ")}),
rows_ AS (
  SELECT 'Not live' AS sheet, 5 AS width, 'row' AS kind, category || '|' || name || '|' || blocker || '|' || action || '|' || folder AS cells FROM b
  UNION ALL SELECT 'Priced, no photos', 11, 'row', coalesce(nullif(sku, ''), '') || '|' || product || '|' || sheet || '|100|200|' || list || '|' || CASE WHEN margin IS NULL THEN '' ELSE printf('%.1f', margin * 100) || '%' END || '|' || qty || '|'
    || CASE WHEN margin < 0 THEN '{AT_A_LOSS[0]}|{AT_A_LOSS[1]}' ELSE '{NO_PHOTOS[0]}|{NO_PHOTOS[1]}' END || '|' || note FROM u
  UNION ALL SELECT 'On sale now', 5, 'row', category || '|' || name || '|' || coalesce(own_sku, '') || '|' || {_plain.format("p_retailprice")} || '|' || {_plain.format("(p_retailprice - 100)")} FROM e WHERE has_price
  UNION ALL SELECT 'Not live', 5, 'head', 'Category|Product|Blocker|What would make it live|Folder'
  UNION ALL SELECT 'Priced, no photos', 11, 'head', 'SKU|Product|Approved on|Cost (EGP)|RRP (EGP)|List price (EGP)|Margin after free ship|Planned qty|Why it is not live|What would make it live|Workbook note'
  UNION ALL SELECT 'On sale now', 5, 'head', 'Category|Product|SKU|List price (EGP)|Cost (EGP)'
) SELECT * FROM rows_"""

FOLD = """WITH RECURSIVE d AS (
  SELECT 'sku:' || (p_partkey % 700) AS f, (p_partkey % 7)::DOUBLE AS score, 's' || (p_partkey % 2) AS sheet, p_partkey AS row_index, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand,
    CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS rdp, 'note ' || (p_partkey % 4) AS note, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey % 2, p_partkey) AS n FROM part
), s AS (
  SELECT f, n, score, sheet, row_index, brand, rdp, [note] AS notes FROM d WHERE n = 1
  UNION ALL SELECT s.f, d.n, greatest(0, 50.0 * ((coalesce(s.brand, d.brand) IS NOT NULL)::INT + (coalesce(s.rdp, d.rdp) IS NOT NULL)::INT) - 15)::DOUBLE,
    CASE WHEN d.score > s.score THEN d.sheet ELSE s.sheet END, CASE WHEN d.score > s.score THEN d.row_index ELSE s.row_index END,
    CASE WHEN d.score > s.score THEN coalesce(d.brand, s.brand) ELSE coalesce(s.brand, d.brand) END, CASE WHEN d.score > s.score THEN coalesce(d.rdp, s.rdp) ELSE coalesce(s.rdp, d.rdp) END,
    CASE WHEN d.score > s.score THEN list_concat([d.note], list_filter(s.notes, lambda x: x <> d.note)) WHEN list_contains(s.notes, d.note) THEN s.notes ELSE list_append(s.notes, d.note) END
  FROM s JOIN d ON d.f = s.f AND d.n = s.n + 1
) SELECT f AS fingerprint, sheet, row_index, brand, rdp, score, array_to_string(notes, ';') AS notes, n AS n_sources FROM s QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC) = 1"""

_stored, _draft = f"{K} % 10 <> 0", f"{K} % 8 <> 0"
_both = f"({_stored} AND {_draft})"
NESTED_UPSERT = f"""SELECT 'sku:p' || {K} AS fingerprint, CASE WHEN {_stored} THEN p_name END AS name, CASE WHEN {_stored} THEN 'EGP' END AS currency,
  CASE WHEN {_draft} AND NOT ({_stored} AND {K} % 7 IN (0, 1)) THEN p_retailprice + 1 ELSE p_retailprice END AS rdp, CASE WHEN {_draft} AND NOT ({_stored} AND {K} % 7 = 0) THEN p_retailprice + 200 ELSE p_retailprice + 100 END AS selling_price,
  CASE WHEN {_draft} AND NOT ({_stored} AND {K} % 7 = 1) THEN 'new;fast' ELSE 'old' END AS features, CASE WHEN {_draft} AND NOT ({_stored} AND {K} % 7 = 1) AND {K} % 2 = 0 THEN 'red' END AS color,
  CASE WHEN {_stored} THEN 'A' END AS hall, CASE WHEN {_draft} THEN {K} + 1 ELSE {K} END AS shelf, CASE WHEN {_stored} THEN {K} % 3 = 0 ELSE true END AS is_verified,
  CASE WHEN {_stored} AND {K} % 3 = 0 THEN 'approved' ELSE 'review' END AS lifecycle, CASE WHEN NOT ({_stored}) THEN 'created' WHEN {_draft} THEN 'updated' ELSE 'kept' END AS outcome,
  CASE WHEN {_both} THEN CASE {K} % 7 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END + 1 + CASE WHEN {K} % 3 = 0 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS locks_kept
FROM part WHERE {_stored} OR {_draft}"""

_bad = f"{K} % 5 IN (2, 3)"
_locked = f"CASE {K} % 7 WHEN 0 THEN ['pricing'] WHEN 1 THEN ['pricing.rdp', 'specs'] ELSE [] END"
_changed = f"CASE WHEN {_bad} THEN [] ELSE list_concat(CASE {K} % 5 WHEN 0 THEN ['pricing.rdp'] WHEN 1 THEN ['specs.features'] ELSE [] END, CASE WHEN {K} % 4 = 0 THEN ['specs.color'] ELSE [] END) END"
#: Leaves stand in the schema's order: features come before the colour.
NESTED_PATCH = f"""SELECT {K} AS id, CASE WHEN {K} % 5 = 0 THEN 1.5 ELSE p_retailprice END AS rdp, CASE WHEN {K} % 5 = 1 THEN 'a;b' ELSE 'old' END AS features, CASE WHEN {K} % 4 = 0 AND NOT ({_bad}) THEN 'blue' END AS color,
  array_to_string(list_concat({_locked}, list_filter({_changed}, lambda x: NOT list_contains({_locked}, x))), ';') AS locks, CASE WHEN {_bad} THEN 'failed' WHEN len({_changed}) > 0 THEN 'updated' ELSE 'unchanged' END AS outcome,
  array_to_string({_changed}, ';') AS changed, CASE {K} % 5 WHEN 2 THEN 'status.is_verified' WHEN 3 THEN 'pricing.rdp' ELSE '' END AS invalid FROM part WHERE {_stored}"""


#: The stem asked for: `tioning` becomes `tion`, and `the` is a stop word. Words of that stem end in nothing, -s, -ed or -ing, the n once or twice.
DOCUMENTS = """WITH w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'with')) AS w FROM documents
), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN ('tion', 'tions', 'tioned', 'tioning', 'tionings', 'tioneds', 'tionned', 'tionning', 'tionnings', 'tionneds'))) AS c FROM w)
SELECT doc_id, round((0.5 + 0.5 * c / n) * (2 - power(2.0, 1 - c)), 9) AS score FROM c WHERE c > 0 ORDER BY score DESC, doc_id LIMIT 25"""

ORACLES: dict[str, str] = {
    "normalize_sku": f"SELECT {K} AS id, {_case(0)} AS sku, {_case(1)} AS corrected_from, {_case(2)} AS is_ambiguous, {_case(3)} AS alternates FROM part",
    "approved_skus": f"WITH {APPROVED} SELECT * FROM a",
    "unlisted_skus": f"{UNLISTED} SELECT sheet, row_index, sku FROM u",
    "admin_search_ranked": f"{VIEW} SELECT id, (CASE WHEN name LIKE '% bolt' THEN 0.75 ELSE 0 END + CASE WHEN sku IS NOT NULL THEN 0.75 ELSE 0 END + CASE WHEN sku = 'P-77' THEN 0.75 ELSE 0 END)::DOUBLE AS score FROM products WHERE (name LIKE '% bolt' OR sku IS NOT NULL) AND name NOT LIKE 'red %'",
    "search_documents": DOCUMENTS,
    "report_workbook": REPORT,
    "recalculate_rows": f"{VIEW} SELECT id, margin, band, id % 5 = 0 AND margin IS NOT NULL AS changed FROM products",
    "import_audit": f"WITH {GRID_ROWS}, k AS (SELECT * FROM g WHERE kind NOT IN ('data', 'header') ORDER BY sheet, row_index LIMIT 500) SELECT 'sheet' AS kind, sheet, count(*)::BIGINT AS n, NULL::VARCHAR AS text FROM g GROUP BY sheet UNION ALL SELECT 'skipped', sheet, row_index::BIGINT, text FROM k",
    "dedupe_fold": FOLD, "nested_upsert": NESTED_UPSERT, "nested_patch": NESTED_PATCH,
}
