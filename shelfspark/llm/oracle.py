"""SQL for the queries that SQL can express."""

UNUSABLE = "list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'max') = 1"

NEAREST = f"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND NOT ({UNUSABLE}) AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v AS q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def uuid_of(text: str) -> str:
    h = f"sha256({text})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {s}, {n})" for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


#: The pages hold these entities only; the operator decodes all.
ENTITIES = (("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(html: str) -> str:
    steps = (
        (r"(?s)<!--.*?-->", "' '"),
        (r"(?is)<(script|style|noscript)[^a-z][^>]*>.*?</(script|style|noscript)>|<(script|style|noscript)>.*?</(script|style|noscript)>", "' '"),
        (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)[^>]*>", "chr(10)"),
        (r"(?s)<[^>]*>", "' '"),
    )
    for pattern, by in steps:
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    for name, char in ENTITIES:
        html = f"replace({html}, '{name}', '{char}')"
    for pattern, by in ((r"[ \t\r\f\x0B]+", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    return html


WARC = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'sha256:' || sha256(coalesce(html, '')) AS digest FROM pages),
s AS (
  SELECT *, {uuid_of("'response' || chr(31) || coalesce(CAST(page_id AS VARCHAR), '') || chr(31) || url || chr(31) || digest")} AS source_id,
    {plain_text("html")} AS text, replace({plain_text("regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)")}, chr(10), ' ') AS title FROM p
), b AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-header: Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-header: Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10)
    || 'source-payload-digest: ' || digest || chr(13) || chr(10) || 'source-length: ' || octet_length(encode(html)) || chr(13) || chr(10)
    || 'title: ' || title || chr(13) || chr(10) || 'text-length: ' || length(text) || chr(13) || chr(10) AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', text FROM s
)
SELECT page_id, record_type, {uuid_of("record_type || chr(31) || source_id")} AS record_id, source_id AS refers_to, url AS target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
  'sha256:' || sha256(block) AS payload_digest, digest AS source_digest, CAST(octet_length(encode(block)) AS BIGINT) AS content_length, block FROM b
"""

#: Exact: every pair of documents that share a shingle, by their full sets.
NEAR_DUPLICATES = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM (SELECT * FROM s JOIN n USING (doc_id)) AS a
  JOIN (SELECT * FROM s JOIN n USING (doc_id)) AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(node, to_) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach AS r JOIN both_ways AS w ON r.to_ = w.a),
least_ AS (SELECT node, min(to_) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_ AS l ON l.node = d.doc_id
"""

def crc32_of(text: str) -> str:
    """The CRC-32 of a short ASCII text, bit by bit."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"


#: Runs from equal five-word pieces one period apart: the pieces of a run of 4 periods and 6 words all have such a partner.
PERIODIC = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w, {crc32_of("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1]) END AS w FROM p),
i AS (SELECT r, n, w, unnest(range(n - 4)) AS i FROM d WHERE n >= 6),
s AS (SELECT r, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS piece FROM i),
c AS (SELECT x.r, x.i, y.i - x.i AS q FROM s AS x JOIN s AS y ON x.r = y.r AND x.piece = y.piece AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
e AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM c),
l AS (SELECT r, min(i) AS start, count(*) + 4 + q AS length, q AS period FROM e GROUP BY r, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
m AS (SELECT * FROM l AS x WHERE NOT EXISTS (SELECT 1 FROM l AS y WHERE y.r = x.r AND y.period < x.period AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
o AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS top FROM m GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM m),
f AS (SELECT r, w, unnest(range(n)) AS i FROM d WHERE n > 0),
k AS (SELECT f.r, string_agg(f.w[f.i + 1], ' ' ORDER BY f.i) AS text FROM f LEFT JOIN gone ON gone.r = f.r AND gone.i = f.i WHERE gone.i IS NULL GROUP BY f.r)
SELECT d.doc_id, coalesce(o.n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON o.r = d.r LEFT JOIN k ON k.r = d.r
"""


def _lloyd_round(i: int) -> str:
    return f"""
a{i} AS (SELECT x.row, x.part, arg_min(c.entry, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.entry) AS entry FROM x JOIN c{i} AS c ON x.part = c.part GROUP BY x.row, x.part),
s{i} AS (SELECT a.part, a.entry, [CAST(floor(sum(x.x[1]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[2]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[3]) / count(*)) AS BIGINT), CAST(floor(sum(x.x[4]) / count(*)) AS BIGINT)] AS x FROM a{i} AS a JOIN x ON x.row = a.row AND x.part = a.part GROUP BY a.part, a.entry),
c{i + 1} AS (SELECT c.part, c.entry, coalesce(s.x, c.x) AS x FROM c{i} AS c LEFT JOIN s{i} AS s ON s.part = c.part AND s.entry = c.entry),"""


#: For vectors of 64 components, which the table has.
CODES = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS row, vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND NOT ({UNUSABLE})
), x AS (SELECT row, part, e[4 * part + 1 : 4 * part + 4] AS x FROM v, (SELECT unnest(range(16)) AS part) AS p),
c0 AS (SELECT part, row AS entry, x FROM x WHERE row < 64),
{_lloyd_round(0)}{_lloyd_round(1)}
n AS (
  SELECT x.row, x.part, min(list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + c.entry) AS both_ FROM x JOIN c2 AS c ON x.part = c.part GROUP BY x.row, x.part
), o AS (SELECT v.vec_id, v.label, v.row, string_agg(format('{{:02x}}', CAST(both_ % 64 AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(both_ // 64) AS BIGINT) AS error FROM n JOIN v ON v.row = n.row GROUP BY v.vec_id, v.label, v.row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM o
"""

#: For ids that do not repeat.
FINGERPRINTS = """
WITH d AS (
  SELECT row_number() OVER w AS r, doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text, count(*) OVER () AS rows_
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)
), t AS (
  SELECT r, 0 AS kind, text FROM d UNION ALL SELECT r, 1, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) FROM d
), l AS (SELECT r, kind, unnest(string_split(text, chr(10))) AS line FROM t),
s AS (SELECT r, kind, unnest(regexp_split_to_array(line, '[.!?] ')) AS sentence FROM l),
lw AS (SELECT r, kind, i, sum(CAST('0x' || substr(sha256(line), 1 + 8 * i, 8) AS BIGINT)) % 4294967296 AS v FROM l, (SELECT unnest(range(8)) AS i) WHERE line <> '' GROUP BY r, kind, i),
h AS (SELECT r, kind, c, CAST('0x' || substr(sha256(sentence), 1 + 15 * c, 15) AS BIGINT) AS h FROM s, (SELECT unnest(range(4)) AS c) WHERE sentence <> ''),
b AS (SELECT r, kind, 30 * c + j AS place, sum((h >> j) & 1) AS low, sum((h >> (j + 30)) & 1) AS high FROM h, (SELECT unnest(range(30)) AS j) GROUP BY r, kind, c, j),
n AS (SELECT r, kind, count(*) AS n FROM s WHERE sentence <> '' GROUP BY r, kind),
f AS (
  SELECT t.r, t.kind, coalesce(n.n, 0) AS n, coalesce(w.words, list_transform(range(8), lambda i: '0')) AS words, coalesce(b.sums, list_transform(range(120), lambda i: '0')) AS sums,
    coalesce(b.low, list_transform(range(120), lambda i: 0.0::DOUBLE)) AS low, coalesce(b.high, list_transform(range(120), lambda i: 0.0::DOUBLE)) AS high
  FROM t LEFT JOIN n USING (r, kind) LEFT JOIN (SELECT r, kind, list(format('{:x}', CAST(v AS BIGINT)) ORDER BY i) AS words FROM lw GROUP BY r, kind) AS w USING (r, kind)
  LEFT JOIN (SELECT r, kind, list(format('{:x}', CAST(low + high * 1073741824 AS BIGINT)) ORDER BY place) AS sums, list(CAST(low AS DOUBLE) ORDER BY place) AS low, list(CAST(high AS DOUBLE) ORDER BY place) AS high FROM b GROUP BY r, kind) AS b USING (r, kind)
), g AS (SELECT r, kind, n, format('{:x}', CAST(n AS BIGINT)) || '.' || array_to_string(words, '.') || '.' || array_to_string(sums, '.') AS print, list_transform(list_concat(low, high), lambda x: 2 * x - n) AS x FROM f),
q AS (
  SELECT a.r, a.print AS fingerprint, e.print AS edited_fingerprint, m.print AS next_print, list_dot_product(a.x, a.x) AS aa, list_dot_product(e.x, e.x) AS ee, list_dot_product(m.x, m.x) AS mm, list_dot_product(a.x, e.x) AS ae, list_dot_product(a.x, m.x) AS am
  FROM d JOIN g AS a ON a.r = d.r AND a.kind = 0 JOIN g AS e ON e.r = d.r AND e.kind = 1 JOIN g AS m ON m.kind = 0 AND m.r = d.r % d.rows_ + 1
)
SELECT d.doc_id, d.n AS n_chars, sha256(t.text) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN aa + ee = 0 THEN 1 - power(2::DOUBLE, -40) ELSE least(greatest(0.0::DOUBLE, 2 * ae / (aa + ee)), 1 - power(2::DOUBLE, -40)) END AS near_edited,
  CASE WHEN fingerprint = next_print THEN 1.0::DOUBLE WHEN aa + mm = 0 THEN 1 - power(2::DOUBLE, -40) ELSE least(greatest(0.0::DOUBLE, 2 * am / (aa + mm)), 1 - power(2::DOUBLE, -40)) END AS near_next
FROM d JOIN q ON q.r = d.r JOIN t ON t.r = d.r AND t.kind = 1
"""

ORACLES: dict[str, str] = {"op1_nearest": NEAREST, "op2_warc": WARC, "op5_minhash": NEAR_DUPLICATES, "op11_periodic": PERIODIC, "op12_codes": CODES, "op13_fingerprints": FINGERPRINTS}
