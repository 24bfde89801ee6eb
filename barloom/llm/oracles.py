"""DuckDB SQL of the text queries that SQL can express, over whole texts."""

from __future__ import annotations

import string

NEAR_DEDUP = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id"""

SUFFIX_DEDUP = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY 1),
g AS (SELECT w.doc_id, w.i, CASE WHEN w.i > lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) + 50 THEN 1 ELSE 0 END AS fresh FROM w JOIN f ON w.s = f.s WHERE f.low < w.doc_id),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
t AS (SELECT q.doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(b) AS last FROM q JOIN h ON q.doc_id = h.doc_id GROUP BY 1)
SELECT h.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM h LEFT JOIN t ON h.doc_id = t.doc_id"""

COLLOCATIONS = rf"""WITH RECURSIVE p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS k FROM w))),
f AS (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, ph, a, n, string_split(ph, ' ') AS ws FROM f JOIN t USING (lang) WHERE f.k > 1),
d AS (SELECT c.*, unnest(range(1, c.k)) AS cut FROM c),
e AS (SELECT d.lang, d.ph, d.a, d.n, d.cut, x.a AS l, y.a AS r, CAST(1000::HUGEINT * d.a * d.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM d JOIN f x ON x.lang = d.lang AND x.ph = array_to_string(d.ws[:d.cut], ' ') JOIN f y ON y.lang = d.lang AND y.ph = array_to_string(d.ws[d.cut + 1:], ' ')),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT lang, array_to_string(ws[i:i + j - 1], ' ') AS ph, a FROM (SELECT lang, ws, a, j, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))),
s AS (SELECT b.* FROM b WHERE NOT EXISTS (FROM o WHERE o.lang = b.lang AND o.ph = b.ph AND 100 * o.a >= 100 * b.a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank FROM s)
SELECT lang, rank, ph AS phrase, a, l, r, n, score FROM q WHERE rank <= 2000"""

DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT g.lang, g.source, coalesce(x.n, 0) AS n, coalesce(y.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g
    LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) x ON x.lang = g.lang AND x.source = g.source LEFT JOIN (SELECT lang, count(*) AS v FROM v GROUP BY 1) y ON y.lang = g.lang),
m AS (SELECT s.lang, s.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.n + 5 * s.v) AS p FROM s JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
q AS (SELECT x.lang, x.term, 1 + 1000000000::HUGEINT * (x.n + 5) // (y.n + 5 * y.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) x JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM s GROUP BY 1) y ON x.lang = y.lang),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source AS x, b.source AS y, sum(abs(a.p - b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term GROUP BY 1, 2, 3) f ON f.lang = a.lang AND f.x = a.source AND f.y = b.source
    UNION ALL SELECT m.lang, m.source, 'term', m.term, m.p - q.q FROM m JOIN q ON m.lang = q.lang AND m.term = q.term WHERE m.n > 0 AND m.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""

WARC = """WITH h AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM h),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

ORACLES = {"op2_minhash_near_dedup": NEAR_DEDUP, "op4_suffix_dedup": SUFFIX_DEDUP, "op11_collocations": COLLOCATIONS, "op12_source_divergence": DIVERGENCE, "op13_warc": WARC}
