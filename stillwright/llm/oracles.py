"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

SHARDING = """
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::UBIGINT), 60, '0') AS b FROM documents),
p AS (SELECT doc_id, d, substr(b, 1, d::BIGINT) AS s, n FROM h, range(0, 61) t(d)),
z AS (SELECT s, d, sum(n) AS z FROM p GROUP BY s, d),
m AS (SELECT doc_id, min(d) AS d FROM p JOIN z USING (s, d) WHERE z <= {limit} OR d = 60 GROUP BY doc_id)
SELECT p.doc_id, p.n::BIGINT AS n_bytes, p.s AS shard, p.d::BIGINT AS depth, z.z::BIGINT AS shard_bytes FROM p JOIN m USING (doc_id, d) JOIN z USING (s, d)"""

SUBSTRING_DEDUP = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM t),
g AS (SELECT doc_id, pos, w, {lead} AS key, lead(w, 12) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS whole FROM u),
f AS (SELECT key, min(doc_id) AS least FROM g WHERE whole GROUP BY key),
s AS (SELECT g.doc_id, g.pos, g.w, g.whole AND f.least < g.doc_id AS starts FROM g LEFT JOIN f ON f.key = g.key AND g.whole),
c AS (SELECT doc_id, pos, w, coalesce(bool_or(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM s),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN r USING (doc_id)""".replace(
    "{lead}", "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY pos)" for k in range(1, 13)) + ")"
)


def decontamination(window: int, equal: int) -> str:
    """Every alignment with enough equal words is tried: pairs of equal words, counted by how far they are apart."""

    def words(name: str, key: str) -> str:
        ws = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
        return f"(SELECT {key}, unnest({ws}) AS w, unnest(range(0, len({ws}))) AS pos FROM {name})"

    return f"""
WITH d AS {words("documents", "doc_id")}, i AS {words("benchmark", "item_id")}, n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
h AS (SELECT doc_id, item_id, d.pos - i.pos AS shift, n.n FROM d JOIN i USING (w) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) * {window} >= least({window}, n.n) * {equal}),
e AS (SELECT h.doc_id, h.item_id, h.shift, h.n, i.pos, CASE WHEN d.w = i.w THEN 1 ELSE 0 END AS eq FROM h JOIN i USING (item_id) LEFT JOIN d ON d.doc_id = h.doc_id AND d.pos = h.shift + i.pos),
s AS (SELECT *, sum(eq) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS inside FROM e),
a AS (SELECT doc_id, item_id, shift, n, sum(eq) AS matched, max(inside) FILTER (pos <= n - least({window}, n)) AS best FROM s GROUP BY ALL)
SELECT doc_id, item_id, max(n)::BIGINT AS item_words, max(matched)::BIGINT AS matched, max(best)::BIGINT AS window_matched FROM a WHERE best * {window} >= least({window}, n) * {equal} GROUP BY doc_id, item_id"""


JACCARD_JOIN = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7f])+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM t),
g AS (SELECT doc_id, concat_ws(' ', w, lead(w, 1) OVER x, lead(w, 2) OVER x, lead(w, 3) OVER x, lead(w, 4) OVER x) AS s, lead(w, 4) OVER x IS NOT NULL AS whole FROM u WINDOW x AS (PARTITION BY doc_id ORDER BY pos)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE whole UNION SELECT doc_id, array_to_string(ws, ' ') FROM t WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k) - 1e-9
  UNION ALL SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON len(x.ws) = 0 AND len(y.ws) = 0 AND x.doc_id <> y.doc_id),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id WHERE r.root < l.b),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a),
q AS (SELECT doc_id, hash(list_sort(list(s))) AS z FROM sh GROUP BY doc_id), m AS (SELECT t.doc_id, count(*) OVER (PARTITION BY z) - 1 AS copies FROM t LEFT JOIN q USING (doc_id))
SELECT doc_id, class_id::BIGINT AS class_id, coalesce(links, 0)::BIGINT AS n_links, copies::BIGINT AS n_copies FROM c LEFT JOIN k USING (doc_id) JOIN m USING (doc_id)"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
c AS (SELECT lang, row, unnest(x) AS piece, unnest(range(0, len(x))) AS no FROM (SELECT lang, row, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS x FROM t)),
w AS (SELECT lang, row, no, unnest(x) AS w, unnest(range(0, len(x))) AS pos FROM (SELECT lang, row, no, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda v: v <> '') AS x FROM c)),
g AS (SELECT lang, w, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY row, no ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f AS (SELECT lang, [w] AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10 UNION ALL SELECT lang, [w, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, [w, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
k AS (SELECT f.lang, f.ws, f.f AS a, unnest(range(1, len(f.ws))) AS cut FROM f WHERE len(f.ws) > 1),
s AS (SELECT k.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN f l ON l.lang = k.lang AND l.ws = k.ws[:cut] JOIN f r ON r.lang = k.lang AND r.ws = k.ws[cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
d AS (SELECT lang, x AS ws, max(f) AS f FROM (SELECT lang, f, unnest([ws[:2], ws[2:]]) AS x FROM f WHERE len(ws) = 3) GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN d ON d.lang = b.lang AND d.ws = b.ws WHERE d.f IS NULL OR 100 * d.f < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM o JOIN n USING (lang) QUALIFY rank <= 2000"""
