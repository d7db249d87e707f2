"""SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from .licenses import BASE, MORE

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP1 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM h WHERE length(x) >= 200),
w AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS k FROM s),
f AS (SELECT k, min(struct_pack(d := doc_id, p := p)) AS f FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.k = w.k WHERE struct_pack(d := w.doc_id, p := w.p) <> f.f),
g AS (SELECT doc_id, unnest(range(p, p + 100)) AS b FROM r), c AS MATERIALIZED (SELECT DISTINCT doc_id, b FROM g),
l AS (SELECT doc_id, b - lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS gap FROM c),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (gap IS NULL OR gap > 1) AS n_spans FROM l GROUP BY doc_id),
b AS (SELECT h.doc_id, unnest(range(0, length(x) // 2)) AS b, h.x FROM h WHERE doc_id IN (SELECT doc_id FROM c)),
k AS (SELECT b.doc_id, coalesce(string_agg(substr(b.x, 2 * b.b + 1, 2), '' ORDER BY b.b) FILTER (c.b IS NULL), '') AS kept FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.b = b.b GROUP BY b.doc_id)
SELECT h.doc_id, length(h.x) // 2 AS n_bytes, coalesce(n.n_removed, 0) AS n_removed, coalesce(n.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, h.x))) AS kept_sha256
FROM h LEFT JOIN n ON n.doc_id = h.doc_id LEFT JOIN k ON k.doc_id = h.doc_id"""


def _op3() -> str:
    def places(t) -> str:
        n, m = len(t.key), len(t.words)
        key = " AND ".join(f"w[s + {k + 1}] = '{x}'" for k, x in enumerate(t.key))
        there = " + ".join(f"CAST(s - {t.at} + {k} >= 0 AND coalesce(w[s - {t.at} + {k + 1}] = '{x}', false) AS INT)" for k, x in enumerate(t.words))
        return f"SELECT doc_id, '{t.label}' AS label, {str(t.base).lower()} AS base, s, ({there}) / CAST({m} AS DOUBLE) AS coverage FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS s FROM d WHERE len(w) >= {n} AND list_contains(w, '{t.key[0]}') AND list_contains(w, '{t.key[-1]}')) WHERE {key}"

    found = "\nUNION ALL ".join(places(t) for t in BASE + MORE)
    return f"""WITH d AS (SELECT doc_id, {_FOLDED.format('text')} AS w FROM documents), f AS ({found}),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""


OP4 = f"""WITH d AS (SELECT doc_id, {_FOLDED.format('text')} AS w FROM documents), i AS (SELECT item_id, {_FOLDED.format('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p), x AS (SELECT doc_id, n, unnest(range(0, len(w) - n + 1)) AS s, w FROM d, n WHERE len(w) >= n), y AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM x),
h AS (SELECT y.doc_id, y.s, y.n, p.item_id FROM y JOIN p ON p.n = y.n AND p.k = y.k),
c AS (SELECT doc_id, count(DISTINCT b) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS b FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP5 = f"""WITH d AS (SELECT doc_id, source, coalesce(len({_SPACED.format('text')}), 0) AS size, CAST('0x' || left(md5('17:' || CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS no FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, no) FROM l WHERE cap / w > lev), 'inf'::DOUBLE) * w) AS target FROM l),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
x AS (SELECT d.*, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x"""

OP6 = f"""WITH d AS (SELECT doc_id, coalesce({_SPACED.format('text')}, []) AS w FROM documents),
x AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS s FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS f FROM x GROUP BY k), r AS (SELECT x.doc_id, x.s FROM x JOIN f ON f.k = x.k WHERE f.f < x.doc_id),
c AS (SELECT DISTINCT doc_id, b FROM (SELECT doc_id, unnest(range(s, s + 13)) AS b FROM r)), n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM n)),
k AS (SELECT u.doc_id, coalesce(string_agg(u.t, ' ' ORDER BY u.b) FILTER (c.b IS NULL), '') AS kept FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.b = u.b GROUP BY u.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.kept, array_to_string(w, ' '))) AS kept_sha256 FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWER.format('text'))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.i >= 85 * (x.n + y.n - i.i)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id"""

OP10 = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE r.root < l.b), c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id"""

SQL = {
    "op1_suffix_array_dedup": OP1,
    "op3_license_scans": _op3(),
    "op4_benchmark_decontamination": OP4,
    "op5_source_mix": OP5,
    "op6_substring_dedup": OP6,
    "op8_minhash_near_dedup": OP8,
    "op10_embedding_near_dedup": OP10,
}
