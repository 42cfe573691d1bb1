"""SQL counterparts of the queries that SQL can express; texts are compared whole."""

from __future__ import annotations

ORACLES_LLM = {}

ORACLES_LLM["op3_mix_sources"] = r"""
WITH sized AS (
    SELECT doc_id, source,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
           md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM documents
),
sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
),
weighted AS (
    SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
           CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
    FROM sizes
),
filling AS (
    SELECT *, row_number() OVER w AS step,
           CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
           sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
    FROM weighted WINDOW w AS (ORDER BY most / weight, source NULLS LAST)
),
rest AS (
    SELECT left_over, weight_left, step FROM filling
    WHERE left_over * weight / weight_left < most ORDER BY step LIMIT 1
),
targets AS (
    SELECT f.source, f.source_size,
           CASE WHEN r.step IS NULL OR f.step < r.step THEN f.most
                ELSE r.left_over * f.weight / r.weight_left END AS target
    FROM filling f LEFT JOIN rest r ON true
),
placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size
                 + greatest(0, least(size, budget % source_size - earlier)) END AS BIGINT) AS taken
FROM placed
"""

ORACLES_LLM["op7_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_FIVE_HEX = "CAST('0x' || substr(h, {start}, 5) AS BIGINT)"
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({_FIVE_HEX.format(start=1 + 5 * group)} >> {shift}) & 31 AS INT) + 1, 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)

ORACLES_LLM["op10_warc"] = f"""
WITH hashed AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM hashed
"""

ORACLES_LLM["op5_near_dedup"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingle
    FROM worded
),
counts AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM common JOIN counts x ON x.doc_id = a JOIN counts y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
    SELECT doc_id AS node, doc_id AS seen FROM documents
    UNION
    SELECT r.node, s.b FROM reached r JOIN sides s ON s.a = r.seen
),
parts AS (SELECT node, min(seen) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, p.component_id, d.doc_id = p.component_id AS kept
FROM documents d LEFT JOIN counts c USING (doc_id) JOIN parts p ON p.node = d.doc_id
"""

ORACLES_LLM["op8_embedding_dedup"] = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
),
usable AS (
    SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS length FROM vectors
    WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) / (a.length * b.length) >= 0.93
),
reached AS (
    SELECT vec_id AS node, vec_id AS seen FROM embeddings
    UNION
    SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen
),
parts AS (SELECT node, min(seen) AS component_id FROM reached GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


def _lloyd_round(number: int) -> str:
    """Assignment to the centroids of a round, and the centroids of the next."""
    return f"""
a{number} AS MATERIALIZED (
    SELECT row, cluster, d FROM (
        SELECT k.row, c.cluster, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS d
        FROM kept k CROSS JOIN c{number} c
    ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
),
s{number} AS (
    SELECT cluster, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n
    FROM (SELECT a.cluster, k.v, unnest(range(1, 65)) AS i FROM a{number} a JOIN kept k USING (row)) GROUP BY cluster, i
),
c{number + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{number} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{number} GROUP BY cluster
    ) m USING (cluster)
),"""


ORACLES_LLM["op11_centroid_clusters"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS cluster, v
    FROM kept QUALIFY cluster < 8
),
{"".join(_lloyd_round(number) for number in range(11))}
totals AS (SELECT cluster, sum(d) AS total FROM a10 GROUP BY cluster)
SELECT k.vec_id, CAST(a.cluster AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(t.total AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(d) FROM a10) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a10 a JOIN kept k USING (row) JOIN totals t USING (cluster) JOIN c10 c USING (cluster)
"""

ORACLES_LLM["op12_lexical_search"] = r"""
WITH cut AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
docs AS MATERIALIZED (SELECT row, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
sizes AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
occurring AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM occurring, sizes GROUP BY term
),
items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
wanted AS (
    SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM items
),
scored AS (
    SELECT q.item, q.item_id, d.row, d.doc_id,
           CAST(sum(w.w * ((1000000000 * o.tf) // (1000 * o.tf + 8 * (10 + (90 * d.n * s.n_docs) // s.all_terms)))) AS BIGINT) AS score
    FROM wanted q JOIN weights w USING (term) JOIN occurring o USING (term) JOIN docs d USING (row), sizes s
    GROUP BY ALL
),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS INT) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
