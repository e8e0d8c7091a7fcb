"""The queries of this subpackage as SQL over the given tables, where SQL can express them."""

from __future__ import annotations

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{TERMS}')"


LINKED_VECTORS = """
WITH RECURSIVE
u AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN lowest w ON e.vec_id = w.a LEFT JOIN counts c ON e.vec_id = c.a
"""

RANKED_SEARCH = f"""
WITH
d AS MATERIALIZED (SELECT doc_id, {_terms("text")} AS t FROM documents),
total AS MATERIALIZED (SELECT count(*) AS docs, sum(len(t))::BIGINT AS occurrences FROM d WHERE len(t) > 0),
q AS MATERIALIZED (SELECT item_id, unnest(list_distinct({_terms("text")})) AS term FROM benchmark),
own AS MATERIALIZED (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM own
    WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
weight AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tf, total GROUP BY term, docs),
score AS (SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // occurrences))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 50
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and replacement, one after the other."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(p.s) AS s,
        min({entries} * list_sum(list_transform(range(1, w + 1), lambda i: (p.s[i] - b.s[i]) * (p.s[i] - b.s[i])))::BIGINT + entry) AS k
    FROM p JOIN b{r} b USING (part), width GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""
n{r} AS (SELECT part, k % {entries} AS entry, i, sum(s[i])::BIGINT AS total, count(*) AS n
    FROM a{r}, width, range(1, 1000) t(i) WHERE i <= w GROUP BY 1, 2, 3),
m{r} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY i) AS s FROM n{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM b{r} b
    LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q
    FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
width AS MATERIALIZED (SELECT max(len(q)) // {parts} AS w FROM v),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(q, part * w + 1, part * w + w) AS s FROM v, width, range({parts}) t(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, s FROM p JOIN firsts USING (vec_id)),
{",".join(steps)},
coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', k % {entries}), '' ORDER BY part) AS code,
        sum(k // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
flat AS (SELECT part, entry, i, s[i] AS x FROM b{rounds}, width, range(1, 1000) t(i) WHERE i <= w),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM flat),
labels_ AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN coded USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM v JOIN coded USING (vec_id) JOIN labels_ l ON v.label IS NOT DISTINCT FROM l.label, books
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_neighbour_graph": LINKED_VECTORS,
        "op12_ranked_search": RANKED_SEARCH,
        "op13_vector_codes": _vector_codes(),
    }
