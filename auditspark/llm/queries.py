"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name: module of this package that holds the function of that name.
MODULES = {
    "op1_source_mix": "mixing",
    "op2_html_text": "html_text",
    "op3_secret_scan": "secret_scan",
    "op4_decontaminate": "decontaminate",
    "op5_language_id": "langid",
    "op6_substring_dedup": "substring_dedup",
    "op7_license_scan": "licenses",
    "op8_pii": "pii",
    "op9_simhash": "simhash",
    "op10_embedding_dedup": "embedding_dedup",
    "op11_delta_lloyd": "delta_lloyd",
    "op12_phrases": "phrases",
    "op13_exact_top_k": "kd_search",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def _score(a: str, left: str, right: str) -> str:
    return f"1000000::HUGEINT * {a} * {a} // ({left}::HUGEINT * {right})"


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and exact floors of means, unrolled."""
    near = "SELECT vec_id, e, arg_min(j, d * 16 + j) AS j, min(d) AS d FROM (SELECT vec_id, e, j, CAST(list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i]))) AS BIGINT) AS d FROM v CROSS JOIN c{n}) GROUP BY vec_id, e"
    parts = ["""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256(concat('1:', CAST(vec_id AS VARCHAR)))) - 1 AS j, e AS c FROM v ORDER BY j LIMIT 16)"""]
    for n in range(rounds):
        parts.append(f"a{n} AS ({near.format(n=n)})")
        parts.append(f"m{n} AS (SELECT j, list(x ORDER BY i) AS c FROM (SELECT j, i, CAST(floor(sum(e[i]) / count(*)) AS BIGINT) AS x FROM (SELECT j, e, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY j, i) GROUP BY j)")
        parts.append(f"c{n + 1} AS (SELECT c{n}.j, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON m{n}.j = c{n}.j)")
    parts.append(f"f AS ({near.format(n=rounds)})")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(f.j AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} ON c{rounds}.j = f.j"""


SQL = {
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT doc_id, i, m FROM win JOIN least_ USING (k)) CROSS JOIN range(0, 13) AS t(o) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
degree AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN degree ON degree.a = vec_id LEFT JOIN part ON part.a = vec_id""",
    "op11_delta_lloyd": _lloyd(3),
    "op12_phrases": f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(ps), '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
u AS (SELECT lang, unnest(ws) AS w FROM p), f1 AS (SELECT lang, w, count(*) AS n FROM u GROUP BY lang, w), size AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
g2 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p)), f2 AS (SELECT lang, x, y, count(*) AS n FROM g2 GROUP BY lang, x, y),
g3 AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p)), f3 AS (SELECT lang, x, y, z, count(*) AS n FROM g3 GROUP BY lang, x, y, z HAVING count(*) >= 10),
covered AS (SELECT lang, x, y, max(n) AS n FROM (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) GROUP BY lang, x, y),
two AS (SELECT c.lang, concat(c.x, ' ', c.y) AS phrase, c.n AS a, l.n AS l, r.n AS r, {_score("c.n", "l.n", "r.n")} AS score FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w = c.x JOIN f1 r ON r.lang = c.lang AND r.w = c.y LEFT JOIN covered o ON o.lang = c.lang AND o.x = c.x AND o.y = c.y WHERE c.n >= 10 AND (o.n IS NULL OR 100 * o.n < 50 * c.n)),
cut AS (SELECT c.lang, concat(c.x, ' ', c.y, ' ', c.z) AS phrase, c.n AS a, l1.n AS l1, r1.n AS r1, l2.n AS l2, r2.n AS r2, {_score("c.n", "l1.n", "r1.n")} AS s1, {_score("c.n", "l2.n", "r2.n")} AS s2
  FROM f3 c JOIN f1 l1 ON l1.lang = c.lang AND l1.w = c.x JOIN f2 r1 ON r1.lang = c.lang AND r1.x = c.y AND r1.y = c.z JOIN f2 l2 ON l2.lang = c.lang AND l2.x = c.x AND l2.y = c.y JOIN f1 r2 ON r2.lang = c.lang AND r2.w = c.z),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut))
SELECT lang, rank, phrase, a, l, r, size.n AS n, CAST(score AS BIGINT) AS score FROM best JOIN size USING (lang) WHERE rank <= 2000""",
    "op13_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, row_number() OVER () AS row_ FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_ AS query, q.vec_id AS query_id, c.vec_id, c.row_, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.row_ <> c.row_ AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, row_) AS INT) AS rank FROM s) WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    """Hashes, models, trees and seeded orders of the other queries are beyond SQL; tests hold them against brute force."""
    return dict(SQL)
