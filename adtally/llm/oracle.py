"""The results of this package's exact operators in plain SQL, for another engine to check them by."""

from __future__ import annotations

import string

_WORDS = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"



def _clusters(rounds: int) -> str:
    """Integer k-means by all distances, one round after another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{r} m USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, CAST(min(c) AS INTEGER) AS c, CAST(min(d) AS BIGINT) AS d
    FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS least FROM d{r}) WHERE d = least GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL),
m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
    FROM m{r} m LEFT JOIN s{r} s ON m.c = s.c AND m.i = s.i)""")
    return ",\n".join(steps)


# The CRC of every n-gram's bytes, byte by byte over a table made from the polynomial.
_CRCS = """t AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS b
    FROM range(256) r(i)),
x AS MATERIALIZED (
    SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
           lambda c, e: xor(c >> 8, b[(xor(c, e) & 255) + 1]))) % 10000 AS b
    FROM (SELECT DISTINCT g, hex(encode(g)) AS h FROM f), t)"""

ORACLE: dict[str, str] = {
    "op6_metric_tree": """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_ngram_join": rf"""WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_WORDS}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_ptolemaic_clusters": f"""WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS i FROM e),
b AS (SELECT vec_id, row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS c FROM e),
m0 AS MATERIALIZED (SELECT c, i, x FROM b JOIN v USING (vec_id) WHERE c < 16),
{_clusters(3)},
h AS (SELECT CAST(c AS INTEGER) AS c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM m3 GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN h USING (c)""",
    "op12_importance_resampling": rf"""WITH w AS MATERIALIZED (
    SELECT k, id, list_filter(regexp_split_to_array({_WORDS}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark)),
f AS MATERIALIZED (
    SELECT k, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w),
{_CRCS},
n AS (SELECT b, count(*) FILTER (k = 'd') AS s, count(*) FILTER (k = 'q') AS t FROM f JOIN x USING (g) GROUP BY b),
z AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM n),
y AS (SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (s_all + 10000) / (CAST(s + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain FROM n, z),
u AS (SELECT id, sum(gain) AS total, count(*) AS n FROM f JOIN x USING (g) JOIN y USING (b) WHERE k = 'd' GROUP BY id),
r AS (
    SELECT id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
           CAST(CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS BIGINT) AS weight,
           CAST('0x' || sha256(concat('7:', id))[1:8] AS BIGINT) AS h
    FROM w LEFT JOIN u USING (id) WHERE k = 'd'),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
             25 * (count(*) FILTER (words >= 20) OVER ()) // 100 AS drawn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM p""",
}
