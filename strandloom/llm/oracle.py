"""SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
         WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT a AS v, b AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
low AS (SELECT v, min(r) AS r FROM reach GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(r, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(r, vec_id)) AS kept
FROM v LEFT JOIN counted ON a = vec_id LEFT JOIN low ON low.v = vec_id
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACE.format(_FOLD.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a AS v, b AS r FROM links UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
low AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(r, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN low ON v = w.doc_id
"""

OP6 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_FOLD.format('text'))} AS ws FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM.format(_FOLD.format('text'))} AS ws FROM benchmark),
k AS (SELECT item, ws, least(10, len(ws)) AS k FROM i WHERE len(ws) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS j FROM k)),
x AS (SELECT doc_id, k, j, array_to_string(ws[j:j + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k)),
h AS (SELECT doc_id, j, x.k, item FROM x JOIN g ON x.g = g.g AND x.k = g.k),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

_Q = "((s - ((s % n) + n) % n) // n)"


def _op11(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Assignment and floored means, round after round."""
    steps = ["v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings "
             f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS k, x AS c FROM v QUALIFY k < {k})"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, x, k, d FROM (SELECT rid, vec_id, x, k, list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM v, c{r}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT k, list({_Q} ORDER BY i) AS m FROM (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY k, i) GROUP BY k)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.k = c{r}.k)")
    return f"""
WITH {', '.join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k
"""


OP11 = _op11()


def _op12(min_words: int = 4, percent: int = 30, longest: int = 40) -> str:
    """A repeat of n words is a window of n words that occurs twice in its document."""
    windows = "(SELECT doc_id, {w} AS w, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + {w} - 1], ' ')) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {w} + 2)) AS i FROM {d} WHERE len(ws) >= {w}))"
    of = lambda w, d="d": f"(SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM {windows.format(w=w, d=d)} WHERE n > 1) GROUP BY doc_id)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACE.format("coalesce(text, '')")} AS ws FROM documents),
r5 AS MATERIALIZED {of(5)},
e AS (SELECT d.* FROM d JOIN r5 ON r5.doc_id = d.doc_id WHERE n > {longest}),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
  coalesce(r5.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS r, coalesce(l.n, 0) AS l
  FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN r5 ON r5.doc_id = d.doc_id LEFT JOIN {of(min_words)} rm ON rm.doc_id = d.doc_id LEFT JOIN {of(longest + 1, 'e')} l ON l.doc_id = d.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * r <= {percent} * n_words AND l = 0 AS kept FROM judged
"""


OP12 = _op12()
