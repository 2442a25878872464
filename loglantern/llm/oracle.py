"""What SQL can express of the queries, over the given tables and whole texts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# The least id that links reach, from pairs in both directions.
REACHED = """
reached AS (
  SELECT id, id AS other FROM nodes
  UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

VECTOR_LINKS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings),{REACHED}
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN least ON id = e.vec_id"""

PASSAGES = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS words FROM places),
twice AS (SELECT words FROM windows GROUP BY words HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(generate_series(0, 34)) AS k FROM windows SEMI JOIN twice USING (words))),
each AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept_text FROM each e ANTI JOIN gone USING (doc_id, i) GROUP BY e.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

HOST_RULES = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w),
threes AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM starts),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM threes WHERE n > 1)),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS rows, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM judged GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS noise FROM hosts),
prior AS (
  SELECT m, CASE WHEN v - m * (1 - m) * noise > 0 AND m > 0 AND m < 1
    THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * noise) - 1, 2), 10000) ELSE 10000 END AS strength FROM moments),
verdicts AS (SELECT source, (f + m * strength) / (n + strength) > 0.5 AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(rows) - len(list_distinct(rows)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  host_rejected, NOT base_failed AND NOT host_rejected AS kept
FROM judged j JOIN verdicts v ON v.source IS NOT DISTINCT FROM j.source"""

NEAR_DUPS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
pairs AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM w),
shingles AS (
  SELECT DISTINCT doc_id, ws[i] AS x, ws[i + 1] AS y FROM pairs UNION ALL SELECT doc_id, ws[1], NULL FROM w WHERE len(ws) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS n FROM shingles s JOIN shingles t ON s.x = t.x AND s.y IS NOT DISTINCT FROM t.y AND s.doc_id < t.doc_id
  GROUP BY 1, 2),
near AS (SELECT a, b FROM common p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
nodes AS (SELECT doc_id AS id FROM documents),{REACHED}
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM w JOIN least ON id = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id"""

EXACT_DUPS = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept, text_sha256
FROM d"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SEARCH = f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
docs AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
sizes AS (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) GROUP BY 1, 2),
rare AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term, docs),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // l)))) AS part
  FROM counts JOIN sizes USING (doc_id) JOIN rare USING (term), total),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ordered WHERE place <= 50"""

HARD_NEGATIVES = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
best AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE label = own),
inside AS (
  SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM best JOIN scored s USING (anchor_id)
  WHERE nth <= 5 AND label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM inside WHERE place <= 10"""

ORACLE = {
    "op3_vector_links": VECTOR_LINKS,
    "op4_passages": PASSAGES,
    "op5_host_rules": HOST_RULES,
    "op10_near_dups": NEAR_DUPS,
    "op11_exact_dups": EXACT_DUPS,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_hard_negatives": HARD_NEGATIVES,
}
