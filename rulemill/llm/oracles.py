"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op4_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
         / CASE WHEN length(text) > 0 THEN greatest(length(translate(text, '#$%&*!|', ''))::DOUBLE / length(text), 0.05::DOUBLE) ELSE 1.0::DOUBLE END AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT source, source_size, list_extract([5, 2, 1], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT) AS w FROM sizes),
filled AS (SELECT *, 2.0::DOUBLE * source_size / w AS fills FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY fills, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM filled),
held AS (SELECT min_by(level, fills) AS level FROM levels WHERE level <= fills),
targets AS (
  SELECT source, source_size, coalesce(least(w * held.level, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM levels LEFT JOIN held ON true),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
prefixed AS (
  SELECT rows.*, q.source_size, q.target, q.epochs, floor(q.target)::BIGINT - q.epochs * q.source_size AS quota,
         coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows JOIN quotas q ON rows.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, quota - before)))::BIGINT AS taken FROM prefixed
""",
    # Five hex digits of a digest are four letters.
    "op5_warc": r"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
told AS (SELECT page_id, body, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM bodies),
parts AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT) AS words FROM told)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, list_reduce(list_transform(words, lambda w: substr(letters, w // 32768 + 1, 1) || substr(letters, w // 1024 % 32 + 1, 1) || substr(letters, w // 32 % 32 + 1, 1) || substr(letters, w % 32 + 1, 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to
FROM parts CROSS JOIN (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters)
""",
    "op7_url_filters": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
rules(verdict, r_host, r_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hits AS (
  SELECT page_id, max_by(r_host || r_path, length(r_host) * 100 + length(r_path)) AS rule, max_by(verdict, length(r_host) * 100 + length(r_path)) AS verdict
  FROM split JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT split.page_id, host, path, rule, coalesce(hits.verdict, 'allow') AS verdict FROM split LEFT JOIN hits USING (page_id)
""",
    "op9_decontamination": r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS win
  FROM item_words WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM doc_words, lengths WHERE len(w) >= n),
met AS (SELECT r, i, doc_windows.n, item_id FROM doc_windows JOIN item_windows ON doc_windows.win = item_windows.win AND doc_windows.n = item_windows.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
    "op12_collocations": r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM lowered),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2 AS k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM words WHERE len(w) >= 2
  UNION ALL SELECT lang, 3 AS k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM words WHERE len(w) >= 3),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
cuts AS (
  SELECT lang, k, phrase, a, w[1] AS one, array_to_string(w[2:], ' ') AS two, 1 AS c FROM parts
  UNION ALL SELECT lang, k, phrase, a, w[1] || ' ' || w[2] AS one, w[3] AS two, 2 AS c FROM parts WHERE k = 3),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, x.a AS l, y.a AS r, c, (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = one AND x.k = c JOIN f y ON y.lang = cuts.lang AND y.phrase = two AND y.k = cuts.k - c),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) = 1),
around AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM parts WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3] AS phrase, a FROM parts WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN around ON worst.k = 2 AND around.lang = worst.lang AND around.phrase = worst.phrase WHERE around.a IS NULL OR 100 * around.a < 50 * worst.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""".replace("\\\\", "\\"),
    "op13_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""",
}
