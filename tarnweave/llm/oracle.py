"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from tarnweave.llm import quality, substring, suffix

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHARE = {
    "symbols": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
    "marks": "CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END",
    "lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    "repeats": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
    "length": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
}
_RULES = " UNION ALL ".join(f"SELECT '{rule}' AS rule, unnest([{', '.join(f'{c}::DOUBLE' for c in cuts)}]) AS cutoff" for rule, cuts in quality.RULES.items())
_W = quality.WINDOW

QUALITY = f"""
WITH tok AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, list_slice(w, i, i + {_W - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {_W - 2})) AS i FROM tok)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n
  FROM (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range({_W})) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM tok),
base AS (
  SELECT tok.doc_id, lang, len(w)::BIGINT AS n_words, len(list_aggregate(w, 'string_agg', ''))::BIGINT AS chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM tok JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
feats AS (
  SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
vals AS (
  SELECT doc_id, lang, {", ".join(f"({v})::DOUBLE AS {k}" for k, v in _SHARE.items())} FROM feats),
long AS (
  SELECT doc_id, lang, rule, CASE rule {" ".join(f"WHEN '{k}' THEN {k}" for k in _SHARE)} END AS v FROM vals, (SELECT unnest({list(quality.RULES)}) AS rule)),
curve AS (
  SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND v > cutoff) AS lost,
         count(*) FILTER (quality <> 1 AND v > cutoff) AS caught
  FROM long JOIN ({_RULES}) USING (rule) JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
p AS (
  SELECT *, CASE WHEN lost >= n * {quality.RISK / len(quality.RULES)!r} THEN 1 ELSE list_sum(list_transform(range(lost + 1), lambda i:
           exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({quality.RISK / len(quality.RULES)!r}) + (n - i) * ln(1 - {quality.RISK / len(quality.RULES)!r})))) END
         <= {quality.LEVEL!r} / ({len(quality.RULES)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM curve))) AS passes
  FROM curve),
best AS (
  SELECT lang, rule, cutoff FROM (SELECT *, bool_and(passes) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS safe FROM p) WHERE safe
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - {quality.LOSS} * lost DESC, cutoff DESC) = 1),
dropped AS (
  SELECT DISTINCT doc_id FROM long JOIN best ON long.rule = best.rule AND long.lang IS NOT DISTINCT FROM best.lang AND v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM dropped) AS kept
FROM feats"""

SUBSTRING = f"""
WITH tok AS (
  SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + {substring.WIDTH - 1}), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WIDTH - 2})) AS i FROM tok)),
hits AS (
  SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hits, (SELECT unnest(range({substring.WIDTH})) AS k)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM tok) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM tok LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*)::BIGINT AS n FROM gone GROUP BY doc_id) USING (doc_id)"""

SUFFIX = f"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (
  SELECT doc_id, j, substr(h, 2 * j + 1, 2 * (200 + {suffix.WIDTH - 1})) AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {suffix.WIDTH - 1}, 200)) AS j FROM b)),
starts AS (
  SELECT doc_id, j + k AS i, substr(c, 2 * k + 1, {2 * suffix.WIDTH}) AS g FROM (SELECT doc_id, j, c, unnest(range(length(c) // 2 - {suffix.WIDTH - 1})) AS k FROM chunks)),
hits AS (
  SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + {suffix.WIDTH} AS z
  FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r
        FROM (SELECT doc_id, i, (coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 1000000) > {suffix.WIDTH})::INT AS new FROM hits))
  GROUP BY doc_id, r),
pieces AS (
  SELECT doc_id, n_spans, n_removed, list_transform(range(0, len(a) + 1), lambda k:
           substr(h, 1 + 2 * (CASE WHEN k = 0 THEN 0 ELSE z[k] END), 2 * ((CASE WHEN k = len(a) THEN length(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE z[k] END)))) AS kept
  FROM b JOIN (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, count(*)::BIGINT AS n_spans, sum(z - a)::BIGINT AS n_removed FROM runs GROUP BY doc_id) USING (doc_id))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE array_to_string(kept, '') END)) AS kept_sha256
FROM b LEFT JOIN pieces USING (doc_id)"""

EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(least(first, e.vec_id), e.vec_id) AS component_id, coalesce(least(first, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*)::BIGINT AS n FROM links GROUP BY a) n ON e.vec_id = n.a
LEFT JOIN (SELECT a, min(b) AS first FROM reach GROUP BY a) r ON e.vec_id = r.a"""

_PLAIN_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH tok AS (
  SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
items AS (
  SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tok, (SELECT DISTINCT k FROM items))),
found AS (
  SELECT doc_id, d.k, i, item_id FROM doc_windows d JOIN item_windows t ON d.k = t.k AND d.g = t.g),
hit AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

FILL_IN_MIDDLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
cut AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS x FROM drawn),
formed AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT *, array_to_string(list_slice(w, 1, a), '') AS prefix, array_to_string(list_slice(w, a + 1, b), '') AS middle, array_to_string(list_slice(w, b + 1, n), '') AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""

NEGATIVES = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

ORACLE_SQL = {"op4_quality_rules": QUALITY, "op6_substring_dedup": SUBSTRING, "op8_suffix_array": SUFFIX, "op10_embedding_dedup": EMBEDDINGS, "op11_decontamination": DECONTAMINATION, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_hard_negatives": NEGATIVES}
