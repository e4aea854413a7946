"""DuckDB SQL for the queries that SQL can express."""

DECONTAMINATION = r"""
WITH item AS (
  SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), run AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS run FROM item WHERE len(w) > 0
), word AS (
  SELECT doc_id, row_number() OVER () AS row_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), size AS (
  SELECT DISTINCT len(run) AS n FROM run
), gram AS (
  SELECT row_id, n, unnest(range(1, len(w) - n + 2)) AS spot, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS run FROM word, size WHERE len(w) >= n
), hit AS (
  SELECT DISTINCT row_id, spot, n, run FROM gram SEMI JOIN run USING (run)
), covered AS (
  SELECT row_id, count(DISTINCT spot + k) AS n_hit FROM (SELECT row_id, spot, unnest(range(n)) AS k FROM hit) GROUP BY row_id
), named AS (
  SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit JOIN run USING (run) GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN covered USING (row_id) LEFT JOIN named USING (row_id)
"""

_SPANS = r"""
  SELECT row_id, '{kind}' AS kind, {ord} AS ord, m[i] AS hit, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT row_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT row_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM doc WHERE regexp_matches(t, '{pattern}')))
"""
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.8, "mail|contact|write|kontakt|correo|courriel"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0.6, r"\bip\b|addr|host|server|login"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", 0.7, "card|visa|master|credit|karte|carte|tarjeta"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, r"phone|call|\btel|mobile|fax"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b", 0.8, "iban|account|bank|konto|compte|cuenta"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, r"\bssn\b|social|security|taxpayer"),
)
_VALID = r"""CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS BIGINT), 0) > 255)) = 0
  WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[-i]::INT WHEN d[-i]::INT > 4 THEN 2 * d[-i]::INT - 9 ELSE 2 * d[-i]::INT END)) % 10 = 0
  WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
  WHEN 'iban' THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(hit, ' ', '')[5:] || hit[:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1
  ELSE NOT regexp_matches(hit, '^(000|666|9..)|-00-|-0000$') AND NOT regexp_matches(t[s:s], '[0-9-]') AND NOT regexp_matches(t[s + length(hit) + 1:s + length(hit) + 1], '[0-9-]') END"""
PII = (
    "WITH doc AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents), raw AS ("
    + " UNION ALL ".join(_SPANS.format(kind=k, ord=i, pattern=p) for i, (k, p, _, _) in enumerate(_KINDS))
    + "), sure AS (SELECT *, lower(t[greatest(1, s - 39):s] || ' ' || t[s + length(hit) + 1:s + length(hit) + 20]) AS near FROM (SELECT raw.*, t, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM raw JOIN doc USING (row_id)) WHERE "
    + _VALID
    + "), span AS (SELECT row_id, kind, ord, s, s + length(hit) AS e, CASE kind "
    + " ".join(f"WHEN '{k}' THEN round(CASE WHEN regexp_matches(near, '{w}') THEN least(1.0, {sc} + 0.2) ELSE {sc} END, 2)" for k, _, sc, w in _KINDS)
    + " END AS score FROM sure) SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in _KINDS)
    + """, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s), '') AS spans,
  coalesce(string_agg(printf('%.2f', score::DOUBLE), ',' ORDER BY ord, s), '') AS scores
FROM doc LEFT JOIN (SELECT * FROM span WHERE ord < 4 OR score >= 0.5) USING (row_id) GROUP BY doc_id, row_id"""
)

MIXING = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n, md5(coalesce(text, '')) AS digest FROM documents
), total AS (
  SELECT source, sum(n)::BIGINT AS tokens FROM doc GROUP BY source HAVING sum(n) > 0
), list AS (
  SELECT list(tokens::DOUBLE) AS t, sum(tokens)::DOUBLE AS whole, count(*) AS sources FROM total
), goal AS (
  SELECT t, whole, CASE WHEN sources < 2 THEN NULL ELSE h + 0.5 * (ln(sources) - h) END AS target
  FROM (SELECT *, -list_sum(list_transform(t, lambda x: x / whole * ln(x / whole))) AS h FROM list)
), step AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.0::DOUBLE AS low2, 1.0::DOUBLE AS high2
  UNION ALL
  SELECT i + 1, CASE WHEN even THEN low ELSE mid END, CASE WHEN even THEN mid ELSE high END, CASE WHEN few THEN low2 ELSE mid2 END, CASE WHEN few THEN mid2 ELSE high2 END
  FROM (
    SELECT i, low, high, low2, high2, (low + high) / 2 AS mid, (low2 + high2) / 2 AS mid2,
           ln(list_sum(list_transform(t, lambda x: pow(x / whole, (low + high) / 2))))
             - list_sum(list_transform(t, lambda x: pow(x / whole, (low + high) / 2) * ln(pow(x / whole, (low + high) / 2)))) / list_sum(list_transform(t, lambda x: pow(x / whole, (low + high) / 2))) <= target AS even,
           list_max(list_transform(t, lambda x: pow(x / whole, (low2 + high2) / 2) / x)) / list_min(list_transform(t, lambda x: pow(x / whole, (low2 + high2) / 2) / x)) <= 2.0 AS few
    FROM step, goal WHERE i < 20)
), alpha AS (
  SELECT CASE WHEN (SELECT target FROM goal) IS NULL THEN 1.0 ELSE round(greatest(high, high2), 6) END AS a FROM step WHERE i = 20
), sums AS (
  SELECT sum(pow(tokens / whole, a)) AS z, max(tokens / pow(tokens / whole, a)) AS cover FROM total, list, alpha
), plan AS (
  SELECT source, tokens, budget, ceil(budget / 200000)::BIGINT AS blocks, greatest(tokens, floor(round(pow(tokens / whole, a) / z * budget, 3))::BIGINT) AS share
  FROM total, list, alpha, (SELECT z, ceil(round(z * cover, 3)) AS budget FROM sums)
), placed AS (
  SELECT doc.*, tokens, share, blocks, coalesce(sum(n) OVER (PARTITION BY source ORDER BY md5('2025|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM doc JOIN plan USING (source)
), drawn AS (
  SELECT *, unnest(range(greatest(0, floor((share - 1 - before) / tokens)::BIGINT) + 1)) AS copy FROM placed
), blocked AS (
  SELECT *, least(floor((copy * tokens + before) / share * blocks::DOUBLE)::BIGINT, blocks - 1) AS block FROM drawn
)
SELECT doc_id, source, n AS n_tokens, copy::INT AS copy, block,
       row_number() OVER (PARTITION BY block ORDER BY md5('2025|' || block || '|' || copy || '|' || coalesce(doc_id::VARCHAR, '') || '|' || digest)) - 1 AS slot
FROM blocked
"""

JACCARD = r"""
WITH RECURSIVE word AS (
  SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), held AS (
  SELECT row_id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM word
), gram AS (
  SELECT row_id, len(s) AS n, unnest(s) AS g FROM held
), numbered AS (
  SELECT row_id, n, g, count(*) OVER (PARTITION BY g) AS df FROM gram
), prefix AS (
  SELECT row_id, n, g FROM numbered QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY df, g) <= n - ceil(0.9 * n) + 1
), pair AS (
  SELECT DISTINCT a.row_id AS a, b.row_id AS b, a.n AS an, b.n AS bn FROM prefix a JOIN prefix b ON a.g = b.g AND a.row_id < b.row_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
), link AS (
  SELECT a, b FROM (SELECT pair.a, pair.b, an, bn, len(list_intersect(x.s, y.s)) AS k FROM pair JOIN held x ON x.row_id = pair.a JOIN held y ON y.row_id = pair.b) WHERE 100 * k >= 90 * (an + bn - k)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT row_id AS a, row_id AS b FROM held UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
)
SELECT h.doc_id, len(h.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN held h ON h.row_id = reach.a JOIN held o ON o.row_id = reach.b GROUP BY h.row_id, h.doc_id, h.s
"""


FILL = """
with hashed as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
parts as (
    select doc_id, t, length(t) as n, cast('0x' || d[1:8] as bigint) as h1, cast('0x' || d[9:16] as bigint) as h2, cast('0x' || d[17:24] as bigint) as h3, cast('0x' || d[25:32] as bigint) as h4
    from hashed),
cut as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
    from parts),
made as (
    select *, case form when 'plain' then t
        when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end as made_text
    from cut)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
    sha256(made_text) as output_sha256, sha256(t) as restored_sha256
from made
"""
