"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import exact_dedup, infill, mixing, source_audit

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS.format("text")})::BIGINT AS size,
         (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(text), 'null')), 1, 13))::BIGINT + 0.5) / {1 << 52} AS u
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
capped AS (SELECT *, (place % 3 + 1)::DOUBLE AS weight, {mixing.MAX_REPEATS}.0::DOUBLE * source_size AS cap FROM totals),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM capped WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, source_size / n AS mean, least(cap, coalesce((SELECT level FROM leveled WHERE cap >= level * weight ORDER BY cap / weight, place LIMIT 1), 'inf'::DOUBLE) * weight)::DOUBLE AS target FROM leveled),
ratios AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
plans AS (SELECT *, floor(ratio + 1e-12) AS certain, greatest(0, ratio - floor(ratio + 1e-12)) AS p FROM ratios),
odds AS (
  SELECT s.*, p.source_size, p.target, p.certain, p.p,
         CASE WHEN p.p > 0 AND s.size > 0 THEN u / (1 - u) / (p.p / (1 - p.p) * (s.size / p.mean)) END AS odds
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source),
ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS reach
  FROM odds)
SELECT doc_id, size, source_size, target,
       size * least({mixing.MAX_REPEATS}, certain + CASE WHEN odds IS NOT NULL AND reach <= p * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM ranked
"""

_FOLDED = f"translate(coalesce({{0}}, ''), '{exact_dedup.UPPER}', '{exact_dedup.UPPER.lower()}')"

COPIES = f"""
WITH hashed AS (SELECT doc_id, sha256({_FOLDED.format("text")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""

INFILL = f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('{infill.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
drawn AS (
  SELECT *, ('0x' || digest[1:8])::BIGINT % (n + 1) AS h1, ('0x' || digest[9:16])::BIGINT % (n + 1) AS h2, ('0x' || digest[17:24])::BIGINT % 100 AS h3, ('0x' || digest[25:32])::BIGINT % 100 AS h4 FROM given),
formed AS (
  SELECT doc_id, text, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= {100 - infill.PLAIN_PERCENT} THEN 'plain' WHEN h4 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

AUDIT = rf"""
WITH given AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLDED.format("text")} AS text FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {source_audit.MIN_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM given),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT g.lang, g.source, v, coalesce(sum(n), 0) AS total FROM groups g JOIN langs USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + {source_audit.SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (t.total + v)::HUGEINT)::HUGEINT AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
whole AS (SELECT lang, term, (1 + {source_audit.SCALE}::HUGEINT * (n + 1) // (total + v)::HUGEINT)::HUGEINT AS q FROM kept JOIN langs USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {source_audit.TOP_TERMS}
"""
