"""DuckDB SQL of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

OP5 = r"""
WITH hosts AS (
  SELECT DISTINCT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host FROM pages
), h AS (
  SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS h, regexp_replace(host, '^[^.]*[.]', '') AS parent FROM hosts WHERE host <> ''
), e AS (
  SELECT 'spam' AS list, 'block' AS policy, 'host' AS kind, host AS value, 'add' AS action, DATE '2024-01-01' + (h % 200)::INT AS day FROM h WHERE h % 3 = 0
  UNION ALL SELECT 'spam', 'block', 'host', host, 'remove', DATE '2024-01-01' + (h % 200 + 60)::INT FROM h WHERE h % 6 = 0
  UNION ALL SELECT 'spam', 'block', 'host', host, 'add', DATE '2024-01-01' + (h % 200 + 120)::INT FROM h WHERE h % 12 = 0
  UNION ALL SELECT 'networks', 'block', 'domain', parent, 'add', DATE '2024-01-01' + (h % 200 + 30)::INT FROM h WHERE h % 10 = 1
  UNION ALL SELECT 'networks', 'block', 'domain', parent, 'remove', DATE '2024-01-01' + (h % 200 + 90)::INT FROM h WHERE h % 20 = 1
  UNION ALL SELECT 'partners', 'allow', 'prefix', host || '/en', 'add', DATE '2024-01-01' + (h % 200 + 15)::INT FROM h WHERE h % 7 = 0
), daily AS (
  SELECT list, kind, value, day AS since, bool_or(action = 'add') AS is_on, max(policy) AS policy FROM e GROUP BY ALL
), v AS (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, kind, value ORDER BY since) AS until FROM daily) WHERE is_on
), c AS (
  SELECT page_id, url, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetch_day,
         lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host,
         lower(split_part(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/', 2)) AS first_segment
  FROM pages
), m AS (
  SELECT c.page_id, c.url, c.fetch_day, v.* FROM c JOIN v ON c.fetch_day >= v.since AND (v.until IS NULL OR c.fetch_day < v.until)
   AND ((v.kind = 'host' AND v.value = c.host)
     OR (v.kind = 'domain' AND (c.host = v.value OR ends_with(c.host, '.' || v.value)))
     OR (v.kind = 'prefix' AND v.value = c.host || '/' || c.first_segment))
), s AS (
  SELECT page_id, url, fetch_day, bool_or(policy = 'block') AND NOT bool_or(policy = 'allow') AS blocked, count(*) AS matches,
         min(list || ':' || kind || ':' || value) AS rule, min(since) AS since
  FROM m GROUP BY page_id, url, fetch_day
)
SELECT c.page_id, c.url, c.fetch_day, coalesce(s.blocked, false) AS blocked, coalesce(s.matches, 0) AS matches, s.rule, s.since
FROM c LEFT JOIN s USING (page_id, url, fetch_day)
"""

#: The exponent by 30 plain halvings; everything else from the definition of the mix.
OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) + 1 AS tokens,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h,
         coalesce('=' || source, '~') AS src
  FROM documents
), st AS (SELECT src, sum(tokens)::BIGINT AS n FROM d GROUP BY src
), t AS (SELECT count(*) AS k, sum(n)::BIGINT AS total, max(n) AS top, min(n) AS low FROM st
), bis AS (
  SELECT 0 AS i, 0.0::DOUBLE AS elo, 1.0::DOUBLE AS ehi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1,
    CASE WHEN eok THEN (elo + ehi) / 2 ELSE elo END, CASE WHEN eok THEN ehi ELSE (elo + ehi) / 2 END,
    CASE WHEN rok THEN rlo ELSE (rlo + rhi) / 2 END, CASE WHEN rok THEN (rlo + rhi) / 2 ELSE rhi END
  FROM (
    SELECT bis.*,
      (SELECT ln(sum(exp(((elo + ehi) / 2) * ln(n / top)))) - ((elo + ehi) / 2) * sum(exp(((elo + ehi) / 2) * ln(n / top)) * ln(n / top)) / sum(exp(((elo + ehi) / 2) * ln(n / top))) FROM st, t)
        >= (SELECT 0.95 * ln(k) FROM t) AS eok,
      (SELECT max(exp((((rlo + rhi) / 2) - 1) * ln(n / top))) * (max(total) / max(top)) / sum(exp(((rlo + rhi) / 2) * ln(n / top))) FROM st, t) <= 4.0 AS rok
    FROM bis WHERE i < 30)
), ends AS (
  SELECT (SELECT ln(sum(n / top)) - sum(n / top * ln(n / top)) / sum(n / top) FROM st, t) >= (SELECT 0.95 * ln(k) FROM t) AS e1,
         (SELECT ln(count(*)) FROM st) >= (SELECT 0.95 * ln(k) FROM t) AS e0,
         (SELECT max(total) / max(top) / sum(n / top) FROM st, t) <= 4.0 AS r1,
         (SELECT max(top / n) * max(total) / max(top) / count(*) FROM st, t) <= 4.0 AS r0
), a AS (
  SELECT greatest(CASE WHEN e1 THEN 1.0 WHEN NOT e0 THEN 0.0 ELSE elo END, CASE WHEN NOT r1 THEN 1.0 WHEN r0 THEN 0.0 ELSE rhi END) AS alpha
  FROM bis, ends WHERE i = 30
), w AS (
  SELECT src, n, exp(alpha * ln(n / top)) / (SELECT sum(exp(alpha * ln(n / top))) FROM st, t, a) AS weight, total FROM st, t, a
), q AS (SELECT src, n, weight, round(total * weight)::BIGINT AS quota, greatest(1, ceil(n / 1048576))::BIGINT AS blocks FROM w
), r AS (SELECT *, quota // n AS whole, quota - (quota // n) * n AS rest FROM q
), b AS (SELECT d.src, d.h % r.blocks AS block, sum(tokens)::BIGINT AS block_tokens FROM d JOIN r USING (src) GROUP BY ALL
), e AS (
  SELECT b.*, r.n, r.weight, r.quota, r.whole, r.rest, g.epoch FROM b JOIN r USING (src), LATERAL (SELECT unnest(range(0, r.whole + 1)) AS epoch) g
  WHERE g.epoch < r.whole OR r.rest > 0
), p AS (
  SELECT *, coalesce(sum(block_tokens) OVER (PARTITION BY src, epoch
     ORDER BY ('0x' || substr(md5('17:' || epoch || ':' || src || ':' || block), 1, 15))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e
), k AS (
  SELECT d.doc_id, d.source, d.tokens, p.*,
         ('0x' || substr(md5('17:' || p.epoch || ':' || d.h), 1, 15))::BIGINT AS eh
  FROM d JOIN r USING (src) JOIN p ON p.src = d.src AND p.block = d.h % r.blocks
  WHERE p.epoch < p.whole OR p.before < p.rest
), z AS (
  SELECT *, before + coalesce(sum(tokens) OVER (PARTITION BY src, epoch, block ORDER BY eh RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
            - sum(tokens) OVER (PARTITION BY src, epoch, block, eh) AS run FROM k
)
SELECT doc_id, source, tokens::BIGINT AS tokens, epoch, block, round((epoch * n + before) / quota, 9) AS position, round(weight, 9) AS weight
FROM z WHERE epoch < whole OR before + block_tokens <= rest OR run < rest
"""



def _op12(rounds: int = 4) -> str:
    """Every part compared with every entry, round by round."""
    ctes = ["""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comp AS MATERIALIZED (
  SELECT vec_id, ((i - 1) // (len(v) // 4))::INT AS part, ((i - 1) % (len(v) // 4))::INT AS place, v[i] AS x
  FROM kept, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)
), b0 AS MATERIALIZED (
  SELECT part, entry, place, x FROM comp JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < 256
)"""]
    for k in range(rounds + 1):
        ctes.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM comp c JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY ALL
)""")
        if k < rounds:
            ctes.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.x)::BIGINT AS x FROM b{k} b
  LEFT JOIN (SELECT part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM comp JOIN a{k} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place)
)""")
    return "WITH " + ", ".join(ctes) + f"""
SELECT vec_id, code, error, label_error, sha256(books) AS codebooks_sha256
FROM (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
JOIN (SELECT vec_id, sum(e) OVER (PARTITION BY label)::BIGINT AS label_error FROM kept JOIN (SELECT vec_id, sum(d) AS e FROM a{rounds} GROUP BY vec_id) USING (vec_id)) USING (vec_id),
(SELECT string_agg(x::VARCHAR, ',' ORDER BY part, entry, place) AS books FROM b{rounds})
"""


ORACLE = {"op5_temporal_url_filter": OP5, "op6_temperature_mix": OP6, "op12_orchard_codes": _op12()}
