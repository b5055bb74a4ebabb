"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {}

ORACLES["op2_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fits AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS v
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits
"""

ORACLES["op4_decontamination"] = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), lengths AS (SELECT DISTINCT n FROM sized
), spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths
), found AS (
  SELECT s.doc_id, s.i, s.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM spots) s
  JOIN windows x ON s.win = x.win AND s.n = x.n
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(strlen(t) AS BIGINT) + 1),
    lambda i: CAST('0x' || substr(hx, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"""

ORACLES["op5_rendezvous_shards"] = f"""
WITH step AS (
  SELECT n, list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(n)
), crc AS (SELECT list(v ORDER BY n) AS tab FROM step
), docs AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS hx FROM documents
), sums AS (
  SELECT doc_id, CAST(strlen(t) + 16 AS BIGINT) AS size, xor({_CRC}, 4294967295) AS text_crc32 FROM docs, crc
), draws AS (
  SELECT doc_id, s AS shard, CAST('0x' || substr(md5(doc_id || ':' || s), 1, 13) AS BIGINT) AS v
  FROM (SELECT DISTINCT doc_id FROM documents), range(41) r(s)
), best AS (
  SELECT doc_id, max_by(shard, (v, -shard)) FILTER (shard < 40) AS shard, max_by(shard, (v, -shard)) AS grown FROM draws GROUP BY 1
)
SELECT s.doc_id, s.size, s.text_crc32, 'key' AS law, CAST(b.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY b.shard ORDER BY s.doc_id, s.text_crc32) - 1 AS slot, CAST(b.grown AS INTEGER) AS grown_shard
FROM sums s JOIN best b ON s.doc_id = b.doc_id
"""

ORACLES["op7_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""


def _guard(x: str) -> str:
    x = f"replace({x}, '\\', '\\\\')"
    for c in "<[|":
        x = f"replace({x}, '{c}', '{c}\\')"
    return x


ORACLES["op8_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (SELECT *, length('<|' || {_guard('role')} || '|>' || {_guard('text')} || '<|end|>') AS n FROM turns
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS stop,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(stop) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

ORACLES["op11_repetition"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), three AS (
  SELECT r, unnest(places) AS i FROM (
    SELECT r, list(i) AS places FROM (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
    GROUP BY r, win HAVING count(*) > 1)
), ten AS (
  SELECT r, unnest(places) AS i FROM (
    SELECT r, list(i) AS places FROM (SELECT r, i, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 8)) AS i FROM d))
    GROUP BY r, win HAVING count(*) > 1)
), covered3 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM three) GROUP BY r
), covered10 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 10)) AS p FROM ten) GROUP BY r
), long AS (
  SELECT DISTINCT r FROM (
    SELECT r, array_to_string(w[i:i + 100], ' ') AS win FROM (
      SELECT r, w, unnest(range(1, len(w) - 99)) AS i FROM d WHERE r IN (SELECT r FROM covered10 WHERE n > 100)))
  GROUP BY r, win HAVING count(*) > 1
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(covered3.n, 0) AS n_repeat_words, coalesce(covered10.n, 0) AS n_covered, long.r IS NOT NULL AS too_long
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered3 USING (r) LEFT JOIN covered10 USING (r) LEFT JOIN long USING (r)
), based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_covered <= 45 * n_words AND NOT too_long AS kept, n_covered
FROM based
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 5
"""
