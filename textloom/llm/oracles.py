"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY doc_id),
raw_lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw FROM d),
lines AS (SELECT doc_id, source, t, raw, lower(translate(trim(regexp_replace(raw, '[\\x09-\\x0D\\x20]+', ' ', 'g')), '123456789', '000000000')) AS line FROM raw_lines),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines WHERE line <> '' GROUP BY doc_id),
frequent AS (SELECT source, line, min(doc_id) AS first_id FROM lines WHERE line <> '' GROUP BY source, line HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT l.doc_id, sum(length(l.line) - length(replace(l.line, ' ', '')) + 1) AS n
         FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line WHERE l.doc_id <> f.first_id GROUP BY l.doc_id),
facts AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
          FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND 100 * n_removed_words <= 50 * n_words AS kept FROM judged
"""


def _op2() -> str:
    from .secrets import BASE_RULES, RULES

    parts = []
    for n, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, {n} AS n, '{r.kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS hit, regexp_extract_all(t, '{p}', {r.group}) AS held, regexp_split_to_array(t, '{p}') AS gap, {r.least} AS least FROM d")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT *, unnest(range(1, len(hit) + 1)) AS k FROM found),
placed AS (SELECT doc_id, n, kind, hit[k] AS h, list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0) AS s FROM each WHERE length(held[k]) >= least),
listed AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(h) AS BIGINT), ',' ORDER BY s, n) FILTER (n < {len(BASE_RULES)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(h) AS BIGINT), ',' ORDER BY s, n) AS spans FROM placed GROUP BY doc_id)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)
"""


OP3 = r"""
WITH log AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et,
  replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er FROM log)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + length(er) + 20) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

# CRC-32 by its table of 256 values, which the first step computes.
OP5 = """
WITH crc AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM (SELECT unnest(range(256)) AS n))),
bytes AS (SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bs FROM documents),
facts AS (SELECT doc_id, CAST(len(bs) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM bytes, crc),
scores AS (SELECT doc_id, n, 1.0 / -ln((CAST('0x' || md5(doc_id || ':' || n)[1:13] AS BIGINT) + 0.5) / 4503599627370496.0) AS score FROM documents, (SELECT unnest(range(17)) AS n)),
placed AS (SELECT doc_id, CAST(arg_max(n, score) FILTER (n < 16) AS INTEGER) AS shard, CAST(arg_max(n, score) AS INTEGER) AS grown_shard FROM scores GROUP BY doc_id),
cells AS (SELECT f.*, shard, grown_shard, floor((CAST('0x' || md5(doc_id || ':slot')[1:13] AS BIGINT) + 0.5) / 4503599627370496.0 * greatest(16, ceil((SELECT count(*) FROM documents) / (250000.0 * 16)))) AS salt FROM facts f JOIN placed USING (doc_id))
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM cells
"""

ORACLES = {"op1_quality_rules": OP1, "op2_secret_scan": _op2(), "op3_chat_format": OP3, "op5_sharding": OP5}
