"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS
from .urls import LOWER, RULES as URL_RULES, TERMS, UPPER

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# The table of CRC-32 comes from its polynomial; it is then applied byte by byte.
_SHARDS = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i] || CAST(range(8) AS BIGINT[]),
                              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
b AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         [4294967295] || list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'),
                                                     ' ')[:-2], lambda h: CAST('0x' || h AS BIGINT)) AS bytes
  FROM documents),
d AS (
  SELECT doc_id, source, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
         xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM b, tab),
r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n
  FROM d),
g AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS LAST, rank) - 1 AS g,
         count(*) OVER () AS total
  FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 24 // total AS INTEGER) AS shard,
       CAST(g - ((g * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM g
"""


def _quality() -> str:
    tests = []
    for r in RULES:
        sides = ([f"{r.measure} < {r.low}"] if r.low is not None else []) + (
            [f"{r.measure} > {r.high}"] if r.high is not None else [])
        tests.append(f"CASE WHEN {' OR '.join(sides)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
text_win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM win),
twice AS (
  SELECT doc_id, i FROM text_win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cover AS (
  SELECT doc_id, sum(least(8, coalesce(after - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover c USING (doc_id)),
q AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m),
v AS (SELECT *, concat_ws(',', {', '.join(tests)}) AS failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, failed
FROM v
"""


_MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         source_size * 3.0::DOUBLE AS cap
  FROM s),
a AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT max(level) FROM a)) AS target
  FROM a),
p AS (  -- rows as stretches of their source's stream
  SELECT d.*, row_number() OVER () AS id,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS b
  FROM d),
q AS (
  SELECT *, greatest(1, (source_size + 255) // 256) AS blocks, greatest(source_size, 1) AS one,
         CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS whole,
         CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest
  FROM t),
c AS (SELECT *, whole * blocks + (rest * blocks + source_size - 1) // one AS slots FROM q),
l AS (SELECT *, CAST(sum(slots) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM c WHERE slots > 0),
n AS (SELECT greatest(1, length(bin(CAST(sum(slots) AS BIGINT) - 1))) AS bits FROM l),
v AS (  -- van der Corput points on a grid of that many bits
  SELECT step, CAST(list_sum(list_transform(range(bits), lambda i: ((step >> i) & 1) << (bits - 1 - i))) AS BIGINT) AS point
  FROM (SELECT bits, unnest(range(1 << bits)) AS step FROM n)),
r AS (
  SELECT step, source, source_size, blocks, whole, rest, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS r
  FROM v JOIN l ON point >= hi - slots AND point < hi),
x AS (
  SELECT step, source, r % blocks * source_size // blocks AS begin,
         CASE WHEN r // blocks < whole THEN (r % blocks + 1) * source_size // blocks
              ELSE least((r % blocks + 1) * source_size // blocks, rest) END AS stop
  FROM r),
g AS (
  SELECT id, CAST(sum(least(b + size, stop) - greatest(b, begin)) AS BIGINT) AS taken, count(*) AS n_slots,
         min(step) AS first_step
  FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source AND b < stop AND b + size > begin AND size > 0
  GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, p.source, coalesce(n_slots, 0) AS n_slots, first_step
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN g USING (id)
"""


_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS speaker,
         replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
h AS (
  SELECT t.*, perspective,
         '<|im_start|>' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                                ELSE 'user name=' || replace(replace(
                                  regexp_replace(speaker, '[\n\r\x0B\f\x{85}\x{2028}\x{2029}]', ' ', 'g'),
                                  '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM h),
s AS (
  SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, piece
                                          ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM r)
SELECT conv_id, perspective, turn, speaker, piece, CAST("end" - length(piece) AS BIGINT) AS start, "end",
       CASE WHEN speaker = perspective THEN CAST("end" - length(piece) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN speaker = perspective THEN CAST("end" - 1 AS BIGINT) END AS mask_end
FROM s
"""


_NEAREST = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce([0.0::DOUBLE] || list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def _urls() -> str:
    def listed(terms):
        return "[" + ", ".join(f"'{t}'" for t in sorted(terms)) + "]"

    def found(terms):
        return f"list_filter({listed(terms)}, lambda t: regexp_matches(u, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))"

    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.name}', '{'allow' if r.allow else 'block'}')" for r in URL_RULES)
    return rf"""
WITH p AS (
  SELECT row_number() OVER () AS id, page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT id, max_by(name, length(name)) AS rule, max_by(v, length(name)) AS v
  FROM p JOIN (VALUES {rules}) rules(h, start, name, v)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)
  GROUP BY id),
t AS (
  SELECT p.*, rule, v, CAST(len({found(TERMS.strict)}) AS BIGINT) AS n_strict,
         CAST(len({found(TERMS.soft)}) AS BIGINT) AS n_soft,
         array_to_string({found(TERMS.strict + TERMS.soft)}, ',') AS terms
  FROM p LEFT JOIN r USING (id))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= {TERMS.limit} THEN 'block' ELSE 'allow' END) AS verdict,
       n_strict, n_soft, terms
FROM t
"""


# Near words by letters taken out: equal with the same place out, or one equal to the other with a letter out.
_SPELLING = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i] || CAST(range(8) AS BIGINT[]),
                              lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                           'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (
  SELECT run, n, xor(list_reduce(
           [4294967295] || list_transform(
             string_split(regexp_replace(hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)),
                                         '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM runs, tab),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
out AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM out a JOIN out b USING (i, s) WHERE a.word <> b.word
  UNION SELECT o.word, w.word FROM out o JOIN w ON o.s = w.word
  UNION SELECT w.word, o.word FROM out o JOIN w ON o.s = w.word),
near AS (
  SELECT p.a AS word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, encode(w.word)) AS best, max(w.n) AS best_n
  FROM pairs p JOIN w ON p.b = w.word GROUP BY p.a),
f AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form,
         CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN near USING (word)),
walk AS (
  SELECT word, word AS root FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON f.word = walk.word JOIN f AS last ON last.word = walk.root AND last.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_interleaved_shards": _SHARDS,
        "op2_quality_rules": _quality(),
        "op4_vantage_neighbours": _NEAREST,
        "op8_source_mix": _MIX,
        "op10_chat_perspectives": _CHAT,
        "op12_url_verdicts": _urls(),
        "op13_spelling_variants": _SPELLING,
    }
