"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from . import mixing

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(31))]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(31)))) END AS s FROM d),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM n),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT n.doc_id, len(n.s)::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""

HOST_RULES = rf"""
WITH w AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT rn, i, array_to_string(w[i:i + 4], chr(31)) AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
s AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rn, count(DISTINCT i + k) AS n_repeat_words FROM s, range(5) t(k) GROUP BY rn),
b AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rn)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM f WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * n) AS nn, sum(f) AS f, sum(f * f / n) AS ff FROM h),
u AS (SELECT *, f / n AS m, n - nn / n - (k - 1) AS room FROM t),
p AS (SELECT m, CASE WHEN room > 1e-9::DOUBLE AND m * (1 - m) > 0 THEN 1 / least(greatest(((ff - f * f / n) / (m * (1 - m)) - (k - 1)) / room, 1e-6::DOUBLE), 0.999::DOUBLE) - 1 ELSE 10.0::DOUBLE END AS s FROM u)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((SELECT (h.f + p.m * p.s) / (h.n + p.s) FROM h, p WHERE h.source = f.source), 0) <= 0.5 AS kept FROM f
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT rn, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT rn, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
x AS (SELECT rn, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM p) WHERE first < coalesce(doc_id, 9223372036854775807)),
gone AS (SELECT DISTINCT rn, i + k AS i FROM x, range(50) t(k)),
kept AS (SELECT a.rn, string_agg(a.word, ' ' ORDER BY a.i) AS text, count(*) AS n
  FROM (SELECT rn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) a ANTI JOIN gone USING (rn, i) GROUP BY a.rn)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rn)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32 as a CTE, and the checksum of a text's UTF-8 bytes with it.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex({0}), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || {0})"

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rn, doc_id, lang, {_LEAF.format(_FIELD.format('text'))} AS leaf,
  CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 3 = 0 THEN {_LEAF.format(_FIELD.format(_LOWER.format('text')))} END AS other FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
lv(lang, k, hs) AS (SELECT lang, 0, list(leaf ORDER BY p) FROM o GROUP BY lang
  UNION ALL SELECT lang, k + 1, list_transform(range(0, len(hs), 8), lambda i: sha256(array_to_string(hs[i + 1:i + 8], ''))) FROM lv WHERE len(hs) > 1),
sub AS (SELECT lang, k AS height, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM lv WHERE len(hs) = 1),
up(k, hs) AS (SELECT 0, list(subroot ORDER BY g) FROM sub
  UNION ALL SELECT k + 1, list_transform(range(0, len(hs), 8), lambda i: sha256(array_to_string(hs[i + 1:i + 8], ''))) FROM up WHERE len(hs) > 1),
steps AS (SELECT rn, k AS s, hs, (p // pow(8, k)::BIGINT) AS p FROM o JOIN lv ON o.lang IS NOT DISTINCT FROM lv.lang WHERE len(hs) > 1
  UNION ALL SELECT rn, height + k, hs, (g // pow(8, k)::BIGINT) FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang, up WHERE len(hs) > 1),
path AS (SELECT rn, s, p % 8 AS slot, hs[p - p % 8 + 1:p - p % 8 + 8] AS run FROM steps),
proof AS (SELECT rn, string_agg(array_to_string(run[1:slot], '') || array_to_string(run[slot + 2:8], ''), '' ORDER BY s) AS siblings FROM path GROUP BY rn),
fold(rn, s, h) AS (SELECT rn, 0::BIGINT, coalesce(other, leaf) FROM o
  UNION ALL SELECT f.rn, f.s + 1, sha256(array_to_string(run[1:slot], '') || h || array_to_string(run[slot + 2:8], '')) FROM fold f JOIN path USING (rn, s)),
folded AS (SELECT rn, arg_max(h, s) AS folded_root FROM fold GROUP BY rn)
SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM up WHERE len(hs) = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT hs[1] FROM up WHERE len(hs) = 1) AS verified
FROM o JOIN sub ON o.lang IS NOT DISTINCT FROM sub.lang JOIN folded USING (rn) LEFT JOIN proof USING (rn)
"""

_FEATURES = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLING = f"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS rn, doc_id, {_FEATURES} AS w FROM documents),
x AS (SELECT rn, unnest(w) AS word FROM d),
y AS (SELECT unnest({_FEATURES}) AS word FROM benchmark),
words AS (SELECT word, {_CRC.format('word')} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y), crc),
s AS (SELECT bucket, count(*) AS s FROM x JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN words USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS all_s, (SELECT count(*) FROM y)::DOUBLE AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
sums AS (SELECT rn, sum(gain)::DOUBLE AS total FROM x JOIN words USING (word) JOIN gain USING (bucket) GROUP BY rn),
scored AS (SELECT rn, doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) > 0 THEN floor(total / len(w))::BIGINT ELSE 0 END AS weight,
  floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN sums USING (rn)),
ranked AS (SELECT *, weight + noise AS score, n_features >= 20 AS fit FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * (SELECT count(*) FROM ranked WHERE fit) // 100 THEN place END AS rank FROM placed
"""

SQL = {
    "op1_near_dup": NEAR_DUP,
    "op2_mixing": mixing.SQL,
    "op7_host_rules": HOST_RULES,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op11_merkle": MERKLE,
    "op13_resampling": RESAMPLING,
}
