"""DuckDB SQL for those queries of the corpus operators that it can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

SHARD_SIZES = """
SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size FROM documents
"""

SHARD_COUNTS = """
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT shard::INTEGER AS shard, (n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END)::BIGINT AS docs, (n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END)::BIGINT AS slots
FROM n, range(40) AS r(shard)
"""

MEDIA_PAYLOADS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT *, octet_length(b) AS n, greatest(64, (octet_length(b) + 63) // 64 * 64) AS m FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(b || repeat('\\x00'::BLOB, (m - n)::BIGINT)) AS payload_sha256 FROM p
"""

MIX_TARGETS = f"""
WITH sizes AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::BIGINT AS source_size, count(*) AS docs FROM documents GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, 2.0 * source_size AS cap FROM sizes),
-- sources that stop at their caps are the first ones by cap for each weight
o AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
 sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
level AS (SELECT max(rest / free) AS level FROM o WHERE rest / free <= cap / w)
SELECT source, docs, source_size, round(CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END, 3) AS target, TRUE AS met FROM o, level
"""

LINE_DEDUP = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
held AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
met AS (SELECT b.doc_id, b.j, b.i, b.w, a.doc_id AS d, a.j - b.j AS off FROM held a JOIN held b ON a.line = b.line AND (a.doc_id < b.doc_id OR a.doc_id = b.doc_id AND a.j < b.j)),
islands AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, d, off ORDER BY j) AS run FROM met),
runs AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM islands GROUP BY doc_id, d, off, run HAVING sum(w) >= 50),
gone AS (SELECT DISTINCT r.doc_id, x.i FROM raw x JOIN runs r ON r.doc_id = x.doc_id AND x.i BETWEEN r.a AND r.b)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(g.n, 0)::INTEGER AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.i) AS text FROM raw x ANTI JOIN gone o ON o.doc_id = x.doc_id AND o.i = x.i GROUP BY x.doc_id) k USING (doc_id)
"""

CHAT = """
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
turns AS (SELECT *, contains(text, '<|') OR contains(text, '&lt;|') OR contains(text, '&amp;') OR contains(role, '<|') OR contains(role, '&lt;|') OR contains(role, '&amp;') OR contains(role, chr(10)) OR contains(role, '&nl;') AS hard FROM rows),
stored AS (SELECT *, CASE WHEN hard THEN replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') ELSE role END AS r, CASE WHEN hard THEN replace(replace(text, '&', '&amp;'), '<|', '&lt;|') ELSE text END AS x FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length(r) + length(x) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars, max(hard)::INTEGER AS escaped
FROM stored GROUP BY conv_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
 UNION ALL SELECT doc_id, hash(w) FROM words WHERE len(w) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
 WHERE a.doc_id <> b.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(min(r.root), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id, n
"""

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT d.doc_id, d.part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > x.least, FALSE)] AS f,
 coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
 FROM d LEFT JOIN (SELECT t, min(doc_id) AS least FROM d GROUP BY t) x USING (t)
 LEFT JOIN (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, f),
o AS (SELECT [a, b, x, y, z] AS o FROM range(1, 6) r1(a), range(1, 6) r2(b), range(1, 6) r3(x), range(1, 6) r4(y), range(1, 6) r5(z) WHERE len(list_distinct([a, b, x, y, z])) = 5),
s AS (SELECT o, step, o[step] AS k FROM o, range(1, 6) r(step)),
e AS (SELECT part, o, step, k, n, good, toxic, f[k] AS fails, list_sum([f[i]::INTEGER FOR i IN o[1:step - 1]]) > 0 AS gone, list_sum([x::INTEGER FOR x IN f]) = 1 AS single FROM c, s),
t AS (SELECT part, o, step, k, sum(n) FILTER (NOT fails AND NOT coalesce(gone, FALSE)) AS kept, sum(n) FILTER (fails AND NOT coalesce(gone, FALSE)) AS removed, sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (fails AND single) AS unique_fails,
 sum(good) FILTER (fails AND NOT coalesce(gone, FALSE)) AS good_lost, sum(toxic) FILTER (fails AND NOT coalesce(gone, FALSE)) AS toxic_lost FROM e GROUP BY part, o, step, k)
SELECT part, array_to_string([chr((64 + i)::INTEGER) FOR i IN o], '') AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
 coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM t
"""

#: Unsigned CRC-32 of the decimal digits of a number.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split({0}::VARCHAR, '')]), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295)"

PREFIX_TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
 md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, c - c % 5 AS b, {_CRC.format("c")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
k AS (SELECT cs.*, least(h, coalesce(n, 0)) AS k FROM cs LEFT JOIN (SELECT c AS b, count(*) AS n FROM t GROUP BY c) x ON x.b = cs.b),
u AS (SELECT k.c, t.i AS d, t.t, t.bytes FROM k JOIN t ON t.c = k.b AND t.i <= k.h UNION ALL SELECT k.c, t.i - k.h + k.k, t.t, t.bytes FROM k JOIN t ON t.c = k.c AND t.i > k.h),
p AS (SELECT c, d, bytes, string_agg(t, ',') OVER (PARTITION BY c ORDER BY d) AS p, count(*) OVER (PARTITION BY c) AS len FROM u
 UNION ALL SELECT c, 0, 0, '', (SELECT count(*) FROM u WHERE u.c = k.c) FROM k),
n AS (SELECT d, p, min(c) AS owner, count(*) AS n_convs, min(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d) AS ends FROM p GROUP BY d, p),
e AS (SELECT n.*, m.owner AS parent, m.p AS above FROM n LEFT JOIN (SELECT DISTINCT x.d, x.p, y.p AS q FROM p x JOIN p y ON y.c = x.c AND y.d = x.d - 1) l ON l.d = n.d AND l.p = n.p LEFT JOIN n m ON m.d = n.d - 1 AND m.p = l.q),
kids AS (SELECT d - 1 AS d, above AS p, count(*) AS n_children FROM e WHERE d > 0 GROUP BY ALL),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM e LEFT JOIN kids USING (d, p)),
-- what each node's subtree holds: every node counts for all prefixes of its owner up to itself
s AS (SELECT x.d, x.p, sum((f.n_children = 0)::INTEGER) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f JOIN p x ON x.c = f.owner AND x.d <= f.d GROUP BY x.d, x.p)
SELECT owner AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM f JOIN s USING (d, p)
"""

LM_BASE_SCORES = f"""
WITH d AS (SELECT doc_id, {_CRC.format("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), chr(10)) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out
"""

SQL = {
    "shard_sizes": SHARD_SIZES,
    "shard_counts": SHARD_COUNTS,
    "media_payloads": MEDIA_PAYLOADS,
    "mix_targets": MIX_TARGETS,
    "op4_line_dedup": LINE_DEDUP,
    "op8_chat_formatting": CHAT,
    "op10_ngram_join": NGRAM_JOIN,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_prefix_trie": PREFIX_TRIE,
    "lm_base_scores": LM_BASE_SCORES,
}
