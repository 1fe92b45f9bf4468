"""SQL, for DuckDB, that gives the same rows as the corpus queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from . import licenses, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "'[\\x20\\x09-\\x0D]+'"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), {_SPACE}), lambda x: x <> '')"


NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
  x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.m = e.a)
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT d, min(m) AS component_id FROM r GROUP BY d) c ON s.doc_id = c.d"""

_LIC_WORDS = "list_filter(regexp_split_to_array(lower({}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({i}, '{n}', [{', '.join(repr(x) for x in g)}])" for i, (n, _, g) in enumerate(licenses.template_bigrams()))
LICENSES = f"""WITH t(i, license, g) AS (VALUES {_TEMPLATES}),
  l AS (SELECT doc_id, -1 AS line, coalesce(text, '') AS x FROM documents UNION ALL SELECT doc_id, generate_subscripts(ls, 1) - 1, unnest(ls) FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
  u AS (SELECT doc_id, line, x FROM l UNION ALL SELECT doc_id, line, unnest(string_split(regexp_replace(x, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))) FROM l WHERE line >= 0),
  w AS (SELECT doc_id, line, {_LIC_WORDS.format('x')} AS w FROM u),
  b AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS b FROM w WHERE len(w) > 1),
  d AS (SELECT doc_id, line, i, license, 2e0 * len(list_intersect(b, g)) / (len(b) + len(g)) AS dice FROM b, t WHERE len(b) <= 2 * len(g) AND len(g) <= 2 * len(b)),
  h AS (SELECT doc_id, line, license, dice FROM d WHERE dice >= {licenses.THRESHOLD}e0 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, i) = 1),
  a AS (SELECT doc_id, count(*) AS n_hits, min_by(license, struct_pack(d := -dice, l := license)) AS license, max(dice) AS dice, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM h GROUP BY doc_id)
  SELECT doc_id, coalesce(n_hits, 0) AS n_hits, license, round(dice, 9) AS dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN a USING (doc_id)"""

_BENCH_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
DECONTAMINATION = f"""WITH i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
  iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS k, array_to_string(w[s:s+least(10, len(w))-1], ' ') AS g FROM i, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(s) WHERE len(w) > 0),
  ks AS (SELECT DISTINCT k FROM iw),
  dw AS (SELECT doc_id, k, s, array_to_string(w[s:s+k-1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(s) WHERE len(w) >= k),
  h AS (SELECT doc_id, s, dw.k, item FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
  n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY 1),
  m AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: DuckDB has no CRC-32: the table of its bytes, made bit by bit, and the fold over a text's bytes.
_TABLE = "SELECT i, i::BIGINT AS v FROM range(256) AS r(i)"
for _ in range(8):
    _TABLE = f"SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END AS v FROM ({_TABLE})"
_CRC = "xor(4294967295, list_reduce(list_transform(range(octet_length(encode(t))), lambda i: ('0x' || substr(h, 2*i+1, 2))::BIGINT), lambda c, y: xor(c >> 8, tbl[(xor(c, y) & 255) + 1]), 4294967295))"
_SHARDS = 8
_CHAIN = "SELECT lo, hi, ends, (lo + hi) // 2 AS mid, 0::BIGINT AS s FROM b WHERE lo < hi"
for _ in range(_SHARDS):
    _CHAIN = f"SELECT lo, hi, ends, mid, list_max(list_filter(list_concat(ends, [0::BIGINT]), lambda e: e <= s + mid)) AS s FROM ({_CHAIN})"
_CUTS = "SELECT lo, ends, 0::BIGINT AS s, []::BIGINT[] AS cuts FROM b WHERE lo = hi"
for _ in range(_SHARDS):
    _CUTS = f"SELECT lo, ends, s2 AS s, list_append(cuts, s2) AS cuts FROM (SELECT *, list_max(list_filter(list_concat(ends, [0::BIGINT]), lambda e: e <= s + lo)) AS s2 FROM ({_CUTS}))"
SHARDING = f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(text, '')) AS k FROM documents),
  g AS (SELECT k, sum(size)::BIGINT AS size FROM d GROUP BY k), c AS (SELECT k, (sum(size) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM g),
  b AS (SELECT 0::BIGINT AS lo, max(e) AS hi, list(e ORDER BY e) AS ends FROM c
        UNION ALL SELECT CASE WHEN s = ends[-1] THEN lo ELSE mid + 1 END, CASE WHEN s = ends[-1] THEN mid ELSE hi END, ends FROM ({_CHAIN})),
  x AS (SELECT cuts FROM ({_CUTS}) LIMIT 1),
  tbl AS (SELECT list(v ORDER BY i) AS tbl FROM ({_TABLE})),
  crc AS (SELECT k, {_CRC} AS v FROM (SELECT DISTINCT coalesce(text, '') AS t, md5(coalesce(text, '')) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents), tbl)
  SELECT doc_id, size::BIGINT AS size, crc.v::BIGINT AS text_crc32, 'bytes' AS law, len(list_filter(cuts, lambda y: y < e))::INT AS shard,
  row_number() OVER (PARTITION BY len(list_filter(cuts, lambda y: y < e)) ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || k), doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM d JOIN c USING (k) JOIN crc USING (k), x"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
  SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n < 1000 OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to FROM p"""

_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(rules.RULES))
QUALITY_RULES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, {_words('t')} AS w FROM t),
  g AS (SELECT doc_id, i, w[i] || chr(31) || w[i+1] || chr(31) || w[i+2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3),
  f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM f) GROUP BY 1),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM t) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
  m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, {_SPACE}, '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
  b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits & {(1 << len(rules.RULES)) - 1} = 0 AS kept FROM b"""

MIXING = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, len({_words('text')}) AS size FROM documents),
  q AS (SELECT doc_id, source, size, greatest(0.05e0, 1e0 - length(regexp_replace(t, '[^#*$%&|<>!=+_~^@0-9A-Z]', '', 'g')) / greatest(length(t), 1)) AS weight,
        (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t) || ':7'), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0 AS u FROM d),
  k AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM q),
  s AS (SELECT source, sum(size) AS source_size FROM k GROUP BY source),
  r AS (SELECT source, source_size, [1e0, 2e0, 3e0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, 3e0 * source_size AS cap FROM s),
  v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
  t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM v WHERE level * w <= cap)) AS target FROM v),
  c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target, (size * (epochs + CASE WHEN epochs < 3 AND run - size / 2e0 <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

_UNIT = "'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'"
_DRAWS = ", ".join(f"CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {1 + 8 * i}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
FIM = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_UNIT}) AS u, {_DRAWS} FROM documents),
  f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
  c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:n], '') AS s FROM f)
  SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

_RUN = "list_reduce(list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2*i+1, 2))::BIGINT), lambda c, y: xor(c >> 8, tbl[(xor(c, y) & 255) + 1]), 4294967295)"
#: Pairs one edit apart: one word is the other without a code point, or both are alike but at one place.
SPELLING = f"""WITH RECURSIVE tbl AS (SELECT list(v ORDER BY i) AS tbl FROM ({_TABLE})),
  r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
  l AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
  h AS (SELECT run, n, xor(4294967295, {_RUN}) AS h FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM l), tbl),
  o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
  v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
  e AS (SELECT DISTINCT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM v, unnest(range(0, length(word))) AS t(i)),
  g AS (SELECT DISTINCT word, n, head || tail AS less FROM e),
  p AS (SELECT g.word AS a, v.word AS b FROM g JOIN v ON g.less = v.word UNION ALL SELECT v.word, g.word FROM g JOIN v ON g.less = v.word
        UNION ALL SELECT x.word, y.word FROM e x JOIN e y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word),
  f AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -v.n, form := b)) AS best FROM p JOIN v ON p.b = v.word GROUP BY a),
  w AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= 10 * v.n THEN best.form END AS form, CASE WHEN -best.less >= 10 * v.n THEN -best.less END AS form_n FROM v LEFT JOIN f USING (word)),
  c AS (SELECT word, word AS last, 0 AS steps FROM w UNION ALL SELECT c.word, w.form, steps + 1 FROM c JOIN w ON c.last = w.word WHERE w.form IS NOT NULL)
  SELECT w.word, w.n, n_near, form, form_n::BIGINT AS form_n, root FROM w JOIN (SELECT word, arg_max(last, steps) AS root FROM c GROUP BY word) USING (word)"""

ORACLES = {
    "op1_ngram_join": NGRAM_JOIN,
    "op2_license_scan": LICENSES,
    "op3_decontamination": DECONTAMINATION,
    "op4_sharding": SHARDING,
    "op6_warc": WARC,
    "op8_quality_rules": QUALITY_RULES,
    "op10_mixing": MIXING,
    "op11_fim": FIM,
    "op12_spelling": SPELLING,
}
