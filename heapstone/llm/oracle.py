"""DuckDB SQL for the operators that SQL can express. That of the licence scan has the rules as the operator has them; its base phrases and its sweep are its own."""

from __future__ import annotations

import re

from heapstone.llm.license_rules import KINDS, rules

WORD = "[^\\x20\\x09-\\x0D]+"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         length(text) - length(translate(text, '#*$%&|<>!', '')) AS symbols
  FROM documents),
weighed AS (
  SELECT *, CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - symbols::DOUBLE / size) END AS quality,
         -ln((('0x' || substr(md5('mix-1' || chr(1) || coalesce(doc_id::VARCHAR, chr(0) || size::VARCHAR)), 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE) AS e
  FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
            row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place
  FROM ranked),
targets AS (
  SELECT source, source_size,
         least(coalesce((SELECT level FROM levels WHERE level * w <= 2.0 * source_size ORDER BY place LIMIT 1) * w, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY e / quality, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM weighed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM placed
"""

QUALITY_RULES = f"""
WITH words AS (SELECT doc_id, source, text, regexp_extract_all(text, '{WORD}') AS w FROM documents),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words WHERE len(w) >= 3),
windows AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS three FROM flat WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows WHERE three IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM repeated CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
dups AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
stats AS (
  SELECT w.doc_id, w.source, coalesce(len(w.w), 0)::BIGINT AS n_words, coalesce(length(array_to_string(w.w, '')), 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::BIGINT AS n_symbols,
         coalesce(d.n_dup_lines, 0) AS n_dup_lines, coalesce(c.n_repeat_words, 0) AS n_repeat_words
  FROM words w LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS f FROM failed GROUP BY source),
pooled AS (SELECT sum(f) / sum(n) AS m FROM hosts),
moments AS (
  SELECT m, m * (1 - m) AS sampling, (sum(n * (f / n - m) ** 2) - (count(*) - 1) * m * (1 - m)) / sum(n) AS excess FROM hosts, pooled GROUP BY m),
prior AS (
  SELECT m, CASE WHEN excess > 0 AND sampling > 0 THEN greatest(2.0, least(10000.0, sampling / excess - 1)) ELSE 10000.0 END AS s FROM moments),
verdicts AS (SELECT source, (f + m * s) / (n + s) >= 0.6 AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""

CHAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS len FROM turns),
prefixes AS (
  SELECT conv_id, pos, len, md5(string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h FROM placed),
ends AS (SELECT h, min(conv_id) AS conv_id FROM prefixes WHERE pos = len - 1 GROUP BY h),
kept AS (SELECT conv_id FROM ends WHERE h NOT IN (SELECT h FROM prefixes WHERE pos < len - 1))
SELECT conv_id, max(len)::BIGINT AS n_turns, 0 AS part, 1 AS n_parts,
       string_agg('<|' || CASE lower(trim(role)) WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'system' THEN 'system' ELSE role END
                  || '|>' || chr(10) || trim(text) || chr(10) || chr(10), '' ORDER BY pos) AS text
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM words WHERE len(w) > 0),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN n >= 3 THEN three ELSE whole END AS s
  FROM (SELECT doc_id, n, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS three,
               word || coalesce(' ' || lead(word) OVER p, '') AS whole FROM flat WINDOW p AS (PARTITION BY doc_id ORDER BY i))
  WHERE (n >= 3 AND three IS NOT NULL) OR (n < 3 AND i = 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, sym.y FROM reach JOIN sym ON reach.r = sym.x),
found AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, f.component_id, d.doc_id = f.component_id AS kept
FROM documents d JOIN found f USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""


def _crc(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    byte = "list_reduce([xor(a, b)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT lang, doc_id, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_crc("doc_id::VARCHAR")} % 7 = 0 THEN sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) END AS other
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows),
tree(g, lvl, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM placed
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, pos // 2, n),
subroots AS (SELECT g, h, lvl AS height FROM tree WHERE n = 1),
top(lvl, pos, n, h) AS (
  SELECT 0, g, (SELECT count(*) FROM subroots), h FROM subroots
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
steps AS (
  SELECT p.g, p.pos AS leaf_pos, p.lvl, CASE WHEN (p.pos >> p.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, '') AS step
  FROM (SELECT placed.g, pos, unnest(range(height)) AS lvl FROM placed JOIN subroots USING (g)) p LEFT JOIN tree t ON t.g = p.g AND t.lvl = p.lvl AND t.pos = xor(p.pos >> p.lvl, 1)
  UNION ALL
  SELECT p.g, p.pos, 1000 + p.lvl, CASE WHEN (p.g >> p.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(t.h, '')
  FROM (SELECT g, pos, unnest(range((SELECT max(lvl) FROM top))) AS lvl FROM placed) p LEFT JOIN top t ON t.lvl = p.lvl AND t.pos = xor(p.g >> p.lvl, 1)),
paths AS (SELECT g, leaf_pos AS pos, list(step ORDER BY lvl) AS path FROM steps GROUP BY 1, 2),
folded AS (
  SELECT p.*, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) AS proof_sha256,
         list_reduce([coalesce(other, leaf)] || coalesce(path, []), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM placed p JOIN subroots s USING (g) LEFT JOIN paths USING (g, pos))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id AS c, {_crc("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c, 0 AS part, pos, role, text FROM convs JOIN turns ON conv_id = base WHERE pos < h
  UNION ALL SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c WHERE pos >= h),
placed AS (
  SELECT c, row_number() OVER w AS depth, md5(strlen(role) || ':' || role || text) AS m, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS words FROM built WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
prefixes AS (
  SELECT c, depth, words, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS p FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM convs),
ended AS (SELECT c, max(depth) AS len FROM prefixes GROUP BY c),
nodes AS (
  SELECT depth, p, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = depth), '')) AS ends_sha256
  FROM prefixes JOIN ended USING (c) GROUP BY depth, p),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN prefixes q ON q.c = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = q.depth AND u.p = q.p),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (conv_id, depth)),
sums AS (
  SELECT q.depth, q.p, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens
  FROM full_nodes f JOIN prefixes q ON q.c = f.conv_id AND q.depth <= f.depth GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_nodes JOIN sums USING (depth, p)
"""


def _doubled(pattern: str) -> str:
    """A pattern over words that each stand between two spaces of their own, as DuckDB's expressions can't look around a match."""
    return re.sub(r" (\?)?", lambda m: "(?:  )?" if m[1] else "  ", pattern)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BOOK = ", ".join(f"({n}, {_quoted(r.label)}, {_quoted('  '.join(r.keyword.split()))}, {_quoted(' (?:' + _doubled(r.pattern) + ') ')}, {r.kind}, {list(KINDS.values())[r.kind]}::DOUBLE)" for n, r in enumerate(rules()) if not r.base)
_NEXT = lambda k: f"lead(w, {k}) OVER p"

LICENSES = f"""
WITH book(rule, label, keyword, pattern, kind, worth) AS (VALUES {_BOOK}),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
lines AS (SELECT row, doc_id, coalesce(len(words), 0) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS line FROM docs),
flat AS (SELECT row, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
phrases AS (SELECT row, i, w, {_NEXT(1)} AS w1, {_NEXT(2)} AS w2, {_NEXT(3)} AS w3 FROM flat WINDOW p AS (PARTITION BY row ORDER BY i)),
base AS (
  SELECT row, i, CASE WHEN w = 'gnu' AND w1 = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' WHEN w = 'apache' AND w1 = 'license' THEN 'apache' WHEN w = 'cc' AND w1 = 'by' THEN 'cc-by' WHEN w = 'mit' AND w1 = 'license' THEN 'mit' END AS label FROM phrases),
hits AS (
  SELECT row, rule, label, kind, worth, regexp_extract_all(line, pattern) AS found, regexp_split_to_array(line, pattern) AS gaps FROM lines JOIN book ON contains(line, keyword)),
placed AS (
  SELECT row, rule, label, kind, worth, unnest(range(len(found))) AS k, unnest(list_transform(found, lambda x: len(string_split(trim(x), '  ')))) AS size, unnest(list_transform(gaps[:len(found)], lambda x: (len(x) - len(replace(x, ' ', ''))) // 2)) AS gap FROM hits WHERE len(found) > 0),
own AS (
  SELECT row, rule, label, kind, worth, sum(gap + size) OVER o - size AS first, sum(gap + size) OVER o - 1 AS last FROM placed WINDOW o AS (PARTITION BY row, rule ORDER BY k)),
spans AS (
  SELECT row, rule, label, kind, worth, first, last FROM own
  UNION ALL SELECT row, 100000 + CASE label WHEN 'gpl' THEN 0 WHEN 'apache' THEN 1 WHEN 'cc-by' THEN 2 ELSE 3 END, label, {len(KINDS) - 1}, {list(KINDS.values())[-1]}::DOUBLE, i, i + CASE label WHEN 'gpl' THEN 3 ELSE 1 END FROM base WHERE label IS NOT NULL),
standing AS (
  SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.row = a.row AND b.kind <= a.kind AND b.first <= a.first AND b.last >= a.last AND (b.first < a.first OR b.last > a.last OR b.rule < a.rule))),
named AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM standing UNION SELECT row, label FROM base WHERE label IS NOT NULL) GROUP BY row),
scored AS (SELECT row, max(worth) AS score FROM standing GROUP BY row),
based AS (SELECT row, count(label) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base WHERE label IS NOT NULL GROUP BY row)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM lines LEFT JOIN based USING (row) LEFT JOIN named USING (row) LEFT JOIN scored USING (row)
"""
