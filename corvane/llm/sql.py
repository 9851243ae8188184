"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontaminate import WORD
from .line_dedup import MAX_EDITS, WORDS_PER_EDIT
from .mixing import BITS, SEED
from .quality_rules import ALPHA, DELTA, LEVELS, RULES, SYMBOLS

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"

OP1 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n,
  unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) ELSE [array_to_string(w, ' ')] END) AS k
  FROM bw WHERE len(w) > 0),
pos AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM pos p JOIN win ON win.n = p.n AND win.k = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_LCP = "coalesce(nullif(list_position(list_transform(list_zip(x, y), lambda z: z[1] IS DISTINCT FROM z[2]), true), 0), greatest(len(x), len(y)) + 1)"


def _edit(name: str, before: str, least: int) -> str:
    """One edit tried in each of its three ways, then the equal words after it cut off."""
    ways = "[{'x': x[2:], 'y': y[2:]}, {'x': x[2:], 'y': y}, {'x': x, 'y': y[2:]}]"
    return f"{name} AS (SELECT a, b, k, x[l:] AS x, y[l:] AS y FROM (SELECT *, {_LCP} AS l FROM (SELECT a, b, k, o.x AS x, o.y AS y FROM (SELECT a, b, k, unnest({ways}) AS o FROM {before} WHERE k >= {least}))))"


OP3 = f"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, no, ls[no + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS no FROM docs)),
norm AS (SELECT doc_id, no, line, list_filter(regexp_split_to_array(translate(line, '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM lines),
firsts AS (SELECT w, len(w) AS n, min(struct_pack(d := doc_id, n := no)) AS p FROM norm WHERE len(w) > 0 GROUP BY w),
long AS (SELECT w, n, p, m, CAST(least({MAX_EDITS}, m // {WORDS_PER_EDIT}) AS INT) AS k FROM (SELECT *, n + unnest(range({MAX_EDITS} + 1)) AS m FROM firsts)),
parts AS (SELECT w, n, p, m, k, m // (k + 1) AS s FROM long WHERE k > 0 AND m - n <= k),
keys AS (SELECT w, n, p, m, k, 'p' AS side, w[1:s] AS h FROM parts UNION ALL SELECT w, n, p, m, k, 's', w[n - s + 1:n] FROM parts
  UNION ALL SELECT w, n, p, m, k, 'm', w[s + d + 1:2 * s + d] FROM parts, (SELECT unnest([-1, 0, 1]) AS d) WHERE k = 2),
cand AS (SELECT DISTINCT a.w AS a, b.w AS b, a.k AS k FROM keys a JOIN keys b ON a.side = b.side AND a.m = b.m AND a.h = b.h AND a.p < b.p WHERE a.m = greatest(a.n, b.n)),
e0 AS (SELECT a, b, k, x[l:] AS x, y[l:] AS y FROM (SELECT *, {_LCP} AS l FROM (SELECT a, b, k, a AS x, b AS y FROM cand))),
{_edit("e1", "e0", 1)},
{_edit("e2", "e1", 2)},
near AS (SELECT DISTINCT b AS w FROM (FROM e0 UNION ALL FROM e1 UNION ALL FROM e2) WHERE len(x) = 0 AND len(y) = 0),
marked AS (SELECT n.doc_id, n.no, n.line, len(n.w) = 0 OR (f.p.d = n.doc_id AND f.p.n = n.no AND r.w IS NULL) AS keep,
  coalesce(f.p.d = n.doc_id AND f.p.n = n.no AND r.w IS NOT NULL, false) AS is_near
  FROM norm n LEFT JOIN firsts f ON f.w = n.w LEFT JOIN near r ON r.w = n.w),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed, count(*) FILTER (is_near) AS n_near,
  string_agg(line, chr(10) ORDER BY no) FILTER (keep) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(p.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(p.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(p.n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(p.text, '')) AS text_sha256
FROM documents d LEFT JOIN per p USING (doc_id)
"""

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STEPS = range(1, len(LEVELS[RULES[0]]) + 1)
_COUNTS = ", ".join("count(*) FILTER (" + " OR ".join(f"{r} > {LEVELS[r][t - 1]}" for r in RULES) + f") AS k{t}" for t in _STEPS)
_TRIED = ", ".join(f"{{'t': {t}, 'k': k{t}}}" for t in _STEPS)
_TAIL = f"list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))))"
_OVER = " OR ".join(f"coalesce({r} > list_extract([{', '.join(map(str, LEVELS[r]))}], level), false)" for r in RULES)

OP10 = f"""
WITH a AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, stratum, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda l: translate(l, {_BLANKS}, '') <> '') AS ln FROM a),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
c AS (SELECT b.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, len(ln) AS n_lines, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(translate(t, '{UPPER}', '')) AS n_upper FROM b LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
  n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio FROM c),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT stratum, count(*) AS n, {_COUNTS} FROM s SEMI JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
tests AS (SELECT stratum, n, x.t AS t, x.k AS k FROM (SELECT stratum, n, unnest([{_TRIED}]) AS x FROM counts)),
lim AS (SELECT stratum, CAST(max(t) AS INT) AS level FROM tests WHERE k < n * {ALPHA} AND {_TAIL} <= {DELTA} / (SELECT count(*) FROM counts) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, level, NOT base_failed AND NOT ({_OVER}) AS kept
FROM s LEFT JOIN lim USING (stratum)
"""

_RANKED = "row_number() OVER (PARTITION BY {} ORDER BY s DESC, id) AS r"

OP11 = f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, v.id AS id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda z: z[1] * z[2])) AS BIGINT) AS s FROM v a JOIN v ON a.id <> v.id AND len(a.q) = len(v.q) WHERE a.id % 100 = 0),
p AS (SELECT a, id AS p, s AS ps FROM (SELECT *, {_RANKED.format("a")} FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.p, p.ps, s.id, s.s, {_RANKED.format("p.a, p.p")} FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.ps <= 100 * s.s AND 100 * s.s <= 100 * p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 5
"""

# Half words are whole numbers here; sources by rising size over weight, those that are stopped first.
OP12 = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), source, md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (SELECT *, sum(z) OVER () * 3 - coalesce(sum(4 * z) OVER b, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest
  FROM w WINDOW b AS (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 4 * z * rest <= left_ * w AS stopped FROM r),
t AS (SELECT source, z, CASE WHEN stopped THEN CAST(2 * z AS DOUBLE) ELSE CAST(sum(z) OVER () * 3 - coalesce(sum(4 * z) FILTER (stopped) OVER (), 0) AS DOUBLE) * w / CAST(2 * (sum(w) OVER () - coalesce(sum(w) FILTER (stopped) OVER (), 0)) AS DOUBLE) END AS target FROM c),
k AS (SELECT *, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate FROM t)
SELECT doc_id, size, z AS source_size, target, size * CAST(floor(rate) + CASE WHEN CAST('0x' || left(h, {BITS // 4}) AS BIGINT) / {1 << BITS}.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""

_P = "1 + CAST((1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v) AS BIGINT)"

OP13 = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x, row_number() OVER () AS no FROM documents),
t AS (SELECT lang, source, no, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_P.format("coalesce(c.c, 0)", "coalesce(n.n, 0)")} AS p, {_P.format("k.c", "l.n")} AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 50
"""

ORACLE = {"op1_decontaminate": OP1, "op3_line_dedup": OP3, "op10_quality_rules": OP10, "op11_hard_negatives": OP11, "op12_mixing": OP12, "op13_divergence": OP13}
