"""DuckDB SQL for the operators whose results SQL can express."""

OP1 = r"""WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) t(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(lang, chr(0)) AS gl, coalesce(source, chr(0)) AS gs,
    n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS mean_word FROM m),
long AS (SELECT gl, gs, measure, CAST(v AS BIGINT) AS v FROM (SELECT *, n_words AS size_words, n_lines AS size_lines FROM r WHERE NOT base_failed) UNPIVOT (v FOR measure IN (symbol_rate, dup_line_rate, repeat_rate, mean_word, size_words, size_lines))),
bits AS (SELECT *, CASE WHEN v < 64 THEN 0 ELSE CAST(floor(log2(v)) AS BIGINT) END AS top FROM long),
edges AS (SELECT gl, gs, measure, CASE WHEN v < 64 THEN v ELSE (v >> (top - 5)) << (top - 5) END AS edge FROM bits),
every AS (SELECT 'g' AS tag, gl, gs, measure, edge FROM edges UNION ALL SELECT 'l', gl, '', measure, edge FROM edges UNION ALL SELECT 'a', '', '', measure, edge FROM edges),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tag, gl, gs, measure ORDER BY edge) AS rn, count(*) OVER (PARTITION BY tag, gl, gs, measure) AS total FROM every),
k AS (SELECT * FROM (VALUES ('symbol_rate', 90), ('dup_line_rate', 99), ('repeat_rate', 99), ('mean_word', 90), ('size_words', 50), ('size_lines', 50)) v(measure, percent)),
q AS (SELECT tag, gl, gs, measure, max(total) AS total, min(edge) FILTER (rn >= (total * 50 + 99) // 100) AS med, min(edge) FILTER (rn >= (total * percent + 99) // 100) AS high FROM ranked JOIN k USING (measure) GROUP BY ALL),
u AS (SELECT tag, gl, gs, greatest(max(med) FILTER (measure = 'size_words'), 1) AS words, greatest(max(med) FILTER (measure = 'size_lines'), 1) AS lines FROM q GROUP BY ALL),
f AS (SELECT *, CAST(high + 3 * greatest(high - med, CASE measure WHEN 'symbol_rate' THEN 10000 // words WHEN 'dup_line_rate' THEN 10000 // lines WHEN 'repeat_rate' THEN 30000 // words
  ELSE CAST(floor(med / sqrt(words::DOUBLE)) AS BIGINT) END) AS BIGINT) AS fence FROM q JOIN u USING (tag, gl, gs)),
p AS (SELECT tag, gl, gs, max(total) AS total, max(fence) FILTER (measure = 'symbol_rate') AS s, max(fence) FILTER (measure = 'dup_line_rate') AS d, max(fence) FILTER (measure = 'repeat_rate') AS t, max(fence) FILTER (measure = 'mean_word') AS w FROM f GROUP BY ALL),
j AS (SELECT r.*, CASE WHEN g.total IS NULL THEN NULL WHEN g.total >= 20 THEN {'s': g.s, 'd': g.d, 't': g.t, 'w': g.w} WHEN l.total >= 20 THEN {'s': l.s, 'd': l.d, 't': l.t, 'w': l.w} ELSE {'s': a.s, 'd': a.d, 't': a.t, 'w': a.w} END AS x
  FROM r LEFT JOIN p g ON g.tag = 'g' AND g.gl = r.gl AND g.gs = r.gs LEFT JOIN p l ON l.tag = 'l' AND l.gl = r.gl LEFT JOIN p a ON a.tag = 'a')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(symbol_rate <= x.s AND dup_line_rate <= x.d AND repeat_rate <= x.t AND mean_word <= x.w, true) AS kept,
  x.s AS max_symbol_rate, x.d AS max_dup_line_rate, x.t AS max_repeat_rate, x.w AS max_mean_word FROM j"""

OP10 = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('curriculum:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size / CAST(weight AS DOUBLE) AS fill, CAST(sum(source_size) OVER () AS BIGINT) AS words, CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s),
o AS (SELECT *, (words - coalesce(CAST(sum(3 * source_size) OVER p AS BIGINT), 0)) / CAST(weights - coalesce(CAST(sum(weight) OVER p AS BIGINT), 0) AS DOUBLE) AS level FROM f
  WINDOW p AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, fill) AS level FROM o WHERE level <= fill),
t AS (SELECT o.source, source_size, weight, CASE WHEN c.level IS NULL OR fill <= c.level THEN CAST(3 * source_size AS DOUBLE) ELSE weight * c.level END AS target FROM o LEFT JOIN c ON true),
x AS (SELECT d.*, source_size, weight, target, CAST(floor(target + 0.5) AS BIGINT) AS whole,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS rounds FROM x),
z AS (SELECT *, greatest(0, least(size, whole - rounds * source_size - start)) AS rest, (start + size / 2.0) / target AS u FROM y)
SELECT doc_id, size, source_size, target, rounds * size + rest AS taken, CAST(CASE WHEN size = 0 THEN 0 ELSE rounds + (2 * rest >= size)::INT END AS INTEGER) AS copies,
  CASE WHEN rounds * size + rest > 0 THEN round(least(1.0, greatest(0.0, CASE
    WHEN weight = 1 THEN CASE WHEN u < 1 THEN u * 1.0 * 2.0 / (1.5 + sqrt(greatest(0.0, 2.25 + u * 1.0 * -2.0))) ELSE 1.0 END
    WHEN weight = 2 THEN CASE WHEN u < 1 THEN CASE WHEN u < 0.5 THEN u ELSE 0.5 + (u - 0.5) END ELSE 1.0 END
    ELSE CASE WHEN u < 0.375 THEN u * 2.0 / (0.5 + sqrt(greatest(0.0, 0.25 + u * 2.0))) WHEN u < 1 THEN 0.5 + (u - 0.375) * 2.0 / (1.0 + sqrt(greatest(0.0, 1.0 + (u - 0.375) * 2.0))) ELSE 1.0 END END)), 6) END AS first_position FROM z"""

OP12 = r"""WITH r AS (SELECT row_number() OVER () AS row, CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM documents_of_vectors),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, r.row, r.vec_id, a.label = r.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda x: x[1] * x[2])) AS BIGINT) AS score FROM a JOIN r ON a.row <> r.row AND len(a.v) = len(r.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id, s.row) AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3""".replace("documents_of_vectors", "embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0")

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13 = f"""WITH RECURSIVE d AS (SELECT coalesce('=' || source, '') AS tree, doc_id, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(_LOWER)} END AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
own AS (SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM own WHERE n > 1 GROUP BY tree, level, pos // 16, n),
subs AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, level AS height FROM own WHERE n = 1),
over_all AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subs
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM over_all WHERE n > 1 GROUP BY level, pos // 16, n),
inner_path AS (SELECT l.tree, l.pos, o.level, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < l.pos >> (4 * o.level)), '') AS before, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > l.pos >> (4 * o.level)), '') AS after
  FROM l JOIN own o ON o.tree = l.tree AND o.pos >> 4 = l.pos >> (4 * (o.level + 1)) AND o.n > 1 GROUP BY ALL),
outer_path AS (SELECT s.tree, s.height + o.level AS level, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos < s.pos >> (4 * o.level)), '') AS before, coalesce(string_agg(o.node, '' ORDER BY o.pos) FILTER (o.pos > s.pos >> (4 * o.level)), '') AS after
  FROM subs s JOIN over_all o ON o.pos >> 4 = s.pos >> (4 * (o.level + 1)) AND o.n > 1 GROUP BY s.tree, s.height, s.pos, o.level),
path AS (SELECT * FROM inner_path UNION ALL SELECT l.tree, l.pos, o.level, before, after FROM l JOIN outer_path o USING (tree)),
steps AS (SELECT tree, pos, list({{'b': before, 'a': after}} ORDER BY level) AS p FROM path GROUP BY tree, pos),
x AS (SELECT l.*, coalesce(p, []) AS p FROM l LEFT JOIN steps USING (tree, pos)),
folds AS (SELECT tree, pos, 0 AS k, coalesce(tampered, leaf) AS h, p FROM x UNION ALL SELECT tree, pos, k + 1, sha256(p[k + 1].b || h || p[k + 1].a), p FROM folds WHERE k < len(p))
SELECT x.doc_id, x.leaf, s.subroot, o.node AS root, sha256(array_to_string(list_transform(x.p, lambda q: q.b || q.a), '')) AS proof_sha256, f.h AS folded_root, f.h = o.node AS verified
FROM x JOIN subs s USING (tree) JOIN folds f ON f.tree = x.tree AND f.pos = x.pos AND f.k = len(x.p) JOIN over_all o ON o.n = 1"""
