"""DuckDB SQL for the queries that SQL can express; the others are tested against brute-force versions."""

from __future__ import annotations

_MD5 = "('0x' || substr(md5('mix' || {}), 1, 8))::BIGINT"

#: The order of a source is (size class, salt, size, hash, id); targets by trying every number of capped sources.
OP10 = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
e AS (SELECT *, {_MD5.format("id")} AS h, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3) AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, list_extract([3.0, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
m AS (SELECT min_by(level, cap / w) AS level FROM l WHERE level * w <= cap * (1 + 1e-12)),
t AS (SELECT l.source, l.source_size, least(l.cap, l.w * m.level) AS target, {_MD5.format("CASE WHEN l.source IS NULL THEN 'n' ELSE 's' || l.source END")} / 4294967296.0::DOUBLE AS u FROM l CROSS JOIN m),
r AS (SELECT e.*, row_number() OVER (PARTITION BY source ORDER BY class, h % 64, size, h, id) AS pos FROM e),
k AS (SELECT r.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CAST(least(floor(pos * rate + u) - floor((pos - 1) * rate + u), ceil(rate)) AS BIGINT) AS copies FROM k)
SELECT doc_id, source, size, source_size, round(target, 4) AS target, copies, copies * size AS taken FROM n"""

OP2 = """WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS v FROM g UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
c AS (SELECT u, min(v) AS component FROM r GROUP BY u),
n AS (SELECT u, count(*) AS links FROM l GROUP BY u)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""

#: Phrases by list slices, counted and cut in one table; 128-bit whole numbers hold the products.
OP11 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, n, unnest(list_transform(range(1, len(words) - n + 2), lambda i: array_to_string(words[i:i + n - 1], ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3)) AS t(n) WHERE len(words) >= n),
f AS (SELECT lang, n, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, n AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE n >= 2 AND f >= 10),
k AS (SELECT c.*, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.*, l.f AS l, r.f AS r, (1000000 * a * a) // (l.f * r.f) AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.n = k AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.n = words - k AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE words = 3),
kept AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.phrase = b.phrase AND 100 * h.a >= 50 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n, score::BIGINT AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every run of as many words as some window has, as text, met with the windows.
OP12 = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda s: array_to_string(w[s:s + 9], ' '))) AS win FROM i WHERE len(w) > 0),
s AS (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM x) AS ks WHERE len(w) >= k),
m AS (SELECT s.row, s.s, s.k, x.item FROM (SELECT row, s, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM s) AS s JOIN x USING (k, win)),
h AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + k)) AS p FROM m) GROUP BY row),
c AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM m) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN c USING (row)"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_TREE = """{0}(tree, level, pos, n, hash) AS (SELECT tree, 0, pos, n, hash FROM {1}
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM {0} WHERE n > 1 GROUP BY tree, level, pos // 2, n)"""
#: Slot and sibling of a node at each level below the root of its tree.
_STEPS = """{0} AS (SELECT s.row, list(((s.pos >> t.level) & 1)::VARCHAR || coalesce(o.hash, '') ORDER BY t.level) AS steps FROM {1} s
  JOIN {2} t ON t.tree = s.tree AND t.pos = (s.pos >> t.level) AND t.n > 1
  LEFT JOIN {2} o ON o.tree = t.tree AND o.level = t.level AND o.pos = xor(t.pos, 1) GROUP BY s.row)"""

#: CRC-32 byte by byte with a table of 256; trees level by level; a proof is a list of slots and siblings, folded by list_reduce.
OP13 = f"""WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
b AS (SELECT *, row_number() OVER () AS row, coalesce('+' || lang, '') AS tree, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda c, x: xor(c >> 8, crc.t[xor(c, x) % 256 + 1])), 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS other_chars FROM documents CROSS JOIN crc),
l AS (SELECT row, tree, doc_id, {_LEAF.format("n_chars")} AS hash, {_LEAF.format("other_chars")} AS other FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_TREE.format("x", "p")},
r AS (SELECT tree AS name, tree AS row, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, hash FROM x WHERE n = 1),
{_TREE.format("y", "r")},
{_STEPS.format("e", "p", "x")},
{_STEPS.format("u", "r", "y")},
w AS (SELECT p.*, r.hash AS subroot, list_concat(coalesce(e.steps, []), coalesce(u.steps, [])) AS steps FROM p JOIN r ON r.name = p.tree LEFT JOIN e ON e.row = p.row LEFT JOIN u ON u.row = r.row),
z AS (SELECT w.*, (SELECT hash FROM y WHERE n = 1) AS root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof,
  list_reduce(list_prepend(other, steps), lambda a, s: sha256(CASE WHEN s[1] = '0' THEN a || s[2:] ELSE s[2:] || a END)) AS folded FROM w)
SELECT doc_id, hash AS leaf, subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified FROM z"""

SQL = {"op2_covertree": OP2, "op10_mixing": OP10, "op11_collocations": OP11, "op12_positional": OP12, "op13_merkle": OP13}
