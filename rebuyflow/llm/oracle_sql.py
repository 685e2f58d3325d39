"""SQL of the operators that SQL can express, over the same tables."""

ORACLES: dict[str, str] = {}

ORACLES["op2_block_search"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10"""
ORACLES["op4_pivot_index"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
ORACLES["op5_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(COALESCE(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)),
o AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
f AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS g FROM w SEMI JOIN o USING (h)),
i AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS z FROM f GROUP BY doc_id, g),
j AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR before < a THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM j),
m AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM k GROUP BY doc_id, run),
s AS (SELECT doc_id, list(a ORDER BY a) AS sa, list(z ORDER BY a) AS sz, CAST(sum(z - a) AS BIGINT) AS gone FROM m GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, COALESCE(gone, 0) AS n_removed, COALESCE(len(sa), 0) AS n_spans,
  sha256(CASE WHEN sa IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(sa) + 2), lambda x: hex(b[(CASE WHEN x = 1 THEN 1 ELSE sz[x - 1] END):(CASE WHEN x > len(sa) THEN octet_length(b) ELSE sa[x] - 1 END)])), '')) END) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""
ORACLES["op9_seed_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
f AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM h) WHERE r > 1),
x AS (SELECT DISTINCT doc_id, s + o AS i FROM f, range(20) t(o)),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY 1),
e AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM e ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - COALESCE(n, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
ORACLES["op8_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, COALESCE(max(n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1"""
ORACLES["op11_fill_middle"] = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
g AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
p AS (SELECT doc_id, t, n, array_to_string(u[1:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
ORACLES["op12_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_chars, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) AS role_chars,
  row_number() OVER o AS i, lag(role) OVER o AS before FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN i = 1 THEN 9 + role_chars + 1 WHEN before = role THEN 8 ELSE 7 + 1 + 9 + role_chars + 1 END) + 7 + 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
q AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM c, range(1, 4) t(cut) WHERE cut < k),
v AS (SELECT q.lang, q.phrase, q.a, cut, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * q.a // (l.a + r.a) AS BIGINT) AS score FROM q JOIN f l ON l.lang = q.lang AND l.phrase = x JOIN f r ON r.lang = q.lang AND r.phrase = y),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[o:o + z - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) t(z), range(1, 4) u(o) WHERE z < k AND o + z - 1 <= k GROUP BY 1, 2),
y AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y JOIN n USING (lang)
QUALIFY rank <= 2000"""
