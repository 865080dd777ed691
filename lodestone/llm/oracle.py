"""What the queries must return, as SQL for an independent engine: plain, quadratic where need be."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: All pairs of a label, then what can be reached.
OP1 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
 e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
 r(u, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, e.w FROM r JOIN e ON e.u = r.w),
 c AS (SELECT u AS vec_id, min(w) AS component_id FROM r GROUP BY u),
 n AS (SELECT u AS vec_id, count(*) AS n_links FROM e GROUP BY u)
 SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""

#: The water level in closed form: sources in the order in which they reach their cap.
OP3 = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
  CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || coalesce(md5(text), '-')), 1, 5) AS INT) AS cell FROM documents),
 s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
 w AS (SELECT *, CAST([5, 2, 1][1 + i % 3] AS DOUBLE) AS wt, 2 * n AS cap FROM s),
 r AS (SELECT *, cap / wt AS full_at, CAST(1.5 AS DOUBLE) * sum(n) OVER () - (sum(cap) OVER o - cap) AS rest, sum(wt) OVER (ORDER BY cap / wt, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts
  FROM w WINDOW o AS (ORDER BY cap / wt, i ROWS UNBOUNDED PRECEDING)),
 u AS (SELECT min_by(rest / wts, full_at) AS unit FROM r WHERE rest / wts <= full_at),
 g AS (SELECT source, n, least(coalesce(unit * wt, cap), cap) AS target FROM r, u),
 h AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n + 1e-12) ELSE 0 END AS whole FROM g),
 k AS (SELECT *, greatest(target - whole * n, 0) AS need FROM h),
 c AS (SELECT source, cell, CAST(sum(size) AS DOUBLE) AS sz FROM d GROUP BY ALL),
 x AS (SELECT source, cell, sz, sum(sz) OVER (PARTITION BY source ORDER BY cell) AS run FROM c),
 b AS (SELECT x.source, min(cell) AS edge, arg_min(run, cell) AS upto, arg_min(run - sz, cell) AS before FROM x JOIN k ON x.source IS NOT DISTINCT FROM k.source WHERE run > need GROUP BY x.source)
 SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(size * (whole + CASE WHEN edge IS NULL THEN CAST(need > 0 AS INT) WHEN cell <> edge THEN CAST(cell < edge AS INT) ELSE CAST(upto - need <= need - before AS INT) END) AS BIGINT) AS taken
 FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source"""

#: Every window of 35 words by its whole text's digest.
OP6 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
 l AS (SELECT r, list_transform(range(1, len(ws) - 33), lambda p: md5(array_to_string(ws[p:p + 34], ' '))) AS hs FROM d),
 h AS (SELECT r, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM l),
 s AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
 w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
 f AS (SELECT w.r, w.w, w.i, max(s.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS UNBOUNDED PRECEDING) AS last FROM w LEFT JOIN s ON s.r = w.r AND s.i = w.i),
 a AS (SELECT r, count(*) FILTER (i - last < 35) AS n, string_agg(w, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 35) AS kept FROM f GROUP BY r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)"""

#: All pairs that share a shingle, then what can be reached.
OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM d),
 s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS sh FROM g),
 p AS (SELECT a.doc_id AS u, b.doc_id AS w FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
 e AS (SELECT u, w FROM p UNION ALL SELECT w, u FROM p),
 r(u, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.w FROM r JOIN e ON e.u = r.w),
 c AS (SELECT u AS doc_id, min(w) AS component_id FROM r GROUP BY u)
 SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id FROM g JOIN c USING (doc_id)"""

#: Every string of 400 bytes by its digest; what is kept is joined as hexadecimal digits.
OP8 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
 l AS (SELECT r, list_transform(range(1, octet_length(b) - 398), lambda p: md5(b[p:p + 399])) AS hs FROM d),
 h AS (SELECT r, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM l),
 s AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
 o AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS was, lead(i) OVER (PARTITION BY r ORDER BY i) AS will FROM s),
 a AS (SELECT r, i AS lo, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM o WHERE was IS NULL OR i - was > 400),
 z AS (SELECT r, i + 400 AS hi, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM o WHERE will IS NULL OR will - i > 400),
 t AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS start FROM a JOIN z USING (r, k)),
 g AS (SELECT r, sum(hi - lo) AS n, count(*) AS runs, max(hi) AS rest, string_agg(CASE WHEN lo > start THEN hex(b[start:lo - 1]) ELSE '' END, '' ORDER BY lo) AS head FROM t JOIN d USING (r) GROUP BY r)
 SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b WHEN rest <= octet_length(b) THEN unhex(head || hex(b[rest:octet_length(b)])) ELSE unhex(head) END) AS kept_sha256 FROM d LEFT JOIN g USING (r)"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document that shares a term is scored.
OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
 g AS (SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
 t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
 f AS (SELECT w, CAST(floor(1000 * ln((2.0 * g.n + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM t, g GROUP BY w, g.n),
 i AS (SELECT q, item_id, w, count(*) AS c FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS w FROM benchmark) GROUP BY ALL),
 s AS (SELECT q, item_id, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * g.n) // g.l)))) AS BIGINT) AS score
  FROM i JOIN f USING (w) JOIN t USING (w) JOIN d USING (r), g GROUP BY q, item_id, r),
 k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0)
 SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10"""

#: The lines as a list, cut and joined again.
OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda p: CAST('0x' || substr(h, p, 8) AS BIGINT)) AS hs FROM d),
 c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
 p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: Every window of every item against every place of every document.
OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
 b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
 i AS (SELECT item_id, least(len(ws), 10) AS k, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda p: array_to_string(ws[p:p + least(len(ws), 10) - 1], ' '))) AS g FROM b WHERE len(ws) > 0),
 k AS (SELECT DISTINCT k FROM i),
 w AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS g FROM d, k WHERE len(ws) >= k),
 o AS (SELECT DISTINCT r, p, k, item_id FROM w JOIN i USING (k, g)),
 h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS x FROM o) GROUP BY r),
 l AS (SELECT r, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS v FROM o WHERE item_id IS NOT NULL) GROUP BY r)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1, "op3_mix_sources": OP3, "op6_substring_dedup": OP6, "op7_ngram_join": OP7, "op8_suffix_dedup": OP8, "op11_lexical_search": OP11, "op12_fill_in_middle": OP12, "op13_decontamination": OP13}
