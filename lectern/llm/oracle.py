"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d
), windows AS (
  SELECT doc_id, s.s AS s, md5(array_to_string(ws[s.s:s.s + 19], ' ')) AS win
  FROM d, unnest(range(1, len(ws) - 18)) AS s(s)
), late AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rn FROM windows) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, s + k AS pos FROM late, unnest(range(0, 20)) AS u(k)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.pos) AS kept, count(*) AS n
  FROM w ANTI JOIN gone USING (doc_id, pos) GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP4 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a AS vec_id, b AS other FROM links
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
), least_ids AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(least(e.vec_id, coalesce(m, e.vec_id)) AS BIGINT) AS component_id,
       e.vec_id <= coalesce(m, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts USING (vec_id) LEFT JOIN least_ids USING (vec_id)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + 9], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) AS u(s) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n FROM d, sizes), unnest(range(1, len(ws) - n + 2)) AS u(s)
), hits AS (
  SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (n, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), g AS (
  SELECT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS gram, count(*) AS c FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0 GROUP BY 1, 2
), n AS (SELECT doc_id, sum(c) AS n FROM g GROUP BY 1
), m AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), p AS (
  SELECT a, b FROM m JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9
), links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least_ids AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS class_id, doc_id <= coalesce(m, doc_id) AS kept FROM documents LEFT JOIN least_ids USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), n AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

_CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(expression: str) -> str:
    """A backslash behind each backslash and behind the first character of each control string."""
    out = f"replace({expression}, '\\', '\\\\')"
    for c in _CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP12 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), l AS (
  SELECT *, length({_escaped("role")}) + length({_escaped("text")}) + {len("<|im_start|><|im_sep|><|im_end|>")} AS chars FROM t
), s AS (
  SELECT *, CAST(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM l
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
       CAST(sum(CASE WHEN role = 'assistant' THEN upto ELSE 0 END) AS BIGINT) AS example_chars
FROM s GROUP BY conv_id
"""

OP13 = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k] AS f, string_split(o[1:k - 1], '') AS before FROM orders, unnest(range(1, 6)) AS u(k)
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), fails AS (
  SELECT part, doc_id, list_filter([
           CASE WHEN len(ws) < 200 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
           CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 'C' END,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END], lambda x: x IS NOT NULL) AS failed
  FROM w
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN marks USING (doc_id) GROUP BY part, failed
), told AS (
  SELECT part, filter_order, step, f, n, good, toxic, list_contains(failed, f) AS now, list_has_any(failed, before) AS earlier, len(failed) = 1 AS alone FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, f,
         CAST(sum(CASE WHEN NOT now AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN now AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN now AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN now AND alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN now AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN now AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

ORACLE_SQL: dict[str, str] = {
    "op9_minhash_dedup": OP9,
    "op1_substring_dedup": OP1,
    "op4_embedding_dedup": OP4,
    "op6_decontamination": OP6,
    "op11_fill_in_middle": OP11,
    "op12_chat_formatting": OP12,
    "op13_filter_audit": OP13,
}
