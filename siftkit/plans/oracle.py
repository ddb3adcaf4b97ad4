"""DuckDB SQL for each registered query (views named after the test tables).

These are independent formulations (recursive CTEs, window functions) of the
same semantics, used as the correctness oracle.
"""
from __future__ import annotations

CHUNK_LEN = 511

# H11 at length 511 with Latin marks, as a recursive CTE over cut positions.
CHUNKS_CTE = f"""
steps(doc_id, t, n, pos, idx, piece) AS (
  SELECT doc_id, text, length(text), 1, -1, NULL::VARCHAR FROM documents
  UNION ALL
  SELECT doc_id, t, n, pos + g + 1, idx + 1, substring(t, pos, g) || '。'
  FROM (SELECT doc_id, t, n, pos, idx, CASE WHEN p > 0 THEN p - 1 ELSE {CHUNK_LEN + 1} END AS g
        FROM (SELECT *, length(regexp_extract(substring(t, pos, {CHUNK_LEN}), '(?s)^.*[.,!?]', 0)) AS p
              FROM steps WHERE n - pos + 1 > {CHUNK_LEN}) a) b
),
last_step AS (
  SELECT doc_id, t, n, pos, idx FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) AS rn FROM steps) WHERE rn = 1
),
tails AS (
  SELECT doc_id, idx + 1 AS chunk_idx,
         CASE WHEN k = 0 THEN t ELSE substring(t, greatest(n - k + 1, 1)) END AS chunk
  FROM (SELECT *, CASE WHEN i < length(w) THEN {CHUNK_LEN} - i - 1 ELSE {CHUNK_LEN - 1} END AS k
        FROM (SELECT *, length(regexp_extract(w, '^[^.,!?]*', 0)) AS i
              FROM (SELECT *, substring(t, greatest(n - {CHUNK_LEN} + 1, 1), {CHUNK_LEN}) AS w
                    FROM last_step WHERE n - pos + 1 > 3) x) y) z
),
chunks AS (
  SELECT doc_id, idx AS chunk_idx, piece AS chunk FROM steps WHERE idx >= 0
  UNION ALL SELECT doc_id, chunk_idx, chunk FROM tails
)"""

KEYWORDS_CTE = """
keywords AS (
  SELECT word AS keyword FROM (
    SELECT word, count(*) AS c FROM (
      SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents)
    WHERE length(word) >= 7 GROUP BY word ORDER BY c DESC, word ASC LIMIT 20)
)"""

# F3 gate, F4 tags, E2 spans (runs of capitals), F6 mention scores, D5, D1-D3.
SCREEN_CTES = f"""
scored AS (
  SELECT c.*, (2 * k + 1) / 200.0 + 0.3 >= (199 - 2 * k) / 200.0
              OR c.chunk IN (SELECT keyword FROM keywords WHERE keyword <> '') AS flag
  FROM (SELECT *, (doc_id * 37 + chunk_idx * 11) % 100 AS k FROM chunks) c
),
toks AS (
  SELECT doc_id, chunk_idx, j, tok, regexp_matches(tok, '^[A-ZÀ-Þ]') AS cap FROM (
    SELECT doc_id, chunk_idx, unnest(string_split(chunk, ' ')) AS tok,
           generate_subscripts(string_split(chunk, ' '), 1) AS j
    FROM scored WHERE flag)
),
tagged AS (
  SELECT *, CASE WHEN cap THEN CASE WHEN coalesce(lag(cap) OVER w, false) THEN 'I_NAME' ELSE 'B_NAME' END
                 ELSE 'O' END AS tag
  FROM toks WINDOW w AS (PARTITION BY doc_id, chunk_idx ORDER BY j)
),
spans AS (
  SELECT doc_id, chunk_idx, span_id, min(j) AS b,
         string_agg(replace(tok, '#', ''), ' ' ORDER BY j) AS name
  FROM (SELECT *, sum(CASE WHEN tag = 'B_NAME' THEN 1 ELSE 0 END) OVER (
          PARTITION BY doc_id, chunk_idx ORDER BY j) AS span_id
        FROM tagged WHERE tag <> 'O')
  GROUP BY doc_id, chunk_idx, span_id
),
chunk_names AS (
  SELECT doc_id, chunk_idx, name, min(b) AS ord FROM spans GROUP BY doc_id, chunk_idx, name
),
occ(doc_id, chunk_idx, name, chunk, start0) AS (
  SELECT n.doc_id, n.chunk_idx, n.name, s.chunk, instr(s.chunk, n.name) - 1
  FROM chunk_names n JOIN scored s USING (doc_id, chunk_idx)
  WHERE length(n.name) >= 2 AND NOT contains(n.name, '[UNK]') AND instr(s.chunk, n.name) > 0
  UNION ALL
  SELECT doc_id, chunk_idx, name, chunk,
         start0 + length(name) + instr(substring(chunk, start0 + length(name) + 1), name) - 1
  FROM occ WHERE instr(substring(chunk, start0 + length(name) + 1), name) > 0
),
checked AS (
  SELECT doc_id, chunk_idx, name FROM (
    SELECT doc_id, chunk_idx, name, sum((2 * k + 1) / 256.0::DOUBLE) AS sp, sum((255 - 2 * k) / 256.0::DOUBLE) AS sn
    FROM (SELECT *, (doc_id * 13 + chunk_idx * 7 + start0) % 128 AS k FROM occ)
    GROUP BY doc_id, chunk_idx, name)
  WHERE sp / (sp + sn) > 0.25
),
all_ner AS (
  SELECT doc_id, name, min(chunk_idx * 100000 + ord) AS o FROM chunk_names GROUP BY doc_id, name
),
all_picked AS (
  SELECT c.doc_id, c.name, min(c.chunk_idx * 100000 + n.ord) AS o
  FROM checked c JOIN chunk_names n USING (doc_id, chunk_idx, name) GROUP BY c.doc_id, c.name
),
uniq_ner AS (
  SELECT a.doc_id, string_agg(a.name, '|' ORDER BY a.o) AS names, count(*) AS cnt FROM all_ner a
  WHERE NOT (length(a.name) = 2 AND regexp_matches(a.name, '[女男]'))
    AND NOT (length(a.name) = 2 AND EXISTS (
      SELECT 1 FROM all_ner b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND contains(b.name, a.name)))
  GROUP BY a.doc_id
),
uniq_picked AS (
  SELECT a.doc_id, string_agg(a.name, '|' ORDER BY a.o) AS names FROM all_picked a
  WHERE NOT (length(a.name) = 2 AND regexp_matches(a.name, '[女男]'))
    AND NOT (length(a.name) = 2 AND EXISTS (
      SELECT 1 FROM all_picked b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND contains(b.name, a.name)))
  GROUP BY a.doc_id
),
per_doc AS (
  SELECT doc_id, bool_or(flag) AS has_aml, count(*) AS split_cnt FROM scored GROUP BY doc_id
)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


ORACLE: dict[str, str] = {}

ORACLE["h11_content_split"] = _with(CHUNKS_CTE) + """
SELECT doc_id, chunk_idx, chunk, length(chunk) AS chunk_len FROM chunks"""

ORACLE["k9_screen_articles"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT d.doc_id, coalesce(p.has_aml, false) AS has_aml, coalesce(p.split_cnt, 0) AS split_cnt,
       coalesce(u.cnt, 0) AS n_ner_names, coalesce(u.names, '') AS ner_names,
       CASE WHEN coalesce(k.names, '') = '' AND coalesce(p.has_aml, false) THEN coalesce(u.names, '')
            ELSE coalesce(k.names, '') END AS names
FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN uniq_ner u USING (doc_id)
LEFT JOIN uniq_picked k USING (doc_id)"""


# ---------------------------------------------------------------- span and name fixtures
ALL_SPANS_CTE = """
atoks AS (
  SELECT doc_id, chunk_idx, j, tok, regexp_matches(tok, '^[A-ZÀ-Þ]') AS cap FROM (
    SELECT doc_id, chunk_idx, unnest(string_split(chunk, ' ')) AS tok,
           generate_subscripts(string_split(chunk, ' '), 1) AS j FROM chunks)
),
atagged AS (
  SELECT *, CASE WHEN cap THEN CASE WHEN coalesce(lag(cap) OVER w, false) THEN 'I_NAME' ELSE 'B_NAME' END
                 ELSE 'O' END AS tag
  FROM atoks WINDOW w AS (PARTITION BY doc_id, chunk_idx ORDER BY j)
),
aspans AS (
  SELECT doc_id, chunk_idx, CAST(span_id - 1 AS INT) AS span_idx, min(j) AS b, max(j) AS e,
         string_agg(replace(tok, '#', ''), ' ' ORDER BY j) AS text
  FROM (SELECT *, sum(CASE WHEN tag = 'B_NAME' THEN 1 ELSE 0 END) OVER (
          PARTITION BY doc_id, chunk_idx ORDER BY j) AS span_id FROM atagged WHERE tag <> 'O')
  GROUP BY doc_id, chunk_idx, span_id
),
names5 AS (
  SELECT doc_id, chunk_idx, span_idx, b, name,
         CASE WHEN b % 5 = 0 AND length(name) >= 3
              THEN substring(name, 1, 1) || '[UNK]' || substring(name, 3) ELSE name END AS name_u
  FROM (SELECT *, array_to_string(list_slice(string_split(text, ' '), 1, 1 + b % 3), ' ') AS name FROM aspans)
)"""

MENTIONS_CTE = """
mnames AS (
  SELECT doc_id, chunk_idx, name, min(span_idx) AS ord FROM names5 WHERE length(name) >= 2
  GROUP BY doc_id, chunk_idx, name
),
mocc(doc_id, chunk_idx, name, chunk, start0) AS (
  SELECT n.doc_id, n.chunk_idx, n.name, c.chunk, instr(c.chunk, n.name) - 1
  FROM mnames n JOIN chunks c USING (doc_id, chunk_idx) WHERE instr(c.chunk, n.name) > 0
  UNION ALL
  SELECT doc_id, chunk_idx, name, chunk,
         start0 + length(name) + instr(substring(chunk, start0 + length(name) + 1), name) - 1
  FROM mocc WHERE instr(substring(chunk, start0 + length(name) + 1), name) > 0
),
msums AS (
  SELECT doc_id, chunk_idx, name, count(*) AS n_mentions,
         sum((2 * k + 1) / 256.0::DOUBLE) AS sp, sum((255 - 2 * k) / 256.0::DOUBLE) AS sn,
         max((2 * k + 1) / 256.0::DOUBLE) AS mp, max((255 - 2 * k) / 256.0::DOUBLE) AS mn
  FROM (SELECT *, (doc_id * 13 + chunk_idx * 7 + start0) % 128 AS k FROM mocc)
  GROUP BY doc_id, chunk_idx, name
)"""

ORACLE["e2_bio_decode"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT doc_id, chunk_idx, span_idx, 'NAME' AS slot_type, text, CAST(b AS INT) AS "begin", CAST(e AS INT) AS "end"
FROM aspans"""

ORACLE["d4_distinct_spans"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT c.doc_id, c.chunk_idx, coalesce(d.n, 0) AS n_names, coalesce(d.names, '') AS names
FROM chunks c LEFT JOIN (
  SELECT doc_id, chunk_idx, count(*) AS n, string_agg(text, '|' ORDER BY o) AS names
  FROM (SELECT doc_id, chunk_idx, text, min(span_idx) AS o FROM aspans GROUP BY doc_id, chunk_idx, text)
  GROUP BY doc_id, chunk_idx) d USING (doc_id, chunk_idx)"""

ORACLE["b1_name_filter"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT doc_id, chunk_idx, span_idx, name_u, length(name_u) >= 2 AND NOT contains(name_u, '[UNK]') AS keep
FROM names5"""

ORACLE["b2_has_unk"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT doc_id, chunk_idx, bool_or(contains(name_u, '[UNK]')) AS has_unk, count(*) AS n_names
FROM names5 GROUP BY doc_id, chunk_idx"""

ORACLE["h25_fill_unk"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT doc_id, chunk_idx, span_idx, name, name_u,
  coalesce(CASE
    WHEN n > 2 AND p < n - 1 THEN CASE WHEN b0 >= 0 AND r > 0 THEN substring(chunk, b0 + 1, r) END
    WHEN n > 2 AND p = n - 1 THEN CASE WHEN b1 >= 0 THEN substring(chunk, b1 + 1, n) END
    WHEN n = 2 AND p = 0 THEN CASE WHEN e2 > 0 THEN substring(chunk, e2, 2) WHEN e2 = 0 THEN '' END
    WHEN n = 2 AND p > 0 THEN CASE WHEN b0 >= 0 THEN substring(chunk, b0 + 1, 2) END
  END, name_u) AS recovered
FROM (
  SELECT *, instr(chunk, substring(u, 1, 1)) - 1 AS b0,
         CASE WHEN instr(chunk, substring(u, 1, 1)) > 0
              THEN instr(substring(chunk, instr(chunk, substring(u, 1, 1))), substring(u, p + 2)) END AS r,
         CASE WHEN p > 0 THEN instr(chunk, substring(u, 1, p)) - 1 ELSE 0 END AS b1,
         instr(chunk, substring(u, 2, 1)) - 1 AS e2
  FROM (
    SELECT *, CASE WHEN n0 > 4 AND p < n0 - 1 THEN substring(u0, 1, p + 1) ELSE u0 END AS u,
              CASE WHEN n0 > 4 AND p < n0 - 1 THEN p + 1 ELSE n0 END AS n
    FROM (SELECT x.*, c.chunk, replace(x.name_u, '[UNK]', '#') AS u0,
                 length(replace(x.name_u, '[UNK]', '#')) AS n0,
                 instr(replace(x.name_u, '[UNK]', '#'), '#') - 1 AS p
          FROM names5 x JOIN chunks c USING (doc_id, chunk_idx) WHERE contains(x.name_u, '[UNK]'))))"""

ORACLE["b12_gender_rule"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT doc_id, chunk_idx, span_idx, name, NOT (length(name) = 2 AND regexp_matches(name, '[éè]')) AS keep
FROM names5"""

ORACLE["c5_subsumed_names"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT DISTINCT a.doc_id, a.name FROM names5 a
WHERE length(a.name) = 2 AND EXISTS (
  SELECT 1 FROM names5 b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND contains(b.name, a.name))"""

ORACLE["d3_unique_names"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """,
firsts AS (SELECT doc_id, name, min(chunk_idx * 100000 + span_idx) AS o FROM names5 GROUP BY doc_id, name),
kept AS (
  SELECT * FROM firsts a
  WHERE NOT (length(a.name) = 2 AND regexp_matches(a.name, '[éè]'))
    AND NOT (length(a.name) = 2 AND EXISTS (
      SELECT 1 FROM firsts b WHERE b.doc_id = a.doc_id AND b.name <> a.name AND contains(b.name, a.name)))
)
SELECT d.doc_id, coalesce(k.n, 0) AS n_names, coalesce(k.names, '') AS names
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(name, '|' ORDER BY o) AS names FROM kept GROUP BY doc_id) k
USING (doc_id)"""

ORACLE["c4_name_mentions"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, MENTIONS_CTE) + """
SELECT doc_id, chunk_idx, name, CAST(start0 AS INT) AS start, CAST(start0 + length(name) AS INT) AS "end"
FROM mocc"""

def sentences_sql(mentions: str) -> str:
    """H14 around the rows ``(doc_id, chunk_idx, name, chunk, start0)`` of ``mentions``, by substrings and first or last marks."""
    return f"""
  SELECT *, substring(chunk, lft + 1, greatest(rgt - lft, 0)) AS sentence FROM (
    SELECT *,
      CASE WHEN lo_r >= hi_r THEN L
           WHEN length(regexp_extract(substring(chunk, lo_r + 1, greatest(hi_r - lo_r, 0)), '^[^.,!?]*', 0)) < hi_r - lo_r
             THEN lo_r + length(regexp_extract(substring(chunk, lo_r + 1, greatest(hi_r - lo_r, 0)), '^[^.,!?]*', 0))
           ELSE hi_r - 1 END AS rgt,
      CASE WHEN lo_l >= hi_l THEN 0
           WHEN length(regexp_extract(substring(chunk, lo_l + 1, greatest(hi_l - lo_l, 0)), '(?s)^.*[.,!?]', 0)) > 0
             THEN lo_l + length(regexp_extract(substring(chunk, lo_l + 1, greatest(hi_l - lo_l, 0)), '(?s)^.*[.,!?]', 0))
           ELSE lo_l + 1 END AS lft
    FROM (SELECT doc_id, chunk_idx, name, chunk, start0 AS s, length(chunk) AS L,
                 start0 + length(name) + 5 AS lo_r, least(length(chunk), start0 + length(name) + 25) AS hi_r,
                 greatest(0, start0 - 25) AS lo_l, start0 - 5 AS hi_l
          FROM {mentions}))"""


ORACLE["h14_mention_sentence"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, MENTIONS_CTE) + f"""
SELECT doc_id, chunk_idx, name, CAST(s AS INT) AS start, sentence, name || '[SEP]' || sentence AS pair_text
FROM ({sentences_sql('mocc')})"""

ORACLE["d5_name_score_sum"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, MENTIONS_CTE) + """
SELECT doc_id, chunk_idx, name, n_mentions, round(sp, 6) AS sum_pos, round(sn, 6) AS sum_neg,
       sp / (sp + sn) > 0.25 AS passed
FROM msums"""

ORACLE["d6_name_score_max"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, MENTIONS_CTE) + """
SELECT doc_id, chunk_idx, name, round(mp, 6) AS max_pos, round(mn, 6) AS max_neg,
       mp > 0.95 OR mp > mn AS passed
FROM msums"""

ORACLE["k6_name_check"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, MENTIONS_CTE) + """
SELECT c.doc_id, c.chunk_idx, coalesce(k.names, '') AS checked_names
FROM (SELECT DISTINCT doc_id, chunk_idx FROM names5) c
LEFT JOIN (
  SELECT m.doc_id, m.chunk_idx, string_agg(m.name, '|' ORDER BY m.ord) AS names
  FROM mnames m JOIN msums s USING (doc_id, chunk_idx, name)
  WHERE NOT contains(m.name, '[UNK]') AND s.sp / (s.sp + s.sn) > 0.25
  GROUP BY m.doc_id, m.chunk_idx) k USING (doc_id, chunk_idx)"""

# ---------------------------------------------------------------- gate and merge
ORACLE["b3_rule_check"] = _with(CHUNKS_CTE) + """
SELECT doc_id, chunk_idx, round((2 * k + 1) / 200.0, 6) AS p_pos, round((199 - 2 * k) / 200.0, 6) AS p_neg,
       CAST((2 * k + 1) / 200.0 + 0.3 >= (199 - 2 * k) / 200.0 AS INT) AS label
FROM (SELECT *, (doc_id * 37 + chunk_idx * 11) % 100 AS k FROM chunks)"""

ORACLE["b4_keyword_hit"] = _with(CHUNKS_CTE, KEYWORDS_CTE) + """
SELECT doc_id, chunk_idx,
       chunk IN (SELECT keyword FROM keywords WHERE keyword <> '') AS hit_equals,
       EXISTS (SELECT 1 FROM keywords WHERE keyword <> '' AND contains(chunk, keyword)) AS hit_contains
FROM chunks"""

ORACLE["k7_classify_chunks"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT doc_id, chunk_idx, CAST(flag AS INT) AS label FROM scored"""

ORACLE["k7_classify_chunks_contains"] = _with(CHUNKS_CTE, KEYWORDS_CTE) + """
SELECT doc_id, chunk_idx, CAST((2 * k + 1) / 200.0 + 0.3 >= (199 - 2 * k) / 200.0
       OR EXISTS (SELECT 1 FROM keywords WHERE keyword <> '' AND contains(chunk, keyword)) AS INT) AS label
FROM (SELECT *, (doc_id * 37 + chunk_idx * 11) % 100 AS k FROM chunks)"""

ORACLE["b5_gate"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT s.doc_id, s.chunk_idx, s.flag AS has_aml, coalesce(n.names, '') AS ner_names
FROM scored s LEFT JOIN (SELECT doc_id, chunk_idx, string_agg(name, '|' ORDER BY ord) AS names
                         FROM chunk_names GROUP BY doc_id, chunk_idx) n USING (doc_id, chunk_idx)"""

ORACLE["k8_extract_names"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT s.doc_id, s.chunk_idx, coalesce(n.cnt, 0) AS n_names, coalesce(n.names, '') AS ner_names
FROM scored s LEFT JOIN (SELECT doc_id, chunk_idx, count(*) AS cnt, string_agg(name, '|' ORDER BY ord) AS names
                         FROM chunk_names GROUP BY doc_id, chunk_idx) n USING (doc_id, chunk_idx)
WHERE s.flag"""

ORACLE["d1_merge_chunks"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT d.doc_id, coalesce(p.has_aml, false) AS has_aml, coalesce(p.split_cnt, 0) AS split_cnt, coalesce(n.names, '') AS all_ner_names
FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(name, '|' ORDER BY chunk_idx, ord) AS names
                          FROM chunk_names GROUP BY doc_id) n USING (doc_id)"""

ORACLE["d2_fallback_names"] = _with(CHUNKS_CTE, KEYWORDS_CTE, SCREEN_CTES) + """
SELECT d.doc_id,
       CASE WHEN coalesce(k.names, '') = '' AND coalesce(p.has_aml, false) THEN coalesce(u.names, '')
            ELSE coalesce(k.names, '') END AS names
FROM documents d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN uniq_ner u USING (doc_id)
LEFT JOIN uniq_picked k USING (doc_id)"""

# ---------------------------------------------------------------- string functions
ORACLE["h1_clean_text"] = """
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '[\\t\\n\\r\\p{Zs}]', ' ', 'g'),
                                '[\\x{0}\\x{FFFD}\\p{Cc}\\p{Cf}]', '', 'g') AS c FROM documents)"""

CJK_RANGES = ("\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}"
              "\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}")

ORACLE["h2_space_cjk"] = f"""
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(text, '([{CJK_RANGES}])', ' \\1 ', 'g') AS c FROM documents)"""

ORACLE["h3_strip_accents"] = """
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (SELECT doc_id, strip_accents(lower(text)) AS c FROM documents)"""

PUNCT = "[!-/:-@\\[-`{-~\\p{P}]"

ORACLE["h4_split_punct"] = f"""
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(text, '({PUNCT})', ' \\1 ', 'g') AS c FROM documents)"""

ORACLE["h5_basic_tokens"] = f"""
SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS h FROM (
  SELECT doc_id, list_filter(string_split_regex(trim(s, ' '), ' +'), lambda x: x <> '') AS toks FROM (
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(text, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g'), '[\\x{{0}}\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}]', '', 'g'),
        '([{CJK_RANGES}])', ' \\1 ', 'g'),
        '({PUNCT})', ' \\1 ', 'g'), '[\\s\\x{{2028}}\\x{{2029}}]', ' ', 'g') AS s
    FROM documents))"""

ORACLE["h8_remove_symbols"] = """
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g') AS c FROM documents)"""

ORACLE["h9_remove_whitespace"] = """
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(text, '[ \\x{3000}\\t\\r\\n\\x{202F}]', '', 'g') AS c FROM documents)"""


from ..functions import text as _T  # noqa: E402

IP_RE, URL_RE = _T.IP_RE, _T.URL_RE

ORACLE["h17_strip_ip_url"] = f"""
SELECT doc_id, length(c) AS n, md5(c) AS h FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '{IP_RE}', '', 'g'), '{URL_RE}', '', 'g') AS c
  FROM documents)"""

ORACLE["h18_label_clean"] = """
SELECT conv_id, turn, length(c) AS n, md5(c) AS h FROM (
  SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
     '^( |　)*', ''), '( |　)*(\\n?)$', '\\2'), '\\t', ' ', 'g'), ' {2,}', ' ', 'g') AS c
  FROM conversations)"""

POSTS_CTE = """
posts AS (
  SELECT c_custkey AS post_id, concat_ws(chr(10),
    '作者user' || c_custkey || '看板Food標題[食記] ' || c_name || '時間' || concat_ws(' ',
        ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][c_custkey % 7 + 1],
        ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][c_custkey % 12 + 1],
        CAST(c_custkey % 28 + 1 AS VARCHAR), '12:34:56', '2019'),
    CASE WHEN c_custkey % 3 <> 0 THEN '餐廳名稱：' || c_name || ' 本店' END,
    CASE WHEN c_custkey % 3 <> 1 THEN '地址：No.' || c_custkey || ' ' || c_mktsegment || ' Road' END,
    CASE WHEN c_custkey % 3 <> 2 THEN '電話：' || CASE WHEN c_custkey % 7 = 3 THEN 'N/A'
         ELSE '02-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-'
              || lpad(CAST((c_nationkey * 37) % 10000 AS VARCHAR), 4, '0') END END,
    CASE WHEN c_custkey % 3 = 2 THEN 'Call 09' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' '
         || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || ' ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END,
    CASE WHEN c_custkey % 5 <> 0 THEN '消費時間：2019/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) END,
    '推 good',
    '發信站 ptt.cc 來自: ' || (c_custkey % 256) || '.' || c_nationkey || '.1.' || (c_custkey % 100)
  ) AS content FROM customer
)"""


# What each field of a post must come to, from the customer row that the post was written for and
# without any of the extractor's patterns: labelled values where the line is there, else the title,
# the first nine digits in a row (those of the customer's name), nothing, or the post's date.
FIELDS_CTE = """
written AS (
  SELECT c_custkey AS k, c_name, 'No.' || c_custkey || ' ' || c_mktsegment || ' Road' AS road,
         '2019/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) AS visited,
         ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][c_custkey % 7 + 1] || ' '
           || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][c_custkey % 12 + 1]
           || ' ' || (c_custkey % 28 + 1) || ' 12:34:56 2019' AS posted,
         lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(c_nationkey * 37 % 10000 AS VARCHAR), 4, '0') AS number
  FROM customer),
fields AS (
  SELECT k AS post_id, posted AS post_date, CASE WHEN k % 3 = 0 THEN c_name ELSE c_name || ' 本店' END AS name,
         CASE WHEN k % 3 = 1 THEN '' ELSE road END AS address,
         CASE WHEN k % 3 = 2 THEN right(c_name, 9) WHEN k % 7 = 3 THEN '' ELSE '02-' || number END AS phone,
         CASE WHEN k % 5 = 0 THEN posted ELSE visited END AS visit_date,
         (k % 3 <> 0)::INT + 1 + (k % 3 <> 1)::INT + (k % 5 <> 0)::INT AS score
  FROM written)"""

ORACLE["h24_extract_post_fields"] = _with(FIELDS_CTE) + " SELECT post_id, name, phone, address, visit_date FROM fields"
for _id, _field in (("h19", "post_date"), ("h21", "address"), ("h22", "phone"), ("h23", "visit_date")):
    ORACLE[f"{_id}_{_field}"] = _with(FIELDS_CTE) + f" SELECT post_id, {_field} FROM fields"
ORACLE["h20_place_name"] = _with(FIELDS_CTE) + " SELECT post_id, name FROM fields"

ORACLE["b9_null_words"] = _with(POSTS_CTE) + """
SELECT post_id, raw, CASE WHEN raw IN ('無', 'NA', 'N/A', 'na', 'n/a', '不知', '沒有') THEN '' ELSE raw END AS phone
FROM (SELECT post_id, regexp_extract(content, '電話：([^\n]*)', 1) AS raw FROM posts)"""

ORACLE["h26_request_digest"] = """
SELECT doc_id, sha256(text || 'salt') AS digest FROM documents"""


# ---------------------------------------------------------------- metrics
PAIRS_CTE = """
pairs AS (SELECT l_orderkey, l_linenumber AS gold, l_partkey % 7 + 1 AS pred,
                 CASE WHEN l_suppkey % 5 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS w FROM lineitem),
cm AS (SELECT gold, pred, sum(w) AS n FROM pairs GROUP BY gold, pred),
stats AS (
  SELECT cls, sum(d) AS diag, sum(p) AS n_pred, sum(g) AS n_gold FROM (
    SELECT gold AS cls, n AS g, 0.0::DOUBLE AS p, CASE WHEN gold = pred THEN n ELSE 0.0 END::DOUBLE AS d FROM cm
    UNION ALL SELECT pred AS cls, 0.0::DOUBLE, n, 0.0::DOUBLE FROM cm) GROUP BY cls),
listed AS (
  SELECT c.cls, coalesce(s.diag, 0.0) AS diag, coalesce(s.n_pred, 0.0) AS n_pred, coalesce(s.n_gold, 0.0) AS n_gold
  FROM (SELECT unnest([0, 2, 3, 4, 5, 6, 7]) AS cls) c LEFT JOIN stats s USING (cls)),
per_class AS (
  SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE diag / n_pred END AS p,
            CASE WHEN n_gold = 0 THEN 0.0 ELSE diag / n_gold END AS r FROM listed)"""


def _fb(p, r, beta):
    b2 = beta * beta
    return f"CASE WHEN {b2} * {p} + {r} = 0 THEN 0.0 ELSE (1.0 + {b2}) * {p} * {r} / ({b2} * {p} + {r}) END"


ORACLE["d7_confusion_matrix"] = _with(PAIRS_CTE) + """
SELECT gold, pred, round(n, 6) AS n FROM cm"""

ORACLE["d8_prf_micro"] = _with(PAIRS_CTE) + f"""
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({_fb('p', 'r', 1.0)}, 6) AS fbeta FROM (
  SELECT CASE WHEN sum(n_pred) = 0 THEN 0.0 ELSE sum(diag) / sum(n_pred) END AS p,
         CASE WHEN sum(n_gold) = 0 THEN 0.0 ELSE sum(diag) / sum(n_gold) END AS r FROM listed)"""

ORACLE["d9_prf_macro"] = _with(PAIRS_CTE) + f"""
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg({_fb('p', 'r', 2.0)}), 6) AS fbeta
FROM per_class"""

ORACLE["d10_prf_weighted"] = _with(PAIRS_CTE) + f"""
SELECT round(CASE WHEN sum(n_gold) = 0 THEN 0.0 ELSE sum(p * n_gold) / sum(n_gold) END, 6) AS precision,
       round(CASE WHEN sum(n_gold) = 0 THEN 0.0 ELSE sum(r * n_gold) / sum(n_gold) END, 6) AS recall,
       round(CASE WHEN sum(n_gold) = 0 THEN 0.0 ELSE sum({_fb('p', 'r', 0.5)} * n_gold) / sum(n_gold) END, 6) AS fbeta
FROM per_class"""

ORACLE["d11_prf_present"] = _with(PAIRS_CTE) + """,
ucm AS (SELECT gold, pred, count(*)::DOUBLE AS n FROM pairs GROUP BY gold, pred),
ustats AS (
  SELECT cls, sum(d) AS diag, sum(p) AS n_pred, sum(g) AS n_gold FROM (
    SELECT gold AS cls, n AS g, 0.0::DOUBLE AS p, CASE WHEN gold = pred THEN n ELSE 0.0 END::DOUBLE AS d FROM ucm
    UNION ALL SELECT pred AS cls, 0.0::DOUBLE, n, 0.0::DOUBLE FROM ucm) GROUP BY cls),
uper AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE diag / n_pred END AS p,
                   CASE WHEN n_gold = 0 THEN 0.0 ELSE diag / n_gold END AS r FROM ustats)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
       round(avg(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END), 6) AS f1,
       round(sum(diag) / sum(n_gold), 6) AS accuracy
FROM uper"""

ORACLE["d12_accuracy"] = _with(PAIRS_CTE) + """
SELECT round(sum(CASE WHEN gold = pred THEN w ELSE 0.0 END) / sum(w), 6) AS accuracy FROM pairs"""

ML_CTE = """
ml AS (
  SELECT doc_id, cls, m::DOUBLE / 100.0 AS prob, (m - 50)::DOUBLE / 10.0 AS logit,
         CASE WHEN cls % 2 = 0 THEN quality ELSE toxic END AS gold
  FROM (SELECT doc_id, quality, toxic, cls, (doc_id * (cls * 7 + 13) + cls * 5) % 100 AS m
        FROM labels, (SELECT unnest([0, 1, 2, 3]) AS cls) c)),
grid AS (SELECT range AS i, CASE WHEN range = 0 THEN -1e-7 WHEN range = 199 THEN 1 + 1e-7
                                 ELSE range / 199.0 END::DOUBLE AS t FROM range(200)),
sweep AS (
  SELECT cls, i, t, tp, fp, fn, tp / (1e-7 + tp + fp) AS p, tp / (1e-7 + tp + fn) AS r FROM (
    SELECT cls, i, t,
           sum(CASE WHEN prob > t AND gold = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
           sum(CASE WHEN prob > t AND gold = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp,
           sum(CASE WHEN prob <= t AND gold = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn
    FROM ml, grid GROUP BY GROUPING SETS ((cls, i, t), (i, t)))),
best AS (
  SELECT * FROM (
    SELECT *, 2.0 * p * r / (p + r + 1e-7) AS f,
           row_number() OVER (PARTITION BY cls ORDER BY 2.0 * p * r / (p + r + 1e-7) DESC, i ASC) AS rn
    FROM sweep) WHERE rn = 1)"""

SIGCE = "(greatest(logit, 0.0) - logit * gold + ln(1 + exp(-abs(logit))))"

ORACLE["d13_mean_loss"] = _with(ML_CTE) + f"""
SELECT round(avg({SIGCE}), 6) AS mean_loss FROM ml"""

ORACLE["d14_best_f1_threshold"] = _with(ML_CTE) + """
SELECT cls, round(f, 6) AS best_f1, round(p, 6) AS precision, round(r, 6) AS recall, round(t, 6) AS threshold
FROM best"""

ORACLE["d15_prf_per_class"] = _with(ML_CTE) + """
SELECT cls, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (
  SELECT cls, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p,
              CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM (
    SELECT m.cls, sum(CASE WHEN gold = 1 AND prob > t THEN 1 ELSE 0 END)::DOUBLE AS tp,
           sum(CASE WHEN gold = 0 AND prob > t THEN 1 ELSE 0 END)::DOUBLE AS fp,
           sum(CASE WHEN gold = 1 AND NOT prob > t THEN 1 ELSE 0 END)::DOUBLE AS fn
    FROM ml m JOIN best b ON b.cls = m.cls GROUP BY GROUPING SETS ((m.cls), ())))"""

ORACLE["d16_auc_per_class"] = _with(ML_CTE) + """
SELECT a.cls, round(sum(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END)
                    / (count(*)), 6) AS auc
FROM ml a JOIN ml b ON a.cls = b.cls AND a.gold = 1 AND b.gold = 0 GROUP BY a.cls"""

LABELS_CTE = """
plabels AS (SELECT doc_id, string_split(trim('[' || lang || ', ' || source || ']', '[]'), ', ') AS labels
            FROM documents),
lmap AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id
         FROM (SELECT DISTINCT unnest(labels) AS label FROM plabels))"""

ORACLE["d17_class_weights"] = _with(LABELS_CTE) + """
SELECT label, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM (
  SELECT label, count(*) AS n_c FROM (
    SELECT unnest(labels) AS label FROM plabels UNION ALL SELECT '[CLS]') GROUP BY label)"""

ORACLE["i2_softmax"] = _with(ML_CTE) + """
SELECT doc_id, cls, round(exp(logit - lse), 6) AS softmax, round(logit - lse, 6) AS log_softmax FROM (
  SELECT *, ln(sum(exp(logit - mx)) OVER (PARTITION BY doc_id)) + mx AS lse FROM (
    SELECT *, max(logit) OVER (PARTITION BY doc_id) AS mx FROM ml))"""

ORACLE["i3_cross_entropy"] = _with(ML_CTE) + """
SELECT doc_id, round(-(max(CASE WHEN cls = y THEN logit END) - max(lse)), 6) AS cross_entropy FROM (
  SELECT m.*, l.quality + 2 * l.toxic AS y,
         ln(sum(exp(logit - mx)) OVER (PARTITION BY m.doc_id)) + mx AS lse FROM (
    SELECT *, max(logit) OVER (PARTITION BY doc_id) AS mx FROM ml) m JOIN labels l USING (doc_id))
GROUP BY doc_id"""

ORACLE["i4_sigmoid_squared_error"] = _with(ML_CTE) + """
SELECT doc_id, cls, round(1.0 / (1.0 + exp(-logit)), 6) AS sigmoid,
       round(pow(1.0 / (1.0 + exp(-logit)) - gold, 2), 6) AS sq_err FROM ml"""

ORACLE["i5_sigmoid_cross_entropy"] = _with(ML_CTE) + f"""
SELECT doc_id, cls, round({SIGCE}, 6) AS loss FROM ml"""

ORACLE["i6_weighted_cross_entropy"] = _with(ML_CTE) + """,
q AS (SELECT cls, CASE WHEN sum(gold) = 0 THEN 0.0 ELSE count(*) / (2.0 * sum(gold)) END AS q FROM ml GROUP BY cls)
SELECT doc_id, round(sum((1 - gold) * logit + (1 + (q - 1) * gold) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0.0))), 6) AS loss
FROM ml JOIN q USING (cls) GROUP BY doc_id"""

ORACLE["i7_safe_div"] = """
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END, 6) AS ratio
FROM lineitem"""

ORACLE["i1_stamp"] = """
SELECT event_id, epoch_us(ts) // 1000 AS epoch_ms, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch_s,
       strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp
FROM events"""

ORACLE["f1_argmax_class"] = _with(ML_CTE) + """
SELECT doc_id, CAST(min(cls) FILTER (WHERE logit = mx) AS INT) AS argmax FROM (
  SELECT *, max(logit) OVER (PARTITION BY doc_id) AS mx FROM ml) GROUP BY doc_id"""

for _name, _op in (("b6_threshold_labels", ">="), ("b6_labels_over_threshold", ">")):
    ORACLE[_name] = _with(ML_CTE) + f"""
SELECT doc_id, coalesce(string_agg(CAST(m.cls AS VARCHAR) || ':' || CAST(prob AS VARCHAR), '|' ORDER BY m.cls)
                        FILTER (WHERE prob {_op} b.t), '') AS labels
FROM ml m JOIN best b ON b.cls = m.cls GROUP BY doc_id"""

ORACLE["b10_drop_padding"] = _with(PAIRS_CTE) + """
SELECT gold, count(*) AS n_real FROM pairs WHERE w > 0 GROUP BY gold"""

ORACLE["d20_compare_rates"] = _with(PAIRS_CTE) + """
SELECT round(avg(CASE WHEN intent_ok THEN 1.0 ELSE 0.0 END), 6) AS intent_rate,
       round(avg(CASE WHEN slot_ok THEN 1.0 ELSE 0.0 END), 6) AS slot_rate,
       round(avg(CASE WHEN intent_ok AND slot_ok THEN 1.0 ELSE 0.0 END), 6) AS frame_rate
FROM (SELECT l_orderkey, max(gold) = max(pred) AS intent_ok, bool_and(gold = pred) AS slot_ok
      FROM pairs GROUP BY l_orderkey)"""

ORACLE["g3_complement_classes"] = _with(PAIRS_CTE) + """
SELECT DISTINCT gold AS cls FROM pairs WHERE gold NOT IN (0, 2, 3, 4, 5, 6, 7)"""

ORACLE["g4_union_results"] = _with(CHUNKS_CTE) + """
SELECT doc_id, count(*) AS split_cnt, CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id"""

ORACLE["j6_parse_label_list"] = _with(LABELS_CTE) + """
SELECT doc_id, len(labels) AS n, array_to_string(labels, '|') AS labels FROM plabels"""

ORACLE["e4_dense_label_ids"] = _with(LABELS_CTE) + """
SELECT label, CAST(id AS INT) AS id FROM lmap"""

ORACLE["g2_label_vocab"] = _with(LABELS_CTE) + """
SELECT DISTINCT label FROM (SELECT unnest(labels) AS label FROM plabels UNION ALL SELECT 'NAME' UNION ALL SELECT '[CLS]')"""

ORACLE["j7_multi_hot"] = _with(LABELS_CTE) + """
SELECT p.doc_id, string_agg(CASE WHEN list_contains(p.labels, m.label) THEN '1' ELSE '0' END, '' ORDER BY m.id) AS multi_hot
FROM plabels p, lmap m GROUP BY p.doc_id"""

ORACLE["j8_one_hot"] = """
SELECT doc_id, string_agg(CASE WHEN c = quality + 2 * toxic THEN '1' ELSE '0' END, '' ORDER BY c) AS one_hot
FROM labels, (SELECT unnest([0, 1, 2, 3]) AS c) x GROUP BY doc_id"""


# ---------------------------------------------------------------- tokens and encoders
H5_EXPR = f"""list_filter(string_split_regex(trim(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(text, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g'), '[\\x{{0}}\\x{{FFFD}}\\p{{Cc}}\\p{{Cf}}]', '', 'g'),
        '([{CJK_RANGES}])', ' \\1 ', 'g'),
        '({PUNCT})', ' \\1 ', 'g'), '[\\s\\x{{2028}}\\x{{2029}}]', ' ', 'g'), ' '), ' +'), lambda x: x <> '')"""

VOCAB_ONLY_CTE = f"""
dtoks AS (SELECT doc_id, {H5_EXPR} AS toks FROM documents),
chars AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS r
          FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents)),
words AS (SELECT w, row_number() OVER (ORDER BY cnt DESC, w) - 1 AS r FROM (
            SELECT w, count(*) AS cnt FROM (SELECT unnest(toks) AS w FROM dtoks) GROUP BY w
            ORDER BY cnt DESC, w LIMIT 2000)),
vocab AS (
  SELECT token, max(id) AS id FROM (
    SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]']) AS token, unnest([0, 1, 2, 3]) AS id
    UNION ALL SELECT c, 4 + r FROM chars
    UNION ALL SELECT '##' || c, 4 + (SELECT count(*) FROM chars) + r FROM chars
    UNION ALL SELECT w, 4 + 2 * (SELECT count(*) FROM chars) + r FROM words)
  GROUP BY token)"""

# Greedy pieces of the tokens in ``utoks``.
WORDPIECE_CTE = """
subs AS (
  SELECT token, s, e, CASE WHEN s > 0 THEN '##' ELSE '' END || substring(token, s + 1, e - s) AS piece FROM (
    SELECT token, s, unnest(range(s + 1, length(token) + 1)) AS e FROM (
      SELECT token, unnest(range(0, length(token))) AS s FROM utoks WHERE length(token) <= 200))),
best AS (SELECT subs.token, s, max(e) AS e FROM subs JOIN vocab v ON v.token = subs.piece GROUP BY subs.token, s),
walk(token, pos, idx, piece) AS (
  SELECT token, 0, 0, NULL::VARCHAR FROM utoks
  UNION ALL
  SELECT w.token, b.e, w.idx + 1,
         CASE WHEN w.pos > 0 THEN '##' ELSE '' END || substring(w.token, w.pos + 1, b.e - w.pos)
  FROM walk w JOIN best b ON b.token = w.token AND b.s = w.pos WHERE w.pos < length(w.token)
),
wp AS (
  SELECT u.token,
         CASE WHEN max(w.pos) = length(u.token) AND length(u.token) <= 200
              THEN list(w.piece ORDER BY w.idx) FILTER (WHERE w.idx > 0) ELSE ['[UNK]'] END AS pieces
  FROM utoks u JOIN walk w USING (token) GROUP BY u.token),
wp_ids AS (
  SELECT x.token, x.pieces, list(v.id ORDER BY x.k) AS ids FROM (
    SELECT token, pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM wp) x
  JOIN vocab v ON v.token = x.piece GROUP BY x.token, x.pieces)"""

VOCAB_CTE = f"{VOCAB_ONLY_CTE}, utoks AS (SELECT DISTINCT unnest(toks) AS token FROM dtoks), {WORDPIECE_CTE}"

ORACLE["a7_read_vocab"] = "SELECT source || '-' || lang || '-' || (doc_id % 50) AS token, max(doc_id) AS id FROM documents GROUP BY 1"

ORACLE["h6_wordpiece"] = _with(VOCAB_CTE) + """
SELECT token, array_to_string(pieces, ' ') AS pieces, array_to_string(ids, ',') AS ids FROM wp_ids"""

ORACLE["h7_tokenize_corpus"] = _with(VOCAB_CTE) + """
SELECT piece, CAST(v.id AS INT) AS id, CAST(sum(cnt) AS BIGINT) AS n FROM (
  SELECT c.cnt, unnest(w.pieces) AS piece FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM dtoks) GROUP BY token) c
  JOIN wp w USING (token)) y JOIN vocab v ON v.token = y.piece GROUP BY piece, v.id"""

ORACLE["h7_piece_rows"] = _with(VOCAB_CTE) + """,
pids AS (
  SELECT doc_id, flatten(list(w.pieces ORDER BY pos)) AS pieces FROM (
    SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM dtoks) x
  JOIN wp_ids w USING (token) GROUP BY doc_id)
SELECT doc_id, CAST(pos - 1 AS INT) AS pos, piece, CAST(v.id AS INT) AS id FROM (
  SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM pids) p JOIN vocab v ON v.token = p.piece"""

ORACLE["j1_encode_single"] = _with(VOCAB_CTE) + """,
firsts AS (SELECT doc_id, list_slice(toks, 1, 509) AS t FROM dtoks),
pids AS (
  SELECT doc_id, flatten(list(w.ids ORDER BY pos)) AS ids FROM (
    SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM firsts) x
  JOIN wp_ids w USING (token) GROUP BY doc_id),
enc AS (SELECT doc_id, [2] || list_slice(ids, 1, 509) || [3] AS body FROM pids)
SELECT doc_id, array_to_string(body || list_transform(range(511 - len(body)), lambda i: 0), ',') AS input_ids,
       CAST(len(body) AS INT) AS n_real, CAST(511 AS INT) AS n_segments
FROM enc"""

ORACLE["c2_ids_to_tokens"] = _with(VOCAB_CTE) + """,
pids AS (
  SELECT doc_id, flatten(list(w.pieces ORDER BY pos)) AS pieces FROM (
    SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM dtoks) x
  JOIN wp_ids w USING (token) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(pieces), 0) AS INT) AS n_pieces, md5(coalesce(array_to_string(pieces, ' '), '')) AS h
FROM documents d LEFT JOIN pids USING (doc_id)"""

PAIRS_TURN_CTE = f"""
tp AS (SELECT conv_id, turn, a, b FROM (
         SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
       WHERE b IS NOT NULL),
tt AS (SELECT conv_id, turn, {H5_EXPR.replace('text', 'a')} AS ta, {H5_EXPR.replace('text', 'b')} AS tb FROM tp)"""

ORACLE["j3_truncate_pair"] = _with(PAIRS_TURN_CTE) + """
SELECT conv_id, turn, CAST(la2 AS INT) AS len_a, CAST(lb2 AS INT) AS len_b,
       array_to_string(list_slice(ta, 1, la2), ' ') || '[SEP]' || array_to_string(list_slice(tb, 1, lb2), ' ') AS pair
FROM (SELECT *, CASE WHEN la + lb > 47 THEN least(la, greatest(24, 47 - lb)) ELSE la END AS la2,
                CASE WHEN la + lb > 47 THEN least(lb, greatest(23, 47 - la)) ELSE lb END AS lb2
      FROM (SELECT *, len(ta) AS la, len(tb) AS lb FROM tt))"""

ORACLE["e5_transition_counts"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT prev_tag, tag, count(*) AS n FROM (
  SELECT coalesce(lag(tag) OVER (PARTITION BY doc_id, chunk_idx ORDER BY j), '[CLS]') AS prev_tag, tag FROM atagged)
GROUP BY prev_tag, tag"""

ORACLE["e1_row_guid"] = """
SELECT doc_id, 'train-' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS guid FROM documents"""

ORACLE["f2_preview"] = f"""
SELECT doc_id, CAST(len({H5_EXPR}) AS INT) AS n_tokens FROM documents ORDER BY doc_id LIMIT 5"""

ORACLE["f3_truncate_seq"] = f"""
SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS h FROM (
  SELECT doc_id, list_slice({H5_EXPR}, 1, 509) AS t FROM documents)"""

ORACLE["b11_skip_null_token"] = _with(CHUNKS_CTE) + """
SELECT doc_id, chunk_idx, CAST(len(t) AS INT) AS n_all, CAST(len(list_filter(t, lambda x: x <> '**NULL**')) AS INT) AS n_kept
FROM (SELECT doc_id, chunk_idx, string_split_regex(regexp_replace(chunk, '[.,!?]', ' **NULL** ', 'g'), ' +') AS t FROM chunks)"""

ORACLE["c7_zip_tags"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT c.doc_id, c.chunk_idx, CAST(count(g.k) AS INT) AS n_pairs,
       md5(coalesce(string_agg(substring(c.chunk, CAST(g.k AS INT), 1) || ' ' || coalesce(t.tag, '[CLS]'), '|' ORDER BY g.k), '')) AS h
FROM chunks c LEFT JOIN (SELECT doc_id, chunk_idx, unnest(range(1, least(length(chunk), 1 + len(string_split(chunk, ' '))) + 1)) AS k FROM chunks) g
  USING (doc_id, chunk_idx) LEFT JOIN atagged t ON t.doc_id = c.doc_id AND t.chunk_idx = c.chunk_idx AND t.j = g.k - 1
GROUP BY c.doc_id, c.chunk_idx"""

ORACLE["j9_masked_slice"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT c.doc_id, c.chunk_idx, CAST(1 + coalesce(t.n, 0) AS INT) AS n,
       '[CLS]' || coalesce(' ' || t.tags, '') AS tags
FROM chunks c LEFT JOIN (SELECT doc_id, chunk_idx, count(*) AS n, string_agg(tag, ' ' ORDER BY j) AS tags
                         FROM atagged GROUP BY doc_id, chunk_idx) t USING (doc_id, chunk_idx)"""


# ---------------------------------------------------------------- requests, pages
REQ_CTE = """
reqs AS (
  SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN substring(body, 1, CAST(floor(length(body) / 2) AS INT)) ELSE body END AS body
  FROM (SELECT doc_id, to_json({'ts': doc_id, 'id': source, 'news': text})::VARCHAR AS body FROM documents)),
parsed AS (
  SELECT doc_id, CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.ts') AS BIGINT) END AS ts,
         CASE WHEN json_valid(body) THEN json_extract_string(body, '$.id') END AS id,
         CASE WHEN json_valid(body) THEN json_extract_string(body, '$.news') END AS news FROM reqs)"""

ORACLE["j12_parse_request"] = _with(REQ_CTE) + """
SELECT doc_id, ts, id, length(news) AS news_len FROM parsed"""

ORACLE["l3_error_rows"] = _with(REQ_CTE) + """
SELECT doc_id, CASE WHEN news IS NOT NULL THEN 'ok' ELSE 'error' END AS status FROM parsed"""

ORACLE["d21_request_counters"] = _with(REQ_CTE) + """
SELECT CASE WHEN news IS NOT NULL THEN 'ok' ELSE 'error' END AS status, count(*) AS n FROM parsed GROUP BY 1"""

ORACLE["j14_build_reply"] = f"""
SELECT p.doc_id, p.id AS req_id, k.names AS answer, sha256(p.id || 'siftkit') AS digest, p.ts + 1 AS server_ts
FROM ({_with(REQ_CTE)} SELECT * FROM parsed WHERE news IS NOT NULL) p
JOIN ({ORACLE["k9_screen_articles"]}) k USING (doc_id)"""

ORACLE["a11_extract_links"] = """
SELECT page_id, CAST(k - 1 AS INT) AS link_idx, regexp_extract(url, '^(https?://[^/]+)', 1) || href AS link FROM (
  SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS k FROM (
    SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) AS l FROM pages))"""

def _unescaped(x):
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


ORACLE["a12_extract_article"] = f"""
SELECT page_id, url, NULL::VARCHAR AS published_time, {_unescaped("regexp_extract_all(html, '<title>(.*?)</title>', 1)[1]")} AS title,
       CAST(len(texts) AS INT) AS n_texts, md5(array_to_string(texts, '|')) AS content_md5, NULL::VARCHAR AS category,
       array_to_string(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: {_unescaped('x')}), '|') AS keywords,
       'news' AS item_type
FROM (SELECT *, list_transform(regexp_extract_all('>' || regexp_replace(coalesce(regexp_extract_all(html, '(?s)<article>(.*)</article>', 1)[1], ''), '<h1>.*?</h1>', '') || '<',
                '>([^<>]+)<', 1), lambda x: {_unescaped('x')}) AS texts FROM pages)"""


# ---------------------------------------------------------------- tagger
TAGSEQ_CTE = """
seq AS (
  SELECT doc_id, chunk_idx, 0 AS j, '[CLS]' AS token, '[CLS]' AS tag FROM chunks
  UNION ALL SELECT doc_id, chunk_idx, j, tok, tag FROM atagged),
em_c AS (SELECT tag, token, count(*) AS c FROM seq GROUP BY tag, token),
em AS (SELECT tag, token, ln((c + 1.0) / (sum(c) OVER (PARTITION BY tag) + (SELECT count(DISTINCT token) FROM seq))) AS logp
       FROM em_c),
bi AS (SELECT doc_id, chunk_idx, lag(tag) OVER (PARTITION BY doc_id, chunk_idx ORDER BY j) AS prev_tag, tag FROM seq),
tr_c AS (SELECT prev_tag, tag, count(*) AS c FROM bi WHERE prev_tag IS NOT NULL GROUP BY prev_tag, tag),
tr AS (SELECT prev_tag, tag, ln((c + 1.0) / (sum(c) OVER (PARTITION BY prev_tag) + (SELECT count(DISTINCT tag) FROM seq))) AS logp
       FROM tr_c)"""

ORACLE["k3_train_tagger"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, TAGSEQ_CTE) + """
SELECT prev_tag, tag, round(logp, 6) AS logp FROM tr"""

ORACLE["k3_tagger_emissions"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, TAGSEQ_CTE) + """
SELECT tag, token, round(logp, 6) AS logp FROM em"""

ORACLE["k5_sequence_score"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, TAGSEQ_CTE) + """
SELECT e.doc_id, e.chunk_idx, round(e.es + coalesce(t.ts, 0.0), 6) AS score
FROM (SELECT doc_id, chunk_idx, sum(logp) AS es FROM seq JOIN em USING (tag, token) GROUP BY doc_id, chunk_idx) e
LEFT JOIN (SELECT doc_id, chunk_idx, sum(logp) AS ts FROM bi JOIN tr USING (prev_tag, tag) GROUP BY doc_id, chunk_idx) t
USING (doc_id, chunk_idx)"""


# ---------------------------------------------------------------- name evaluation, slot maps
GOLD_CTE = """
gfirst AS (SELECT doc_id, name, min(chunk_idx * 100000 + span_idx) AS o FROM names5 GROUP BY doc_id, name),
gold AS (SELECT d.doc_id, coalesce(g.gold, []) AS gold FROM documents d
         LEFT JOIN (SELECT doc_id, list(name ORDER BY o) AS gold FROM gfirst GROUP BY doc_id) g USING (doc_id)),
gp AS (SELECT doc_id, gold, CASE WHEN doc_id % 4 = 0 THEN list_slice(gold, 1, greatest(len(gold) - 1, 0))
                                 ELSE gold END AS pred FROM gold)"""

MATCH = "(len(pred) = len(gold) AND len(list_filter(pred, lambda x: NOT list_contains(gold, x))) = 0)"

ORACLE["g1_is_match"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, GOLD_CTE) + f"""
SELECT doc_id, {MATCH} AS matched FROM gp"""

ORACLE["d18_exact_match_accuracy"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, GOLD_CTE) + f"""
SELECT round(avg(CASE WHEN {MATCH} THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM gp"""

ORACLE["d18_match_accuracy_named"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, GOLD_CTE) + f"""
SELECT round(avg(CASE WHEN {MATCH} THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM gp WHERE len(gold) > 0"""

ORACLE["c6_align_gold_pred"] = _with(CHUNKS_CTE, ALL_SPANS_CTE, GOLD_CTE) + """
SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.gold, p.pred
FROM (SELECT doc_id, array_to_string(gold, '|') AS gold FROM gp) g
FULL OUTER JOIN (SELECT doc_id, array_to_string(pred, '|') AS pred FROM gp WHERE len(pred) > 0) p USING (doc_id)"""

ORACLE["b8_select_slots"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT c.doc_id, c.chunk_idx, coalesce(s.text, '') AS name, '' AS store, '' AS phone, '' AS address, '' AS time
FROM chunks c LEFT JOIN (SELECT * FROM aspans WHERE span_idx = 0) s USING (doc_id, chunk_idx)"""

ORACLE["j10_slot_map"] = _with(CHUNKS_CTE, ALL_SPANS_CTE) + """
SELECT c.doc_id, c.chunk_idx, CAST(CASE WHEN s.names IS NULL THEN 0 ELSE 1 END AS INT) AS n_types,
       coalesce(s.names, '') AS names
FROM chunks c LEFT JOIN (SELECT doc_id, chunk_idx, string_agg(text, '|' ORDER BY span_idx) AS names
                         FROM aspans GROUP BY doc_id, chunk_idx) s USING (doc_id, chunk_idx)"""

ORACLE["d19_score_histogram"] = _with(FIELDS_CTE) + """
SELECT CAST(sum(CASE WHEN score >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS ge4, CAST(sum(CASE WHEN score >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS ge3,
       CAST(sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS ge2, CAST(sum(CASE WHEN score >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS ge1,
       CAST(sum(CASE WHEN score >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS ge0
FROM fields"""
