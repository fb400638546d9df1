"""DuckDB SQL for the queries that it can express."""

OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens,
    length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS t_len,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS r_len
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(t_len + 13 + CASE WHEN opens THEN r_len + 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP10 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), windows AS (
  SELECT row_id, pos, array_to_string(w[pos:pos + 7], ' ') AS gram
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 6)) AS pos FROM words WHERE len(w) > 8)
), twice AS (
  SELECT row_id, pos FROM (SELECT row_id, pos, count(*) OVER (PARTITION BY row_id, gram) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT row_id, count(DISTINCT pos + d) AS n_repeat_words FROM twice, range(8) AS r(d) GROUP BY row_id
), lines AS (
  SELECT row_id, host, md5(text) AS body, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal
  FROM (SELECT row_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)
), duplicates AS (
  SELECT row_id, sum(k - 1) AS n_dup_lines FROM (SELECT row_id, line, count(*) AS k FROM lines WHERE n > 0 GROUP BY ALL) GROUP BY row_id
), texts AS (SELECT host, count(DISTINCT md5(text)) AS n_texts FROM docs GROUP BY host),
common AS (
  SELECT host, normal FROM (SELECT host, normal, count(DISTINCT body) AS k FROM lines WHERE normal <> '' GROUP BY ALL) JOIN texts USING (host)
  WHERE k >= 10 AND k > least(200, n_texts * 0.02)
), taken AS (SELECT row_id, sum(n) AS n_common FROM lines JOIN common USING (host, normal) GROUP BY row_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_common, 0)::BIGINT AS n_common_words
  FROM docs JOIN words USING (row_id) LEFT JOIN repeats USING (row_id) LEFT JOIN duplicates USING (row_id) LEFT JOIN taken USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_common_words >= 0.3 * n_words AS kept, n_common_words
FROM counted
"""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS pos FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM sizes
  UNION
  SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT root, min(node) AS m FROM reach GROUP BY root)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id)::BIGINT AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON root = doc_id
"""

#: The edit distance of this engine counts bytes; letters beyond ASCII are put on single bytes for it.
BEYOND = "àâäáãçéèêëíìîïñóòôöõúùûüßœ"
SINGLE = " || ".join(f"chr({c})" for c in range(1, 32) if c not in (9, 10, 13))

OP2 = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (SELECT row_id, doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM docs),
norm AS (SELECT *, lower(trim(raw, ' ' || chr(9) || chr(13))) AS line FROM lines),
firsts AS (
  SELECT line, min({{'d': coalesce(doc_id, -9223372036854775808), 'p': pos}}) AS first FROM norm WHERE line <> '' GROUP BY line
), cut AS (SELECT *, length(line) AS n, length(line) // 3 AS k, translate(line, '{BEYOND}', {SINGLE}) AS bytes FROM firsts WHERE length(line) >= 20),
near AS (
  SELECT DISTINCT a.line FROM cut a JOIN cut b ON abs(a.n - b.n) <= 2 AND b.first < a.first
    AND (a.line[:a.k] = b.line[:a.k] OR a.line[a.n - a.k + 1:] = b.line[b.n - a.k + 1:] OR contains(b.line, a.line[a.k + 1:a.n - a.k])) AND levenshtein(a.bytes, b.bytes) <= 2
), fates AS (
  SELECT row_id, doc_id, pos, CASE WHEN f.line IS NULL THEN '.' WHEN f.first <> {{'d': coalesce(doc_id, -9223372036854775808), 'p': pos}} THEN 'x' WHEN n.line IS NOT NULL THEN 'n' ELSE '.' END AS fate
  FROM norm LEFT JOIN firsts f ON f.line = norm.line LEFT JOIN near n ON n.line = norm.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (fate = 'x')::BIGINT AS n_equal, count(*) FILTER (fate = 'n')::BIGINT AS n_near, string_agg(fate, '' ORDER BY pos) AS flags FROM fates GROUP BY row_id, doc_id
"""

SQL = {"op2_line_dedup": OP2, "op3_minhash_near_dedup": OP3, "op5_chat_format": OP5, "op10_quality_rules": OP10}
