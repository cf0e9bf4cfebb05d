"""DuckDB SQL of the operators that SQL can express."""

#: The 256 values of the CRC-32 polynomial division, and a text's CRC from the bytes of its hexadecimal form.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes; crc_table must be in scope."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT keyed.*, {crc32("k")} % 20 AS h FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS face
  FROM damaged),
judged AS (
  SELECT *, CASE WHEN face = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(face, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault,
    left(role, 1) AS kind, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_kind
  FROM ordered),
convs AS (SELECT DISTINCT conv_id FROM conversations),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (next_kind IS NOT NULL AND kind || next_kind NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
inserts(s, s2, ins_cost, ins) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
edits(s, edit, kind, s2, edit_cost) AS (VALUES
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
  (0, 'R', NULL, 2, 2), (1, 'R', NULL, 2, 2), (2, 'R', NULL, 3, 2), (3, 'R', NULL, 2, 2),
  (0, 'D', NULL, 0, 3), (1, 'D', NULL, 1, 3), (2, 'D', NULL, 2, 3), (3, 'D', NULL, 3, 3)),
best(conv_id, i, s, b) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'c': 0::BIGINT, 'a': ''}} FROM convs
  UNION ALL
  SELECT j.conv_id, j.i, e.s2, min({{'c': b.b.c + ins_cost + edit_cost + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 1 ELSE 0 END, 'a': b.b.a || ins || edit}})
  FROM best b JOIN inserts n ON n.s = b.s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1
  JOIN edits e ON e.s = n.s2 AND (e.kind IS NULL OR e.kind = j.kind) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY j.conv_id, j.i, e.s2),
chosen AS (
  SELECT c.conv_id, min({{'c': b.b.c + ins_cost, 'a': b.b.a || ins}}) AS b
  FROM convs c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = coalesce(n, 0) JOIN inserts n ON n.s = b.s WHERE n.s2 IN (0, 3) GROUP BY c.conv_id),
walk(conv_id, pos, i, s, message) AS (
  SELECT conv_id, 0::BIGINT, 0::BIGINT, 0, NULL::VARCHAR FROM chosen
  UNION ALL
  SELECT w.conv_id, w.pos + 1, CASE WHEN x.edit = 'I' THEN w.i ELSE w.i + 1 END,
    CASE WHEN x.edit = 'D' THEN w.s WHEN x.edit = 'K' AND j.kind = 's' THEN 1 WHEN w.s = 2 THEN 3 ELSE 2 END,
    CASE x.edit WHEN 'K' THEN j.role || ':' || j.text WHEN 'D' THEN NULL
      ELSE CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN x.edit = 'R' THEN j.text ELSE '' END END
  FROM walk w JOIN (SELECT conv_id, unnest(range(1, length(b.a) + 1)) AS pos, b.a[unnest(range(1, length(b.a) + 1))] AS edit FROM chosen) x
    ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.pos = w.pos + 1
  LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1),
texts AS (SELECT conv_id, sha256(coalesce(string_agg(message, chr(10) ORDER BY pos), '')) AS repaired_sha256 FROM walk GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, repaired_sha256
FROM chosen c JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RESAMPLE = rf"""
WITH {CRC_TABLE},
words AS (
  SELECT 'd' AS side, rowid AS r, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
  UNION ALL SELECT 'b', 0, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
distinct_words AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), crc_table),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN distinct_words USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
totals AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM words JOIN distinct_words USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n + n) % n)) // n, 0)::BIGINT AS weight,
    ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN totals USING (r)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""

JACCARD = rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM texts),
classes AS (SELECT dense_rank() OVER (ORDER BY list_sort(s)) AS c, r, doc_id, s FROM sets),
points AS (SELECT c, min(doc_id) AS doc, any_value(s) AS s, len(any_value(s)) AS n FROM classes GROUP BY c),
members AS (SELECT c, n, unnest(s) AS shingle FROM points),
common AS (
  SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM members a JOIN members b ON a.shingle = b.shingle AND a.c < b.c
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (an + bn - shared)),
reach(a, b) AS (
  SELECT c, c FROM points
  UNION SELECT reach.a, e.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = reach.b),
named AS (SELECT reach.a AS c, min(doc) AS component_id FROM reach JOIN points ON points.c = reach.b GROUP BY reach.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id FROM classes JOIN named USING (c)
"""

SQL: dict[str, str] = {"op11_repair_conversations": REPAIR, "op12_resample": RESAMPLE, "op13_jaccard_groups": JACCARD}
