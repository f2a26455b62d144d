"""SQL of queries whose statement is long."""

# CRC-32 of ASCII strings: eight shifts per byte, by the reversed polynomial. ``{x}`` is the string.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({x}) + 1), lambda i: ascii({x}[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)
  ), 4294967295::BIGINT)"""

# Stretches of words equal to the word q further on are islands; the period of one is its smallest if no island of a
# smaller period covers it.
OP11 = rf"""
WITH ids AS (SELECT row_number() OVER () AS doc, doc_id, CAST(doc_id AS VARCHAR) AS x,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
h AS (SELECT *, len(words) AS n, {CRC32.format(x="x")} AS h FROM ids),
g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc, i, CASE WHEN i >= a THEN words[a + (i - a) % p + 1] ELSE words[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
same AS (SELECT l.doc, l.i, r.i - l.i AS q, l.i - row_number() OVER (PARTITION BY l.doc, r.i - l.i ORDER BY l.i) AS island
  FROM w l JOIN w r ON l.doc = r.doc AND l.word = r.word AND r.i > l.i),
islands AS (SELECT doc, min(i) AS start, count(*) + q AS length, q AS period FROM same
  GROUP BY doc, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM islands x WHERE NOT EXISTS (SELECT 1 FROM islands y WHERE y.doc = x.doc AND y.period < x.period
  AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
per AS (SELECT doc, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc),
dropped AS (SELECT DISTINCT doc, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.doc, string_agg(word, ' ' ORDER BY i) AS collapsed FROM w ANTI JOIN dropped d ON w.doc = d.doc AND w.i = d.i GROUP BY w.doc)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
  CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM ids LEFT JOIN per USING (doc) LEFT JOIN kept USING (doc)
"""

# Rows of a conversation one after another; for every state the lightest (cost, audit) with what it has written.
# Between rows none, one or two turns are inserted: more would come back to the same state.
OP12 = rf"""
WITH RECURSIVE plain AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
kinds AS (SELECT *, {CRC32.format(x="x")} % 20 AS kind FROM plain),
damaged AS (
  SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, coalesce(CAST(conv AS VARCHAR), 'none') AS c, role[1] AS initial,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM placed),
counts AS (
  SELECT conv, c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv, c),
inserts(a, b, cost, letters, turns) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])),
edits(letter, q, initial, role, r, cost) AS (VALUES
  ('K', 0, 's', NULL, 1, 0), ('K', 0, 'u', NULL, 2, 0), ('K', 1, 'u', NULL, 2, 0), ('K', 2, 'a', NULL, 3, 0), ('K', 3, 'u', NULL, 2, 0),
  ('R', 0, NULL, 'user', 2, 2), ('R', 1, NULL, 'user', 2, 2), ('R', 2, NULL, 'assistant', 3, 2), ('R', 3, NULL, 'user', 2, 2),
  ('D', 0, NULL, NULL, 0, 3), ('D', 1, NULL, NULL, 1, 3), ('D', 2, NULL, NULL, 2, 3), ('D', 3, NULL, NULL, 3, 3)),
walk(c, i, state, cost, audit, turns) AS (
  SELECT c, 0::BIGINT, 0, 0::BIGINT, '', []::VARCHAR[] FROM counts
  UNION ALL
  SELECT c, i, state, cost, audit, turns FROM (
    SELECT w.c, w.i + 1 AS i, e.r AS state, w.cost + n.cost + e.cost + (e.letter <> 'D' AND f.fault = 't')::INT AS cost,
      w.audit || n.letters || e.letter AS audit,
      list_concat(list_concat(w.turns, n.turns), CASE e.letter WHEN 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END) AS turns
    FROM walk w JOIN faults f ON f.c = w.c AND f.i = w.i + 1 JOIN inserts n ON n.a = w.state
    JOIN edits e ON e.q = n.b AND (e.initial IS NULL OR e.initial = f.initial) AND (e.letter = 'D' OR f.fault NOT IN ('b', 'd')))
  QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
ended AS (
  SELECT c, w.cost + n.cost AS cost, audit || letters AS audit, list_concat(w.turns, n.turns) AS turns
  FROM walk w JOIN counts USING (c) JOIN inserts n ON n.a = w.state WHERE w.i = counts.n AND n.b IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY w.cost + n.cost, audit || letters) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON o.conv_id IS NOT DISTINCT FROM counts.conv LEFT JOIN ended ON counts.c = ended.c
"""

# Windows of documents of every length that a window of an item has meet those windows by equality.
OP13 = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(words), 10) AS k, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS i FROM items WHERE len(words) > 0)),
own AS (SELECT doc, i, k, array_to_string(words[i:i + k - 1], ' ') AS w
  FROM (SELECT doc, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
met AS (SELECT doc, i, k, item FROM own JOIN windows USING (k, w)),
hits AS (SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + k)) AS place FROM met) GROUP BY doc),
named AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, item FROM met) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (doc) LEFT JOIN named USING (doc)
"""
