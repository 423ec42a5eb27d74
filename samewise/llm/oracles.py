"""SQL that gives the rows of queries.py where SQL can express them over whole tables.

None for problem 6 (tokenizer) and 8 (model), nor for fuzzy passages and coverage by tiles; the tests hold those against brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

_RE2_SPACE = "[\\t-\\r \\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

_RECORDS = "rec AS (SELECT id, min(content) AS c FROM records WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id)"

_SETS = f"""{_RECORDS},
w AS (SELECT id, regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}]+') AS w FROM rec),
e AS (
  SELECT DISTINCT 'records' AS src, id, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)
  UNION
  SELECT DISTINCT 'docs', id, x FROM (SELECT id, unnest(atoms) AS x FROM docs WHERE id IS NOT NULL) WHERE x IS NOT NULL),
n AS (SELECT src, id, count(*) AS n FROM e GROUP BY src, id)"""

_P1 = f"""
WITH {_SETS},
p AS (SELECT a.src, a.id AS id_a, b.id AS id_b, count(*) AS c FROM e a JOIN e b ON a.src = b.src AND a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT p.src, id_a, id_b FROM p JOIN n x ON p.src = x.src AND id_a = x.id JOIN n y ON p.src = y.src AND id_b = y.id WHERE c * 5 >= (x.n + y.n - c) * 3
"""


_P1_GROUPS = f"""
WITH RECURSIVE {_SETS},
k AS (SELECT src, id, sha256(string_agg(x, chr(1) ORDER BY x)) AS key FROM e GROUP BY src, id),
m AS (SELECT src, id, min(id) OVER (PARTITION BY src, key) AS class_id FROM k),
r AS (SELECT e.* FROM e JOIN m ON e.src = m.src AND e.id = m.id WHERE m.id = m.class_id),
p AS (SELECT a.src, a.id AS a, b.id AS b, count(*) AS c FROM r a JOIN r b ON a.src = b.src AND a.x = b.x AND a.id < b.id GROUP BY ALL),
l AS (SELECT p.src, a, b FROM p JOIN n x ON p.src = x.src AND a = x.id JOIN n y ON p.src = y.src AND b = y.id WHERE c * 5 >= (x.n + y.n - c) * 3),
near AS (SELECT src, a, b FROM l UNION ALL SELECT src, b, a FROM l),
reach AS (SELECT src, class_id AS a, class_id AS b FROM m UNION SELECT reach.src, reach.a, near.b FROM reach JOIN near ON reach.src = near.src AND reach.b = near.a),
g AS (SELECT src, a, min(b) AS group_id FROM reach GROUP BY src, a),
d AS (SELECT src, a, count(*) AS links FROM near GROUP BY src, a)
SELECT m.src, m.id, m.class_id, g.group_id, coalesce(links, 0) AS links FROM m JOIN g ON m.src = g.src AND m.class_id = g.a LEFT JOIN d ON m.src = d.src AND m.class_id = d.a
"""


def _spelled(x: str) -> str:
    trimmed = f"regexp_replace({x}, '^{_RE2_SPACE}+|{_RE2_SPACE}+$', '', 'g')"
    return f"regexp_replace(replace({trimmed}, '\\', '/'), '^(\\./)+', '')"


_P2 = f"""
WITH {_RECORDS},
t AS (
  SELECT id AS owner, true AS own, c AS text FROM rec
  UNION ALL SELECT {_spelled('superset')}, false, e.text FROM (SELECT superset, unnest(extra) AS e FROM containment_pairs)),
w AS (SELECT owner, own, list_filter(regexp_split_to_array(text, '{_RE2_SPACE}+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
r AS (SELECT owner, own, i, array_to_string(w[i + 1:i + 32], ' ') AS x FROM (SELECT owner, own, w, unnest(range(len(w) - 31)) AS i FROM w WHERE len(w) >= 32)),
s AS (SELECT x FROM r GROUP BY x HAVING count(DISTINCT owner) + max(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) > 1),
f AS (SELECT DISTINCT owner AS id, i FROM r WHERE own AND x IN (SELECT x FROM s)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS k FROM (SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= 32 THEN 0 ELSE 1 END AS fresh FROM f))
SELECT id, min(i) AS start_word, max(i) + 32 AS end_word FROM g GROUP BY id, k
"""

_P3 = f"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, list_transform(list_concat([subset, superset], coalesce(final_supersets, [])), lambda x: {_spelled('x')}) AS ids FROM containment_pairs),
e AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(ids) AS x FROM rows_) WHERE x IS NOT NULL),
l AS (SELECT DISTINCT min(x) OVER (PARTITION BY r) AS a, x AS b FROM e),
near AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
reach AS (SELECT x, y FROM near UNION SELECT reach.x, near.y FROM reach JOIN near ON reach.y = near.x)
"""

_P4_SPACE = "\\x1C-\\x1F" + _RE2_SPACE[1:-1]


def _p4_words(x: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), ' ')"


_P4 = f"""
WITH rec AS (
  SELECT 'records' AS src, id, min(content) AS c FROM records WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id
  UNION ALL SELECT 'docs', id, min(text) FROM docs WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id),
b AS (SELECT src, id, c, regexp_replace(c, '^[{_P4_SPACE}\\x{{FEFF}}]+|[{_P4_SPACE}\\x{{FEFF}}]+$', '', 'g') AS body FROM rec),
jk AS (SELECT src, id, body, unnest(CASE WHEN starts_with(body, '{{') AND json_valid(body) THEN json_keys(body) ELSE [] END) AS k FROM b),
jf AS (SELECT src, id, {_p4_words('k')} AS k, {_p4_words("coalesce(json_extract_string(body, '/' || replace(replace(k, '~', '~0'), '/', '~1')), 'null')")} AS v FROM jk),
ln AS (SELECT src, id, regexp_replace(l, '^[{_P4_SPACE}\\x{{FEFF}}]+|[{_P4_SPACE}\\x{{FEFF}}]+$', '', 'g') AS l FROM (SELECT src, id, unnest(regexp_split_to_array(body, '\\r\\n|\\r|\\n')) AS l FROM b WHERE NOT starts_with(body, '{{'))),
lw AS (SELECT src, id, l, regexp_full_match(l, '(?s)[^{_P4_SPACE}:=]+(:|[{_P4_SPACE}]*=)([{_P4_SPACE}]+.*)?') AND regexp_matches(regexp_extract(l, '^[^{_P4_SPACE}:=]+'), '[\\p{{L}}\\p{{N}}]') AS ok FROM ln WHERE regexp_matches(l, '[\\p{{L}}\\p{{N}}]')),
lo AS (SELECT src, id FROM lw GROUP BY src, id HAVING bool_and(ok) AND count(*) >= 2),
lf AS (SELECT lw.src, lw.id, {_p4_words(f"regexp_extract(l, '^[^{_P4_SPACE}:=]+')")} AS k, {_p4_words(f"regexp_replace(l, '^[^{_P4_SPACE}:=]+', '')")} AS v FROM lw JOIN lo ON lw.src = lo.src AND lw.id = lo.id),
f AS (SELECT src, id, string_agg(k || chr(2) || v, chr(1) ORDER BY k, v) AS said, max(length(k) + length(v)) AS n FROM (SELECT * FROM jf UNION ALL SELECT * FROM lf) GROUP BY src, id),
a AS (SELECT b.src, b.id, coalesce('f' || f.said, 't' || {_p4_words('c')}) AS said, coalesce(f.n, length({_p4_words('c')})) AS n FROM b LEFT JOIN f ON b.src = f.src AND b.id = f.id),
g AS (SELECT src, id, min(id) OVER s AS keep_id, count(*) OVER s AS copies FROM a WHERE n > 0 WINDOW s AS (PARTITION BY src, said))
"""

_P5 = f"""
WITH {_RECORDS},
t AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS term FROM rec) GROUP BY id, term),
m AS (SELECT term, count(*) AS m FROM t GROUP BY term),
k AS (SELECT count(*) AS k FROM rec)
SELECT id, t.term FROM t JOIN m ON t.term = m.term, k WHERE n * ln(k / m) >= 1.7 * ln(k)
"""

_P5_TERMS = f"""
WITH {_RECORDS},
t AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}]{{2,}}')) AS term FROM rec) GROUP BY id, term),
m AS (SELECT term, sum(n) * 9.0 / (SELECT sum(n) FROM t) AS r FROM t GROUP BY term),
o AS (SELECT id, t.term, n, r, row_number() OVER w AS k, sum(n) OVER w / (1 + sum(r) OVER w) AS level FROM t JOIN m ON t.term = m.term WINDOW w AS (PARTITION BY id ORDER BY n / r DESC, t.term ROWS UNBOUNDED PRECEDING)),
x AS (SELECT id, arg_max(level, k) AS x FROM o WHERE n > level * r GROUP BY id),
p AS (SELECT o.id, term, greatest(n / x - r, 0) AS p FROM o JOIN x ON o.id = x.id),
q AS (SELECT id, term, p / sum(p) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY p DESC, term) AS rank FROM p)
SELECT id, term, rank, round(p, 6) AS p FROM q WHERE rank <= 10
"""

# compatibility forms as far as the test texts have them: full-width characters, ligatures, superscripts
_WIDE = "".join(map(chr, [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_FORMS = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("²", "2"), ("³", "3"), ("¹", "1"), ("ª", "a"), ("º", "o"), ("™", "tm"), ("№", "no"), ("…", "..."), ("½", "1⁄2"), ("¼", "1⁄4"), ("¾", "3⁄4")]


def _plain(x: str) -> str:
    for a, b in _FORMS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower(strip_accents(nfc_normalize(translate({x}, '{_WIDE}', '{_NARROW}'))))"


_P7 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_plain('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all({_plain('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw WHERE len(w) >= 12)),
ir AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dr JOIN ir ON dr.x = ir.x
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p1_groups": _P1_GROUPS,
        "p2_found": _P2,
        "p2_shared_words": f"SELECT id, CAST(sum(end_word - start_word) AS BIGINT) AS shared_words, count(*) AS stretches FROM ({_P2}) GROUP BY id",
        "p3_found": f"{_P3} SELECT x AS id, min(y) AS group_id FROM reach GROUP BY x",
        "p3_group_sizes": f"{_P3}, g AS (SELECT x, min(y) AS group_id FROM reach GROUP BY x) SELECT group_id, count(*) AS members FROM g GROUP BY group_id",
        "p4_found": f"{_P4} SELECT src, keep_id, id FROM g WHERE copies > 1",
        "p4_copies": f"{_P4} SELECT src, keep_id, copies FROM g WHERE copies > 1 AND id = keep_id",
        "p5_found": _P5,
        "p5_terms": _P5_TERMS,
        "p7_found": _P7,
    }
