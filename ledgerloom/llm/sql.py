"""SQL for a second engine, giving the rows of the registered queries by the plainest way."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents),
r AS (
  SELECT doc_id, plain,
         first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(plain) AS text_sha256 FROM r
"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(3, len(w)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS p FROM d)),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 85 * (x.size + y.size - p.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS size, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
x AS (SELECT doc_id, pos, pos + 19 <= size AND row_number() OVER (PARTITION BY array_to_string(w[pos:pos + 19], ' '), pos + 19 <= size ORDER BY doc_id, pos) > 1 AS later, w[pos] AS word FROM p),
k AS (SELECT doc_id, pos, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM x),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

#: Items that stand in a text word for word, as all of them do in the tables.
CONTAINED_ITEMS = r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ' ') || ' ' AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)
SELECT doc_id, item_id, CAST(len(w) AS INTEGER) AS equal_words, CAST(len(w) AS INTEGER) AS item_words
FROM d JOIN b ON contains(t, ' ' || array_to_string(w, ' ') || ' ')
"""

#: The notices that the tables' texts have as lines.
LICENCE_LINES = """
WITH n(line, family) AS (VALUES
  ('Licensed under the Apache License, Version 2.0.', 'apache-2.0'),
  ('Released under the MIT License.', 'mit'),
  ('This work is licensed under the GNU General Public License, version 3.', 'gpl-3.0'),
  ('Licensed under CC BY-NC 4.0.', 'cc-by-nc')),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS paragraph FROM documents)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, family, CAST(1.0 AS DOUBLE) AS similarity, true AS confirmed
FROM l JOIN n USING (line)
"""

#: The 256 entries of the crc32 table, and the crc32 of a list of bytes with it.
_CRC_TABLE = ("(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t "
              "FROM range(256) r(i))")


def _crc32(data: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])))"


def _merkle(levels: int = 7, group_levels: int = 4) -> str:
    """The tree level by level, as many as 8**levels rows of a group and 8**group_levels groups need; n: a level's
    nodes, with the digests left and right of each."""
    fields = " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"c AS {_CRC_TABLE}",
             f"told AS (SELECT *, CASE WHEN {_crc32(digits)} % 3 = 0 THEN {lower} ELSE text END AS text2 FROM documents, c)",
             f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({fields.format(text="text")}) AS leaf, sha256({fields.format(text="text2")}) AS claimed FROM told)""",
             "placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS size FROM leaves)"]

    def tree(name: str, given: str, most: int) -> str:
        parts.append(f"{name}0 AS ({given})")
        for k in range(most):
            near = "PARTITION BY g, idx // 8 ORDER BY idx ROWS BETWEEN"
            parts.append(f"""{name}n{k} AS (SELECT g, idx, coalesce(string_agg(d, '') OVER ({near} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
              coalesce(string_agg(d, '') OVER ({near} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k} WHERE size > {8 ** k})""")
            parts.append(f"{name}{k + 1} AS (SELECT g, size, idx // 8 AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE size > {8 ** k} GROUP BY ALL)")
        return " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE size <= {8 ** k}" for k in range(most + 1))

    tops = tree("x", "SELECT g, size, idx, leaf AS d FROM placed", levels)
    parts.append(f"subroots AS ({tops})")
    parts.append("ranked AS (SELECT '' AS g, g AS own, d, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS size FROM subroots)")
    root = tree("y", "SELECT g, size, idx, d FROM ranked", group_levels)
    parts.append(f"roots AS ({root})")
    parts.append("""f0 AS (SELECT p.*, s.d AS subroot, k.idx AS gidx, q.d AS root, claimed AS f, '' AS proof
      FROM placed p JOIN subroots s USING (g) JOIN ranked k ON k.own = p.g CROSS JOIN (SELECT d FROM roots) q)""")
    steps = [(f"xn{k}", "n.g = f.g", f"f.idx // {8 ** k}") for k in range(levels)] + [(f"yn{k}", "true", f"f.gidx // {8 ** k}") for k in range(group_levels)]
    for i, (nodes, same, at) in enumerate(steps):
        parts.append(f"""f{i + 1} AS (SELECT f.* EXCLUDE (f, proof), CASE WHEN n.idx IS NULL THEN f ELSE sha256(a || f || b) END AS f, proof || coalesce(a || b, '') AS proof
          FROM f{i} f LEFT JOIN {nodes} n ON {same} AND n.idx = {at})""")
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}")


MERKLE = _merkle()

#: UTF-8 bytes of a text of ASCII characters and U+00C0 to U+00FF.
_BYTES = ("flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
          "ELSE [195::BIGINT, CAST(unicode(x) - 64 AS BIGINT)] END))")

VARIANTS = rf"""
WITH RECURSIVE c AS {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32(_BYTES.format(text="doc_id || ':' || run"))} AS h FROM runs, c),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON b.word = v.word),
r AS (SELECT word, word AS here, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""

#: The markup that the tables' pages have: one article of headings and paragraphs.
ARTICLES = r"""
WITH b AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '\s+', ' ', 'g'))) AS blocks
  FROM pages),
t AS (SELECT page_id, url, regexp_replace(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '&amp;?', '&', 'g') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
