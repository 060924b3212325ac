"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

# SHA-1 in base32: each 5 hexadecimal digits are 4 characters
_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           "1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(floor(i / 4) AS BIGINT), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31), 1)), '')")

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT t, max(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN m USING (t)
"""


def _shingles(table: str, key: str, k: int, word: str) -> str:
    """(id, gram) of the distinct k-word shingles; fewer words are one shingle."""
    return f"""
  SELECT DISTINCT id, gram FROM (
    SELECT id, unnest(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))
                           WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE [] END) AS gram
    FROM (SELECT {key} AS id, regexp_extract_all({_LOWER.format('text')}, '{word}') AS w FROM {table}))"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_SPACE = r"[^ \t\n\x0B\f\r]+"

# an item with fewer words than a shingle stands where all its words stand in a row
DECONTAMINATE = f"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS w FROM documents),
b AS ({_shingles('benchmark', 'item_id', 5, _ALNUM)}),
few AS (SELECT DISTINCT len(string_split(gram, ' ')) - 1 AS m FROM b WHERE gram LIKE 'short %'),
d AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM w
      UNION SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: 'short ' || array_to_string(w[i:i + m - 1], ' '))) FROM w, few),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
x AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM d JOIN b ON d.gram = b.gram GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, k AS n_shared, k / n AS containment
FROM x JOIN n ON n.id = x.item_id WHERE 100 * k >= 80 * n
"""

NEAR_DEDUP = f"""
WITH RECURSIVE s AS ({_shingles('documents', 'doc_id', 2, _NOT_SPACE)}),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
f AS (SELECT gram, count(*) AS c FROM s GROUP BY gram),
-- a linked pair shares one of the fifth of either set that is rarest
r AS (SELECT s.id, s.gram, n.n, row_number() OVER (PARTITION BY s.id ORDER BY f.c, s.gram) AS pos FROM s JOIN n USING (id) JOIN f USING (gram)),
pre AS (SELECT id, gram, n FROM r WHERE pos <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.gram = b.gram AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
both_n AS (SELECT a, b, count(*) AS k FROM cand JOIN s x ON x.id = a JOIN s y ON y.id = b AND y.gram = x.gram GROUP BY a, b),
link AS (SELECT a, b FROM both_n JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS id, b AS root FROM edge UNION SELECT e.a, reach.root FROM edge e JOIN reach ON reach.id = e.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m.root, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m.root, doc_id)) AS kept
FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = doc_id
"""

# CRC-32 by its table of 256 values (reflected polynomial 0xEDB88320); {0}: a list of bytes
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t)"""
_CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
# letters up to U+00FF as UTF-8 bytes
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(c) - 64] END))"

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY ALL),
c AS (SELECT run, k, {_CRC.format(_BYTES.format("concat(doc_id, ':', run)"))} AS h, doc_id IS NOT NULL AS named FROM u, crc),
m AS (SELECT CASE WHEN named AND h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM c),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
e AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM d),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT e.word, e.n, w.word, w.n FROM e JOIN w ON w.word = e.rest
         UNION SELECT w.word, w.n, e.word, e.n FROM e JOIN w ON w.word = e.rest),
best AS (SELECT word, n, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS pos, count(*) OVER (PARTITION BY word) AS n_near FROM near),
f AS (SELECT word, n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best WHERE pos = 1),
climb AS (SELECT word, form AS goal FROM f WHERE form IS NOT NULL UNION ALL SELECT climb.word, f.form FROM climb JOIN f ON f.word = climb.goal WHERE f.form IS NOT NULL),
ends AS (SELECT climb.word, goal FROM climb LEFT JOIN f ON f.word = climb.goal WHERE f.form IS NULL)
SELECT w.word, f.form, coalesce(ends.goal, w.word) AS root, w.n, coalesce(f.n_near, 0) AS n_near, f.form_n
FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN ends ON ends.word = w.word
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + "))"

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, lang, {_LEAF.format('n_chars')} AS leaf, {_LEAF.format('(CAST(n_chars AS HUGEINT) + 1)')} AS more,
             {_CRC.format(_BYTES.format('CAST(doc_id AS VARCHAR)'))} % 7 = 0 AS changed FROM documents, crc),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) AS tree, count(*) OVER (PARTITION BY lang) AS n,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id IS NOT NULL, doc_id, leaf) - 1 AS pos FROM d),
low AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM l
        UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroot AS (SELECT tree, h FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree - 1 AS pos, h, count(*) OVER () AS n FROM subroot
         UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
node AS (SELECT tree, level, pos, h, n FROM low UNION ALL SELECT 0, level, pos, h, n FROM high),
climb AS (SELECT doc_id, leaf, tree AS own, tree, 0 AS level, pos, n, CASE WHEN changed AND n_more THEN more ELSE leaf END AS folded, '' AS proof FROM (SELECT *, more <> leaf AS n_more FROM l)
          UNION ALL
          SELECT doc_id, leaf, own, CASE WHEN c.n = 1 THEN 0 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END,
                 CASE WHEN c.n = 1 THEN c.own - 1 ELSE c.pos // 2 END, CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroot) ELSE (c.n + 1) // 2 END,
                 CASE WHEN c.n = 1 THEN folded WHEN s.h IS NULL THEN sha256(folded) WHEN c.pos % 2 = 1 THEN sha256(s.h || folded) ELSE sha256(folded || s.h) END,
                 CASE WHEN c.n = 1 THEN proof ELSE proof || coalesce(s.h, '') END
          FROM climb c LEFT JOIN node s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
          WHERE c.n > 1 OR c.tree > 0)
SELECT doc_id, leaf, subroot.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM climb JOIN subroot ON subroot.tree = climb.own, (SELECT h FROM high WHERE n = 1) root WHERE climb.tree = 0 AND climb.n = 1
"""
