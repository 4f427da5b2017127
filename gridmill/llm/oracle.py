"""The queries that SQL can express, in SQL. The others are tested against brute force."""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

URL_FILTER = rf"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
place AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {LOWER}) AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ranked AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM place p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""

DECONTAMINATE = f"""
WITH items AS (SELECT item_id::varchar AS item, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
spans AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM docs, (SELECT DISTINCT k FROM windows))),
found AS (SELECT doc_id, i, k, item FROM spans JOIN windows USING (k, g)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found))
  GROUP BY doc_id),
met AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN firsts USING (digest)
"""

# The unsigned crc32 of a text of ASCII letters, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ord(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                           lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def _leaf(n_chars: str) -> str:
    fields = [f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
              for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


def _nodes(name: str, leaves: str) -> str:
    """All nodes (tree, level, pos, n, h) of the trees over leaves (tree, pos, n, h)."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, n, h FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY tree, level, pos // 2, n)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {CRC32.format('doc_id::VARCHAR')} % 7 = 0
         THEN {_leaf('(n_chars::HUGEINT + 1)')} END AS changed
  FROM documents),
placed AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
{_nodes('nodes', 'placed')},
subroots AS (
  SELECT tree, h, level AS up, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
top_leaves AS (SELECT '' AS tree, pos, n, h FROM subroots),
{_nodes('top', 'top_leaves')},
root AS (SELECT h, level FROM top WHERE n = 1),
path AS (
  SELECT p.doc_id, p.leaf, p.tree, s.h AS subroot, p.pos, s.up, s.pos AS top_pos, 0 AS level,
    coalesce(p.changed, p.leaf) AS node, '' AS proof
  FROM placed p JOIN subroots s USING (tree)
  UNION ALL
  SELECT q.doc_id, q.leaf, q.tree, q.subroot, q.pos, q.up, q.top_pos, q.level + 1,
    sha256(CASE WHEN here % 2 = 0 THEN node || coalesce(a.h, b.h, '') ELSE coalesce(a.h, b.h, '') || node END),
    proof || coalesce(a.h, b.h, '')
  FROM (SELECT *, CASE WHEN level < up THEN pos >> level ELSE top_pos >> (level - up) END AS here FROM path) q
    LEFT JOIN nodes a ON q.level < up AND a.tree = q.tree AND a.level = q.level AND a.pos = xor(here, 1)
    LEFT JOIN top b ON q.level >= up AND b.level = q.level - up AND b.pos = xor(here, 1)
  WHERE q.level < up + (SELECT level FROM root))
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = root.h AS verified
FROM path, root WHERE path.level = up + root.level
"""

ORACLE = {"op4_url_filter": URL_FILTER, "op9_decontaminate": DECONTAMINATE, "op11_warc": WARC,
          "op12_merkle_manifest": MERKLE}
