"""DuckDB SQL for the queries that SQL can express."""

_NET = "(?s)^.*?://([^/?#]*)([^?#]*)"

SQL = {
    # A recursion reshares the excess until no source is above its limit.
    "op7_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, source, source_size, weight, 1.5 * sum(source_size) OVER () AS left_over,
         NULL::DOUBLE AS target FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         left_over - sum(CASE WHEN target IS NULL AND share > 2.0 * source_size THEN 2.0 * source_size ELSE 0 END) OVER (),
         CASE WHEN target IS NOT NULL THEN target
              WHEN share > 2.0 * source_size THEN 2.0 * source_size
              WHEN NOT any_full THEN share END
  FROM (SELECT *, max(target IS NULL AND share > 2.0 * source_size) OVER () AS any_full
        FROM (SELECT *, left_over * weight / sum(CASE WHEN target IS NULL THEN weight ELSE 0 END) OVER () AS share
              FROM fill WHERE step < 60)
        WHERE true)
  WHERE EXISTS (SELECT 1 FROM fill f WHERE f.target IS NULL)),
t AS (
  SELECT source, source_size, max(target) AS target FROM fill GROUP BY ALL),
k AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
         md5(concat(coalesce(doc_id::VARCHAR, md5(text), ''), ':7')) AS h,
         coalesce(0.25 + 0.75 * length(translate(text, '0123456789!"#$%&()*+,-./:;<=>?@[]^_`{|}~', ''))
                  / nullif(length(text), 0), 0.25) AS quality
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (
  SELECT *, target - source_size * epochs AS rest,
         -ln((('0x' || h[1:13])::BIGINT + 0.5) / 4503599627370496.0) / quality AS key,
         ('0x' || h[17:30])::BIGINT AS tie
  FROM k),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, tie) AS upto,
         sum(size) OVER (PARTITION BY source, key, tie) AS own
  FROM o)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * least(epochs + CASE WHEN rest > 0 AND upto - own / 2 <= rest THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM c
""",
    "op9_url_filter": f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'),
                               lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')),
                   lambda t: regexp_extract(t, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'),
                               lambda t: regexp_matches(t, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
                   lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))) AS target
  FROM pages WHERE contains(url, '://')),
e AS (
  SELECT DISTINCT url AS src,
    CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
         WHEN target LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
         WHEN target LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
         ELSE regexp_replace(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/*$', '/') || target END AS dst
  FROM tags WHERE target <> ''),
u AS (
  SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT src FROM e UNION SELECT dst FROM e),
p AS (
  SELECT url, regexp_replace(url, '(?s)#.*$', '') AS node,
         translate(regexp_extract(url, '{_NET}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '{_NET}', 2) AS path
  FROM u),
rules(h, p, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT url, arg_max(h || r.p, length(h || r.p)) AS rule, arg_max(action, length(h || r.p)) AS action
  FROM p JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY url),
arcs AS (
  SELECT regexp_replace(src, '(?s)#.*$', '') AS a, regexp_replace(dst, '(?s)#.*$', '') AS b FROM e),
both_ AS (SELECT a, b FROM arcs UNION SELECT b, a FROM arcs UNION SELECT node, node FROM p),
reach AS (
  SELECT a, b FROM both_ UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON r.b = t.a),
spread AS (
  SELECT r.a AS node, min(m.action) AS action
  FROM reach r JOIN p ON p.node = r.b JOIN m ON m.url = p.url GROUP BY r.a)
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, m.rule,
       coalesce(m.action, spread.action, 'allow') AS verdict
FROM pages LEFT JOIN p ON p.url = pages.url LEFT JOIN m ON m.url = pages.url LEFT JOIN spread ON spread.node = p.node
""",
    "op8_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS l
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(l) < 2 THEN l ELSE list_distinct(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) END AS g
  FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
-- A linked pair shares a shingle among the rarest fifth of either set.
f AS (SELECT g, count(*) AS c FROM x GROUP BY g),
o AS (SELECT x.*, row_number() OVER (PARTITION BY doc_id ORDER BY c, x.g) AS r FROM x JOIN f USING (g)),
pre AS (SELECT doc_id, g FROM o WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
i AS (SELECT c.a, c.b, len(list_intersect(sa.g, sb.g)) AS n, len(sa.g) + len(sb.g) AS t
      FROM c JOIN s sa ON sa.doc_id = c.a JOIN s sb ON sb.doc_id = c.b),
e AS (SELECT a, b FROM i WHERE 100 * n >= 80 * (t - n)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, t.b FROM reach r JOIN both_ t ON r.b = t.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
""",
    "op10_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, t, n, hex(t) AS x FROM d),
p AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 100)) AS g FROM h, range(0, greatest(n - 49, 0)) r(i)),
f AS (SELECT g, min(doc_id) AS low FROM p GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM p JOIN f USING (g) WHERE doc_id > low),
gap AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, false)::INT AS new FROM hit),
cut AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gap),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM cut GROUP BY doc_id, k),
kept AS (
  SELECT h.doc_id, h.n, h.x, list(struct_pack(a := a, b := b) ORDER BY a) FILTER (WHERE a IS NOT NULL) AS s FROM h LEFT JOIN span USING (doc_id) GROUP BY ALL),
o AS (SELECT doc_id, n, coalesce(len(s), 0) AS n_spans, coalesce(list_sum(list_transform(s, lambda z: z.b - z.a)), 0)::BIGINT AS n_removed,
  CASE WHEN s IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda i:
    substring(x, (2 * CASE WHEN i = 0 THEN 0 ELSE s[i].b END + 1)::BIGINT, (2 * (CASE WHEN i = len(s) THEN n ELSE s[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE s[i].b END))::BIGINT)), '') END AS left_
  FROM kept)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(left_)) AS kept_sha256 FROM o
""",
}
