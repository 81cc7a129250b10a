"""SQL counterparts of the operators that SQL can express."""

PII = r"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
kinds(pos, kind, pat) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'),
  (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b'),
  (6, 'id', '[0-9-]+')),
x AS (
  SELECT rid, t, pos, kind, regexp_extract_all(t, pat) AS f, string_split_regex(t, pat) AS g FROM d, kinds),
y AS (
  SELECT rid, t, pos, kind, f, g, unnest(generate_series(1, len(f))) AS i FROM x WHERE len(f) > 0),
z AS (
  SELECT rid, t, pos, kind, f[i] AS s, regexp_replace(f[i], '[^0-9]', '', 'g') AS n,
         coalesce(list_sum(list_transform(g[1:i], lambda e: length(e))), 0)
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda e: length(e))), 0) AS a
  FROM y),
w AS (
  SELECT *, a + length(s) AS b, replace(s, ' ', '') AS code,
         coalesce(lag(a + length(s)) OVER (PARTITION BY rid, kind ORDER BY a), 0) AS before
  FROM z WHERE kind <> 'id' OR regexp_full_match(s, '[0-9]{3}-[0-9]{2}-[0-9]{4}')),
v AS (
  SELECT *, substr(t, CAST(greatest(before, a - 40) + 1 AS BIGINT), CAST(a - greatest(before, a - 40) AS BIGINT)) AS near,
         CASE kind
           WHEN 'ip' THEN list_bool_and(list_transform(string_split(s, '.'),
             lambda e: coalesce(TRY_CAST(ltrim(e, '0') || '' AS HUGEINT), CASE WHEN ltrim(e, '0') = '' THEN 0 ELSE 999 END) <= 255))
           WHEN 'card' THEN length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(
             generate_series(1, length(n)), lambda k: CASE WHEN (length(n) - k) % 2 = 0 THEN CAST(n[k] AS INT)
               WHEN CAST(n[k] AS INT) > 4 THEN 2 * CAST(n[k] AS INT) - 9 ELSE 2 * CAST(n[k] AS INT) END)) % 10 = 0
           WHEN 'phone' THEN length(n) BETWEEN 9 AND 15
           WHEN 'iban' THEN length(code) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
             string_split(code[5:] || code[1:4], ''), lambda c: CASE WHEN c <= '9' THEN CAST(ascii(c) - 48 AS INT)
               ELSE CAST(ascii(c) - 55 AS INT) END)), lambda p, q: (p * CASE WHEN q < 10 THEN 10 ELSE 100 END + q) % 97) = 1
           ELSE true END AS good
  FROM w),
u AS (
  SELECT * FROM v WHERE good AND (pos <= 4 OR
    CASE kind WHEN 'iban' THEN 0.9 ELSE 0.4 END
    + CASE WHEN regexp_matches(near, '(?i)\b(?:iban|bank|account|konto|cuenta|compte|ssn|social|security|insurance|tax|passport|identity)\b') THEN 0.3 ELSE 0 END
    - CASE WHEN regexp_matches(near, '(?i)\b(?:example|sample|test|dummy|invoice|order|version)\b') THEN 0.3 ELSE 0 END >= 0.6)),
s AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
         count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY pos, a) FILTER (WHERE pos <= 4) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY pos, a) AS spans
  FROM u GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.rid = s.rid"""

# Links of the method: redirects by refresh and canonical links to http urls; relative ones resolve
# against the page's host or folder.
URLS = r"""WITH RECURSIVE rules(rh, rp, rv) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS rid, page_id, url, html FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(
           regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g'), '(?is)<(?:link|meta)\s[^>]*>')) AS tag
  FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv') AND contains(url, '://')),
attrs AS (
  SELECT url,
    trim(concat(regexp_extract(tag, '(?is)\srel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
      regexp_extract(tag, '(?is)\srel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
      regexp_extract(tag, '(?is)\srel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3))) AS rel,
    replace(trim(concat(regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
      regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
      regexp_extract(tag, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3))), '&amp;', '&') AS href,
    trim(concat(regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
      regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
      regexp_extract(tag, '(?is)\shttp-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3))) AS equiv,
    replace(trim(concat(regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1),
      regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2),
      regexp_extract(tag, '(?is)\scontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3))), '&amp;', '&') AS content
  FROM tags),
named AS (
  SELECT url, CASE WHEN list_contains(string_split_regex(lower(rel), '\s+'), 'canonical') THEN href
    WHEN lower(equiv) = 'refresh' THEN trim(regexp_extract(content, '(?i)url\s*=\s*[''"]?([^''"]*)', 1)) END AS link,
    regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
    translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^(.*/)?', 0) AS folder
  FROM attrs),
links AS (
  SELECT url, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN link
    WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN scheme || '://' || host || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS target
  FROM named WHERE link <> ''),
urls AS (SELECT url AS u FROM p UNION SELECT target FROM links),
places AS (
  SELECT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM urls),
ruled AS (
  SELECT u, any_value(host) AS host, any_value(path) AS path, any_value(host || path || query) AS node,
         arg_max(rh || rp, (length(rh || rp), rv = 'allow', rh || rp)) AS rule,
         arg_max(rv, (length(rh || rp), rv = 'allow', rh || rp)) AS rv
  FROM places LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) AND host <> ''
  GROUP BY u),
edges AS (
  SELECT DISTINCT a.node AS x, b.node AS y FROM links JOIN ruled a ON links.url = a.u JOIN ruled b ON links.target = b.u
  WHERE a.node <> b.node),
reach(x, y) AS (
  SELECT x, x FROM edges UNION SELECT y, y FROM edges
  UNION SELECT r.x, CASE WHEN e.x = r.y THEN e.y ELSE e.x END FROM reach r JOIN edges e ON r.y IN (e.x, e.y)),
shared AS (
  SELECT reach.x AS node, min(rv) AS verdict FROM reach JOIN ruled ON ruled.node = reach.y WHERE rv IS NOT NULL GROUP BY 1),
named_parts AS (SELECT x AS node, min(y) AS alias FROM reach GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, verdict, 'allow') AS verdict, alias
FROM p LEFT JOIN ruled ON p.url = ruled.u LEFT JOIN shared ON shared.node = ruled.node
LEFT JOIN named_parts ON named_parts.node = ruled.node"""


# Turns in order; a text's control strings get one more backslash.
CHAT = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

SEARCH = r"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
totals AS (
  SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS nn, CAST(sum(len(terms)) AS BIGINT) AS ll FROM d),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY 1, 2),
p AS (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, totals),
s AS (
  SELECT item_id, rid, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN qt USING (term), totals GROUP BY 1, 2, 3)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
