"""DuckDB SQL for the queries of this subpackage that SQL can express."""

URL_FILTER = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
names AS (
  SELECT host, labels, len(labels) AS k FROM (SELECT DISTINCT host, string_split(host, '.') AS labels FROM parts)),
hosts AS (
  SELECT host,
         CASE WHEN k <= 1 THEN host
              WHEN k >= 3 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') AND length(labels[-1]) = 2 THEN array_to_string(labels[-3:], '.')
              ELSE array_to_string(labels[-2:], '.') END AS domain
  FROM names),
known AS (SELECT host, domain, regexp_extract(domain, '[^.]*$') AS suffix FROM hosts),
by_host AS (
  SELECT p.host, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k
  FROM parts p JOIN labels l ON l.doc_id = p.page_id WHERE quality IS NOT NULL GROUP BY p.host),
h AS (SELECT b.*, domain, suffix FROM by_host b JOIN known USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
overall AS (SELECT least(greatest(coalesce(sum(k) / sum(n), 0.5), 0.01), 0.99)::DOUBLE AS rate FROM s),
spread AS (
  SELECT 'h' AS level, sum(n * pow(k / n - rate, 2)) AS s, count(*) AS g, sum(n - 1) AS more, any_value(rate) AS rate FROM h, overall
  UNION ALL SELECT 'd', sum(n * pow(k / n - rate, 2)), count(*), sum(n - 1), any_value(rate) FROM d, overall
  UNION ALL SELECT 's', sum(n * pow(k / n - rate, 2)), count(*), sum(n - 1), any_value(rate) FROM s, overall),
rho AS (
  SELECT level, least(greatest(CASE WHEN coalesce(more, 0) = 0 THEN 0.5 ELSE (s / (rate * (1 - rate)) - g) / more END, 0.001), 0.5)::DOUBLE AS r FROM spread),
weight AS (SELECT max(CASE WHEN level = 'h' THEN (1 - r) / r END) AS wh, max(CASE WHEN level = 'd' THEN (1 - r) / r END) AS wd, max(CASE WHEN level = 's' THEN (1 - r) / r END) AS ws FROM rho),
scored AS (
  SELECT known.host, coalesce(h.n, 0) AS n, wh,
         (coalesce(h.k, 0) + wh * ((coalesce(d.k, 0) + wd * ((coalesce(s.k, 0) + ws * rate) / (coalesce(s.n, 0) + ws))) / (coalesce(d.n, 0) + wd))) / (coalesce(h.n, 0) + wh) AS rate
  FROM known LEFT JOIN s ON s.suffix = known.suffix LEFT JOIN d ON d.domain = known.domain LEFT JOIN h ON h.host = known.host, overall, weight),
bounds AS (SELECT host, rate - 1.64 * sqrt(rate * (1 - rate) / (n + wh + 1)) AS bound FROM scored),
rules AS (SELECT * FROM (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                               ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')) t(rule, rule_host, rule_path, verdict)),
found AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(found.verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN found USING (page_id) LEFT JOIN bounds USING (host)
"""

WARC_REVISITS = r"""
WITH cut AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS rest FROM pages),
split AS (
  SELECT page_id, digest, size,
         regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM cut),
captures AS (SELECT page_id, digest, size, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM split),
asked AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, page_id + 1000 AS ts, page_id % 100 AS age,
         CASE WHEN page_id % 5 = 0 THEN md5('old' || page_id) ELSE digest END AS etag FROM captures),
found AS (SELECT a.*, c.page_id, c.digest, c.size FROM asked a ASOF LEFT JOIN captures c ON a.url_key = c.url_key AND a.ts > c.page_id)
SELECT record_id, url_key, page_id * 2 AS target_id,
       CASE WHEN page_id IS NULL THEN 'missing' WHEN etag = digest THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN etag = digest THEN 'age=' || age || ';content-length=' || size || ';content-type=text/html;etag=' || etag END AS headers
FROM found
"""
