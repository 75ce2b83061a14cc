"""SQL with the same rows, for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

#: Whole tokens by a list of matches; the cuts, the form and the output by the digits of the id's hash.
FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS c2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS chance, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS place
  FROM t
), f AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR chance >= 50 THEN 'plain'
              WHEN place < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(tokens[1:least(c1, c2)], ''), '') AS prefix,
         coalesce(array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS middle,
         coalesce(array_to_string(tokens[greatest(c1, c2) + 1:], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM f
"""

#: The list is compared directly: the Bloom filter leaves no trace in the result.
URL_FILTER = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM u
), q AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') AS page,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> ''
           AND lower(split_part(x, '=', 1)) NOT IN ('ref', 'fbclid', 'gclid', 'sessionid') AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_'))), '&') AS kept
  FROM p
), k AS (
  SELECT *, page || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS key FROM q
), listed AS (
  SELECT DISTINCT key FROM k
  WHERE key <> '' AND list_has_any(regexp_split_to_array(host, '[.\-]'), ['spam', 'pills', 'bets', 'casino', 'adult', 'ads'])
), r(text, verdict, rule_host, rule_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), hosts AS (SELECT DISTINCT host, path FROM k
), best AS (
  SELECT host, path, max_by(text, length(text)) AS rule, max_by(verdict, length(text)) AS verdict
  FROM hosts JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, k.host, k.path, rule, coalesce(verdict, CASE WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM k LEFT JOIN best USING (host, path) LEFT JOIN listed ON k.key = listed.key
"""

ORACLE: dict[str, str] = {"op12_fill_in_middle": FILL_IN_MIDDLE, "op13_url_filter": URL_FILTER}
