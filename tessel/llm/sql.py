"""DuckDB SQL of the queries that SQL can express."""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, pos, line, {ASCII_LOWER.format(f"trim(line, {SPACE})")} AS k
  FROM (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs)),
repeated AS (
  SELECT k, max(doc_id) AS owner FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.owner AS lost FROM lines l LEFT JOIN repeated r ON l.k = r.k),
islands AS (SELECT rid, lost, pos, pos - row_number() OVER (PARTITION BY rid, lost ORDER BY pos) AS island FROM marked),
runs AS (SELECT rid, lost, min(pos) AS p, count(*) AS c FROM islands GROUP BY rid, lost, island),
bitmaps AS (SELECT rid, CASE WHEN arg_min(lost, p) THEN '0 ' ELSE '' END || string_agg(c, ' ' ORDER BY p) AS keep_bitmap FROM runs GROUP BY rid),
kept AS (
  SELECT rid, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
  FROM marked GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap FROM kept JOIN bitmaps USING (rid)
"""

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')"
OP7 = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {ASCII_LOWER.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest),
ruled AS (SELECT *, CASE WHEN {_FITS.format("example.org", "es/")} THEN 'example.org/es/' WHEN {_FITS.format("example.org", "en/1")} THEN 'example.org/en/1' WHEN {_FITS.format("org", "")} THEN 'org/'
  WHEN {_FITS.format("com", "fr/")} THEN 'com/fr/' WHEN {_FITS.format("com", "de/")} THEN 'com/de/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

ORACLE: dict[str, str] = {"op2_line_dedup": OP2, "op7_url_filter": OP7}
