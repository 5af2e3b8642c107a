"""Queries of the general training-data operators; their SQL where DuckDB can say the same over whole tables."""

from __future__ import annotations

from quarrion.operators.history import price_history
from quarrion.operators.profile import altered_loads, profile
from quarrion.operators.snapdiff import snapshot_changes
from quarrion.session import table

QUERIES = {
    "p2_found": lambda s, d: price_history(table(s, d, "listing_snapshots"), table(s, d, "load_calendar"), table(s, d, "listings")),
    "p4_found": lambda s, d: snapshot_changes(table(s, d, "listing_snapshots"), table(s, d, "load_calendar"), table(s, d, "listings")),
    "p6_found": lambda s, d: altered_loads(table(s, d, "listing_snapshots"), ["source"], "load_no", ["mileage", "vin", "image_url", "price"]).where("altered").select("source", "load_no", "column_name"),
    "p6_profile": lambda s, d: profile(table(s, d, "listing_snapshots"), ["source"], "load_no", [c for c in table(s, d, "listing_snapshots").columns if c not in ("source", "load_no")], table(s, d, "load_calendar")),
}

#: The page's key and the readings, as DuckDB says them.
_READINGS = r"""
WITH raw AS (
  SELECT source, price, load_no, last_seen,
         regexp_replace(split_part(trim(url), '#', 1), '^\s*(https?:)?//(www\.)?', '', 'i') AS bare
  FROM listing_snapshots WHERE url IS NOT NULL AND source IS NOT NULL),
keyed AS (
  SELECT *, lower(split_part(split_part(bare, '?', 1), '/', 1)) AS host, split_part(bare, '?', 1) AS path,
         list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, length(split_part(bare, '?', 1)) + 2) ELSE '' END, '&'),
                     lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|src|gclid|fbclid)(=.*)?$')) AS q FROM raw),
paged AS (
  SELECT source, price, load_no, last_seen, host || regexp_replace(substr(path, length(host) + 1), '/+$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS page FROM keyed),
dated AS (SELECT p.*, c.load_no AS k FROM paged p JOIN load_calendar c ON p.last_seen >= c.week_start AND p.last_seen < c.week_end WHERE page <> ''),
best AS (
  SELECT source, page, k, price FROM dated
  QUALIFY row_number() OVER (PARTITION BY source, page, k ORDER BY last_seen DESC, load_no DESC, price DESC NULLS LAST) = 1),
ords AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS ord, count(*) OVER (PARTITION BY source) - 1 AS last_ord
         FROM (SELECT DISTINCT source, k FROM dated)),
r AS (SELECT b.*, o.ord, o.last_ord FROM best b JOIN ords o USING (source, k)),
clean AS (
  SELECT url, host || regexp_replace(substr(path, length(host) + 1), '/+$', '') || CASE WHEN contains(bare, '?') THEN substr(bare, length(path) + 1) ELSE '' END AS page
  FROM (SELECT url, bare, split_part(bare, '?', 1) AS path, lower(split_part(bare, '/', 1)) AS host
        FROM (SELECT url, regexp_replace(url, '^https?://(www\.)?', '') AS bare FROM listings)))
"""

SQL = {
    "p2_found": _READINGS
    + """,
filled AS (SELECT *, ord - row_number() OVER (PARTITION BY source, page ORDER BY ord) AS stretch FROM r),
stated AS (SELECT *, count(price) OVER (PARTITION BY source, page, stretch ORDER BY ord) AS nth FROM filled),
runs AS (SELECT *, max(price) OVER (PARTITION BY source, page, stretch, nth) AS p FROM stated WHERE nth > 0),
starts AS (SELECT *, CASE WHEN lag(p) OVER (PARTITION BY source, page, stretch ORDER BY ord) IS DISTINCT FROM p THEN 1 ELSE 0 END AS s FROM runs),
versions AS (SELECT *, sum(s) OVER (PARTITION BY source, page, stretch ORDER BY ord) AS v FROM starts)
SELECT url, CAST(p AS INTEGER) AS price, CAST(min(k) AS INTEGER) AS from_snapshot, CAST(max(k) AS INTEGER) AS to_snapshot
FROM versions JOIN clean USING (page) GROUP BY source, page, stretch, v, url, p
""",
    "p4_found": _READINGS
    + """,
old AS (SELECT r.source, r.page, r.price, o.k AS later FROM r JOIN ords o ON o.source = r.source AND o.ord = r.ord + 1),
new AS (SELECT source, page, price, k AS later FROM r WHERE ord > 0)
SELECT CAST(later AS INTEGER) AS snapshot_no, url,
       CASE WHEN old.p2 IS NULL THEN 'added' WHEN new.p2 IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT source, page, later, price, page AS p2 FROM old) old
FULL JOIN (SELECT source, page, later, price, page AS p2 FROM new) new USING (source, page, later)
JOIN clean USING (page)
WHERE old.p2 IS NULL OR new.p2 IS NULL OR old.price IS DISTINCT FROM new.price
""",
}
