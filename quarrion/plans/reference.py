"""Queries of the inventory's operators over whole tables, each with its SQL where SQL can say it. Keys begin with the survey's handle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrion.functions import normalize as N
from quarrion.functions.geo import miles_sql
from quarrion.functions.similarity import ratio_of, ratio_sql, sorted_sql, token_set_of, token_set_sql, token_sort_of
from quarrion.functions.urls import BODIES, TWO_WORDS, slug_parts
from quarrion.operators import geojoin, kpi, linkage, search, upsert
from quarrion.operators.graph import components
from quarrion.session import table as t
from quarrion.sources import captured, pages
from quarrion.streaming.inventory import event_windows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# scans, filters, search

@query("s1_active_scan", "SELECT id, url, price FROM listings WHERE is_active = 1")
def _(s, d):
    return t(s, d, "listings").where("is_active = 1").select("id", "url", "price")


FILTERS = {"make": "norvane", "model": "er", "year_min": 2010, "price_max": 60000, "mileage_max": 150000, "hide_duplicates": False}


@query("e1_search", """
WITH a AS (SELECT * FROM listings WHERE is_active = 1), g AS (SELECT duplicate_group_id, count(*) AS n FROM a WHERE duplicate_group_id IS NOT NULL GROUP BY 1)
SELECT a.id, a.make, a.model, a.year, a.price, a.mileage, d.name AS dealer_name, d.website AS dealer_website, coalesce(g.n, 1) AS duplicate_count
FROM a LEFT JOIN g USING (duplicate_group_id) LEFT JOIN dealerships d ON d.id = a.dealership_id
WHERE lower(make) = 'norvane' AND lower(model) LIKE '%er%' AND year >= 2010 AND price <= 60000 AND mileage <= 150000""")
def _(s, d):
    return search.search(t(s, d, "listings"), t(s, d, "dealerships"), FILTERS).select("id", "make", "model", "year", "price", "mileage", "dealer_name", "dealer_website", "duplicate_count")


@query("e2_group_members", "SELECT l.duplicate_group_id, l.url, l.price, l.mileage, l.source, l.is_duplicate, d.name AS dealer_name, d.website AS dealer_website FROM listings l LEFT JOIN dealerships d ON d.id = l.dealership_id WHERE l.duplicate_group_id IS NOT NULL AND l.is_active = 1")
def _(s, d):
    rows = t(s, d, "listings").where("duplicate_group_id is not null and is_active = 1")
    return search.with_dealer(rows, t(s, d, "dealerships")).orderBy("duplicate_group_id", F.asc_nulls_last("price")).select("duplicate_group_id", "url", "price", "mileage", "source", "is_duplicate", "dealer_name", "dealer_website")


@query("e3_stats", """
SELECT (SELECT count(*) FROM listings WHERE is_active = 1) AS total, (SELECT count(*) FROM listings WHERE is_active = 1 AND is_duplicate = 1) AS duplicates, (SELECT count(*) FROM dealerships) AS dealers,
(SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM listings WHERE is_active = 1 GROUP BY source)) AS by_source, coalesce((SELECT max(epoch_us(last_seen)) FROM listings)::VARCHAR, 'Never') AS last_scrape""")
def _(s, d):
    rows = t(s, d, "listings")
    n = rows.groupBy("source").agg(F.count_if(F.col("is_active") == 1).alias("n"), F.count_if((F.col("is_active") == 1) & (F.col("is_duplicate") == 1)).alias("dup"), F.max(F.unix_micros("last_seen")).alias("seen"))
    each = F.sort_array(F.collect_list(F.when((F.col("n") > 0) & F.col("source").isNotNull(), F.concat("source", F.lit("="), F.col("n").cast("string")))))
    whole = n.agg(F.sum("n").alias("total"), F.sum("dup").alias("duplicates"), F.array_join(each, ",").alias("by_source"), F.coalesce(F.max("seen").cast("string"), F.lit("Never")).alias("last_scrape"))
    return whole.crossJoin(t(s, d, "dealerships").agg(F.count(F.lit(1)).alias("dealers")))  # one row by one row


@query("a2_by_source", "SELECT source, count(*) AS n FROM listings WHERE is_active = 1 GROUP BY source")
def _(s, d):
    return t(s, d, "listings").where("is_active = 1").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("e4_dealer_counts", "SELECT d.id, d.name, (SELECT count(*) FROM listings l WHERE l.dealership_id = d.id AND l.is_active = 1) AS active_listings FROM dealerships d")
def _(s, d):
    return search.dealer_counts(t(s, d, "dealerships"), t(s, d, "listings")).select("id", "name", "active_listings")


_SITE = "count(*) FILTER (WHERE coalesce(website, '') <> '')"


@query("e5_directory_stats", f"""
SELECT * FROM (SELECT count(*) AS total, {_SITE} AS with_site, count(*) - {_SITE} AS no_website, count(DISTINCT city) AS cities FROM tx_directory),
(SELECT count(*) AS dealers, {_SITE} AS dealers_with_site, count(*) FILTER (WHERE scrape_status = 'ok') AS dealers_ok, count(*) FILTER (WHERE lat IS NOT NULL AND lng IS NOT NULL) AS dealers_located FROM dealerships)""")
def _(s, d):
    site = F.coalesce(F.col("website"), F.lit("")) != ""
    a = t(s, d, "tx_directory").agg(F.count(F.lit(1)).alias("total"), F.count_if(site).alias("with_site"), F.count_if(~site).alias("no_website"), F.countDistinct("city").alias("cities"))
    b = t(s, d, "dealerships").agg(F.count(F.lit(1)).alias("dealers"), F.count_if(site).alias("dealers_with_site"), F.count_if(F.col("scrape_status") == "ok").alias("dealers_ok"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("dealers_located"))
    return a.crossJoin(b)  # one row by one row


@query("a4_a7_status_counts", "SELECT coalesce(platform, 'directory') AS platform, scrape_status, count(*) AS n FROM dealerships WHERE scrape_status IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return t(s, d, "dealerships").where("scrape_status is not null").groupBy(F.coalesce("platform", F.lit("directory")).alias("platform"), "scrape_status").agg(F.count(F.lit(1)).alias("n"))


@query("e7_log_tail", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 200")
def _(s, d):
    return t(s, d, "events").orderBy(F.desc("event_id")).limit(200).select("event_id", "event_type", "value")


@query("f20_bounds", "SELECT id, CASE WHEN year BETWEEN 1900 AND 2100 THEN year END AS year, CASE WHEN price BETWEEN 0 AND 10000000 THEN price END AS price, CASE WHEN mileage BETWEEN 0 AND 2000000 THEN mileage END AS mileage FROM listings")
def _(s, d):
    return t(s, d, "listings").select("id", N.bounded(F.col("year"), 1900, 2100).alias("year"), N.bounded(F.col("price"), 0, 10_000_000).alias("price"), N.bounded(F.col("mileage"), 0, 2_000_000).alias("mileage"))


@query("f16_f17_freshness", "SELECT id, last_seen <= TIMESTAMPTZ '2025-04-15 00:00:00+00' - INTERVAL 12 HOURS AS due, coalesce(TIMESTAMPTZ '2025-04-15 00:00:00+00' - last_seen >= INTERVAL 30 DAYS, true) AS again FROM dealerships")
def _(s, d):
    now = F.expr("timestamp'2025-04-15 00:00:00Z'")
    return t(s, d, "dealerships").select("id", (F.col("last_seen") <= now - F.expr("INTERVAL 12 HOURS")).alias("due"), F.coalesce((now - F.col("last_seen")) >= F.expr("INTERVAL 30 DAYS"), F.lit(True)).alias("again"))


# scalars

@query("c1_c2_websites", r"""
WITH h AS (SELECT id, website, regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce(website, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^www\.', '') AS h FROM tx_directory)
SELECT DISTINCT id, CASE WHEN contains(regexp_replace(h, ':\d*$', ''), '.') THEN 'https://' || regexp_replace(h, ':\d*$', '') END AS site, h AS host, regexp_replace(regexp_extract(regexp_replace(lower(website), '^[a-z][a-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1), '/+$', '') AS path FROM h""")
def _(s, d):
    w = F.col("website")
    return t(s, d, "tx_directory").select("id", N.canonical_website(w).alias("site"), N.host(w, keep_port=True).alias("host"), N.url_path_key(w).alias("path")).distinct()


@query("c3_c5_names", r"""
SELECT id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(name), '[^\p{L}\p{N}_\s]+|\s+', ' ', 'g')), '\s+'), lambda w: w NOT IN ('llc', 'inc', 'co', 'lp', 'ltd')), ' ') AS name,
trim(regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]+', ' ', 'g')) AS address, CASE WHEN length(regexp_replace(coalesce(zip, ''), '[^0-9]', '', 'g')) >= 5 THEN left(regexp_replace(zip, '[^0-9]', '', 'g'), 5) ELSE '' END AS zip5 FROM state_registry""")
def _(s, d):
    return t(s, d, "state_registry").select("id", N.normalize_name(F.col("name")).alias("name"), N.norm_address(F.col("address")).alias("address"), N.zip5(F.col("zip")).alias("zip5"))


@query("c6_c11_keys", r"""
WITH m AS (SELECT id, source_id, make, model, vin, trim(regexp_replace(lower(coalesce(make, '')), '[^a-z0-9]+', ' ', 'g')) AS m FROM listings)
SELECT id, left(CASE m WHEN 'chevy' THEN 'chevrolet' WHEN 'vw' THEN 'volkswagen' WHEN 'mercedes' THEN 'mercedes benz' WHEN 'benz' THEN 'mercedes benz' WHEN 'landrover' THEN 'land rover' WHEN 'rollsroyce' THEN 'rolls royce' WHEN 'alfa' THEN 'alfa romeo' ELSE m END, 5) AS make_key,
regexp_replace(regexp_replace(lower(coalesce(model, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(regexp_matches(upper(trim(vin)), '^[A-HJ-NPR-Z0-9]{17}$'), false) AS is_vin, TRY_CAST(regexp_replace(source_id, '[^0-9]', '', 'g') AS BIGINT) AS digits FROM m""")
def _(s, d):
    return t(s, d, "listings").select("id", N.make_key(F.col("make")).alias("make_key"), N.slug(F.col("model")).alias("slug"), N.looks_like_vin(F.col("vin")).alias("is_vin"), N.money_to_int(F.col("source_id")).alias("digits"))


@query("c7_name_score", r"""
WITH h AS (SELECT id, name, regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce(website, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^www\.', ''), '\.[^.]*$', '') AS stem FROM dealerships)
SELECT id, len(list_filter(regexp_extract_all(lower(coalesce(name, '')), '([a-z0-9]+)', 1), lambda w: length(w) > 2 AND contains(stem, w)))
 - CASE WHEN len(list_filter(regexp_extract_all(lower(coalesce(name, '')), '([a-z0-9]+)', 1), lambda w: w IN ('floral', 'flower', 'florist', 'boutique', 'salon', 'bakery', 'realty'))) > 0 THEN 5 ELSE 0 END AS score FROM h""")
def _(s, d):
    return t(s, d, "dealerships").select("id", N.name_domain_score(F.col("name"), N.host(F.col("website"), keep_port=True)).alias("score"))


@query("c24_cache_key", "SELECT id, sha256(url || '?' || 'page=1&size=' || source) AS key FROM listings")
def _(s, d):
    return t(s, d, "listings").select("id", N.cache_key(F.col("url"), F.create_map(F.lit("size"), F.col("source"), F.lit("page"), F.lit("1"))).alias("key"))


@query("c23_titles", r"""
WITH x AS (SELECT id, coalesce(year::VARCHAR, '') || ' ' || coalesce(make, '') || ' ' || coalesce(model, '') || ' $' || coalesce(price::VARCHAR, '') || ' - ' || CASE WHEN id % 2 = 0 THEN coalesce((mileage // 1000)::VARCHAR, 'n/a') || 'k' ELSE coalesce(mileage::VARCHAR, 'n/a') || ' miles' END AS title FROM listings),
m AS (SELECT *, regexp_extract(title, '(?i)([\d,]+)\s*(mi|miles|k)', 1) AS n, lower(regexp_extract(title, '(?i)([\d,]+)\s*(mi|miles|k)', 2)) AS unit FROM x)
SELECT id, TRY_CAST(regexp_extract(title, '\b((?:19|20)\d{2})\b', 1) AS INTEGER) AS year, TRY_CAST(replace(n, ',', '') AS BIGINT) * CASE WHEN unit = 'k' THEN 1000 ELSE 1 END AS miles, TRY_CAST(replace(regexp_extract(title, '\$\s*([\d,]+)', 1), ',', '') AS BIGINT) AS price FROM m""")
def _(s, d):
    say = lambda c, e="": F.coalesce(F.col(c).cast("string"), F.lit(e))
    thousands = F.concat(F.coalesce((F.col("mileage") / 1000).cast("int").cast("string"), F.lit("n/a")), F.lit("k"))
    shown = F.when(F.col("id") % 2 == 0, thousands).otherwise(F.concat(say("mileage", "n/a"), F.lit(" miles")))
    title = F.concat(say("year"), F.lit(" "), say("make"), F.lit(" "), say("model"), F.lit(" $"), say("price"), F.lit(" - "), shown)
    return t(s, d, "listings").select("id", N.title_parts(title).alias("x")).select("id", "x.year", "x.miles", "x.price")


@query("c22_ratios", f"""
WITH v AS (SELECT DISTINCT lower(make) AS a, lower(model) AS b FROM listings WHERE make IS NOT NULL AND model IS NOT NULL), s AS MATERIALIZED (SELECT *, {sorted_sql("a")} AS sa, {sorted_sql("b")} AS sb FROM v)
SELECT a, b, round({ratio_sql("a", "b")}, 4) AS ratio, round({ratio_sql("sa", "sb")}, 4) AS sorted, round({token_set_sql("a", "b")}, 4) AS sets FROM s""")
def _(s, d):
    v = t(s, d, "listings").where("make is not null and model is not null").select(F.lower("make").alias("a"), F.lower("model").alias("b")).distinct()
    return v.select("a", "b", F.round(ratio_of(F.col("a"), F.col("b")), 4).alias("ratio"), F.round(token_sort_of(F.col("a"), F.col("b")), 4).alias("sorted"), F.round(token_set_of(F.col("a"), F.col("b")), 4).alias("sets"))


_BODIES = "|".join(BODIES)
_CASED = "list_transform({}, lambda w: CASE WHEN length(w) <= 3 OR regexp_matches(w, '[0-9]') THEN upper(w) ELSE upper(w[1]) || substr(w, 2) END)".format


@query("c13_slugs", f"""
WITH p AS (SELECT id, list_transform(string_split(split_part(split_part(regexp_replace(lower(url), '^[a-z]+://[^/]*', ''), '?', 1), '#', 1), '/'), lambda g: string_split(replace(g, '_', '-'), '-')) AS segs FROM listings),
y AS (SELECT id, list_filter(segs, lambda g: len(list_filter(g, lambda w: length(w) = 4 AND coalesce(TRY_CAST(w AS INT), 0) BETWEEN 1950 AND 2039)) > 0)[1] AS g FROM p),
a AS (SELECT id, list_filter(g, lambda w: length(w) = 4 AND coalesce(TRY_CAST(w AS INT), 0) BETWEEN 1950 AND 2039)[1] AS year, g FROM y),
w AS (SELECT id, year, string_split(regexp_replace(array_to_string(list_filter(string_split_regex(array_to_string(g[list_position(g, year) + 1:], ' '), '[^a-z0-9]+'), lambda x: x <> ''), ' '), '(?:(?:^| )(?:[0-9]{{5,}}|[a-hj-npr-z0-9]{{17}}))+$', ''), ' ') AS w FROM a),
m AS (SELECT id, year, CASE WHEN array_to_string(w[1:2], ' ') IN ({", ".join(f"'{x}'" for x in TWO_WORDS)}) THEN 2 ELSE 1 END AS n, w FROM w),
r AS (SELECT id, year, w[1:n] AS make, string_split(trim(regexp_replace(array_to_string(list_filter(w[n + 1:], lambda x: x NOT IN ('awd', 'fwd', 'rwd', '4wd', '2wd', '4x4', '4x2')), ' '), '(?:^| )(?:{_BODIES})$', '')), ' ') AS rest FROM m)
SELECT id, TRY_CAST(year AS INTEGER) AS year, nullif(array_to_string({_CASED("make")}, ' '), '') AS make,
nullif(array_to_string({_CASED("rest[1:1]")}, '') || array_to_string(list_transform(rest[2:], lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') OR length(w) <= 2 THEN '-' ELSE ' ' END || CASE WHEN length(w) <= 3 OR regexp_matches(w, '[0-9]') THEN upper(w) ELSE upper(w[1]) || substr(w, 2) END), ''), '') AS model FROM r""")
def _(s, d):
    return t(s, d, "listings").select("id", slug_parts(F.col("url")).alias("x")).select("id", "x.year", "x.make", "x.model")


@query("k8_log", "SELECT event_id, left(props, 400) AS detail FROM events")
def _(s, d):
    return t(s, d, "events").select("event_id", F.substring("props", 1, 400).alias("detail"))


# aggregation, ranking

COMPLETE = ["vin", "year", "make", "model", "trim", "exterior_color", "mileage", "price", "msrp", "image_url"]


def _filled_sql(c):
    return f"({c} IS NOT NULL AND {c} <> {'0' if c in ('year', 'mileage', 'price', 'msrp') else chr(39) * 2})"


@query("a8_completeness", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT source, count(*) AS n, '{c}' AS field, round_even(100.0 * count(*) FILTER (WHERE {_filled_sql(c)}) / count(*), 1) AS pct FROM listings WHERE is_active = 1 GROUP BY source" for c in COMPLETE) + ")")
def _(s, d):
    return kpi.completeness(t(s, d, "listings").where("is_active = 1"), "source", COMPLETE)


@query("a5_a13_groups", "SELECT duplicate_group_id, count(*) AS n, max(nullif(price, 0)) AS top_price, list_sort(list(DISTINCT source)) AS sources FROM listings WHERE duplicate_group_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return t(s, d, "listings").where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("nullif(price, 0)")).alias("top_price"), F.array_sort(F.collect_set("source")).alias("sources")).where("n > 1")


@query("w5_latest_reading", "SELECT url, epoch_us(last_seen) AS seen, load_no, price FROM listing_snapshots WHERE url IS NOT NULL AND last_seen IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY last_seen DESC, load_no DESC, price DESC NULLS LAST) = 1")
def _(s, d):
    return search.latest(t(s, d, "listing_snapshots").where("url is not null"), ["url"], "last_seen", ["load_no", "price"]).select("url", F.unix_micros("last_seen").alias("seen"), "load_no", "price")


@query("o6_ordered_distinct", "SELECT url, epoch_us(min(last_seen)) AS seen FROM listing_snapshots GROUP BY url")
def _(s, d):
    return search.ordered_distinct(t(s, d, "listing_snapshots"), ["url"], "last_seen").select("url", F.unix_micros("last_seen").alias("seen"))


@query("o4_cheapest_per_source", "SELECT source, id, price FROM listings WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY price, id) <= 10")
def _(s, d):
    return search.top_of(t(s, d, "listings").where("price is not null"), ["source"], [F.col("price").asc(), F.col("id").asc()], 10).select("source", "id", "price")


@query("a15_a16_preferred", "SELECT vin, arg_max(source, (price, id)) AS source FROM listings WHERE vin IS NOT NULL AND price IS NOT NULL GROUP BY vin")
def _(s, d):
    return kpi.argmax(t(s, d, "listings").where("vin is not null and price is not null"), ["vin"], "source", [F.col("price"), F.col("id")])


# geography

@query("s2_zip_lookup", "SELECT d.id, z.lat AS zip_lat, z.lng AS zip_lng FROM dealerships d LEFT JOIN zip_coords z ON z.zip = left(trim(d.zip), 5)")
def _(s, d):
    return geojoin.zip_lookup(t(s, d, "dealerships"), t(s, d, "zip_coords")).select("id", "zip_lat", "zip_lng")


_C20 = miles_sql("SELECT d.id, d.lat, d.lng, z.lat AS zlat, z.lng AS zlng FROM dealerships d JOIN zip_coords z ON z.zip = left(trim(d.zip), 5) WHERE d.lat IS NOT NULL AND d.lng IS NOT NULL", "lat", "lng", "zlat", "zlng")


@query("c20_geodesic", f"SELECT id, round(miles, 3) AS miles FROM ({_C20})")
def _(s, d):
    rows = geojoin.zip_lookup(t(s, d, "dealerships").where("lat is not null and lng is not null"), t(s, d, "zip_coords")).where("zip_lat is not null")
    return geojoin.with_miles(rows, "lat", "lng", "zip_lat", "zip_lng").select("id", F.round("miles", 3).alias("miles"))


ORIGIN = (30.5, -97.5)
_J7 = miles_sql(f"SELECT id, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM dealerships WHERE lat IS NOT NULL AND lng IS NOT NULL", "lat", "lng", "a", "b")


@query("j7_in_radius", f"SELECT id, round(miles, 1) AS distance_mi FROM ({_J7}) WHERE miles <= 120")
def _(s, d):
    return geojoin.in_radius(t(s, d, "dealerships"), *ORIGIN, 120).select("id", "distance_mi")


@query("g10_reorigin", f"SELECT d.id, round(m.miles, 1) AS distance_mi, CASE WHEN m.miles IS NOT NULL THEN 'here' END AS location_tag FROM dealerships d LEFT JOIN ({_J7}) m USING (id)")
def _(s, d):
    return geojoin.reorigin(t(s, d, "dealerships"), *ORIGIN, "here").select("id", "distance_mi", "location_tag")


_J6 = miles_sql("SELECT o.id, o.lat, o.lng, z.zip, z.lat AS zlat, z.lng AS zlng FROM (SELECT id, coalesce(lat, center.lat) AS lat, coalesce(lon, center.lon) AS lng FROM osm_sample) o JOIN zip_coords z ON abs(o.lat - z.lat) <= 0.5 AND abs(o.lng - z.lng) <= 0.5", "lat", "lng", "zlat", "zlng")


@query("j6_nearest_zip", f"SELECT o.id, b.zip AS nearest_zip, b.miles FROM osm_sample o LEFT JOIN (SELECT id, zip, round(miles, 3) AS miles FROM ({_J6}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY miles, zip) = 1) b USING (id)")
def _(s, d):
    points = t(s, d, "osm_sample").select("id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"))
    return geojoin.nearest(points, "id", t(s, d, "zip_coords"), "zip").select("id", "nearest_zip", "miles")


# linkage

@query("g1_vin_groups", "SELECT vin, min(id) AS group_id, count(*) AS n FROM listings WHERE is_active = 1 AND vin IS NOT NULL AND vin <> '' GROUP BY vin HAVING count(*) > 1")
def _(s, d):
    return linkage.key_groups(t(s, d, "listings").where("is_active = 1"), "vin")


@query("j11_jaccard", """
WITH m AS (SELECT DISTINCT source || ':' || dealership_id AS o, vin AS i FROM listings WHERE dealership_id IS NOT NULL AND length(vin) = 17), n AS (SELECT o, count(*) AS n FROM m GROUP BY o),
c AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM m x JOIN m y ON x.i = y.i AND x.o < y.o GROUP BY 1, 2)
SELECT a, b, round(c::DOUBLE / (na.n + nb.n - c), 6) AS jaccard FROM c JOIN n na ON na.o = a JOIN n nb ON nb.o = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.1""")
def _(s, d):
    rows = t(s, d, "listings").where("length(vin) = 17").select(F.concat("source", F.lit(":"), F.col("dealership_id").cast("string")).alias("owner"), "vin")
    return linkage.set_jaccard(rows, "owner", "vin", 0.1)


@query("g5_site_components", r"""
WITH r AS (SELECT 'tx:' || id AS k, website FROM tx_directory UNION SELECT 'de:' || id, website FROM dealerships),
h AS (SELECT k, regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce(website, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^www\.', '') AS h FROM r)
SELECT DISTINCT k AS id, min(k) OVER (PARTITION BY h) AS root FROM h WHERE h <> '' QUALIFY min(k) OVER (PARTITION BY h) <> max(k) OVER (PARTITION BY h)""")
def _(s, d):
    site = lambda n, p: t(s, d, n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("k"), N.host(F.col("website"), keep_port=True).alias("h"))
    rows = site("tx_directory", "tx:").unionByName(site("dealerships", "de:")).where("h <> ''").distinct()
    low = rows.groupBy("h").agg(F.min("k").alias("b"))
    return components(rows.join(low, "h").select(F.col("k").alias("a"), "b"))


@query("g5_preferred_fields", "SELECT city, arg_min(phone, (id, phone)) FILTER (WHERE coalesce(phone, '') <> '') AS phone, arg_min(website, (id, website)) FILTER (WHERE coalesce(website, '') <> '') AS website FROM dealerships GROUP BY city")
def _(s, d):
    return linkage.preferred(t(s, d, "dealerships"), ["city"], ["phone", "website"], F.col("id"))


# changes of tables

_BATCH = """(SELECT url, arg_max(price, (last_seen, load_no, coalesce(price, -1), coalesce(mileage, -1))) FILTER (WHERE price IS NOT NULL) AS price, arg_max(mileage, (last_seen, load_no, coalesce(price, -1), coalesce(mileage, -1))) FILTER (WHERE mileage IS NOT NULL) AS mileage FROM listing_snapshots WHERE url IS NOT NULL AND last_seen IS NOT NULL GROUP BY url)"""


def _batch(s, d):
    """All deliveries as one batch of rows in order of their reading; equal readings in order of their numbers."""
    rows = t(s, d, "listing_snapshots").where("last_seen is not null").withColumns({"p": F.coalesce("price", F.lit(-1)), "m": F.coalesce("mileage", F.lit(-1))})
    return upsert.collapsed(rows, "url", ["last_seen", "load_no", "p", "m"], ["price", "mileage"])


@query("k1_upsert", f"SELECT coalesce(l.url, b.url) AS url, coalesce(b.price, l.price) AS price, coalesce(b.mileage, l.mileage) AS mileage, l.make, l.url IS NULL AS is_new FROM listings l FULL JOIN {_BATCH} b ON l.url = b.url")
def _(s, d):
    return upsert.upsert(t(s, d, "listings").select("url", "price", "mileage", "make"), _batch(s, d), "url", ["price", "mileage"])


@query("k4_insert_or_ignore", f"SELECT url, price FROM listings UNION ALL SELECT b.url, b.price FROM {_BATCH} b WHERE b.url NOT IN (SELECT url FROM listings)")
def _(s, d):
    return upsert.insert_or_ignore(t(s, d, "listings").select("url", "price"), _batch(s, d).select("url", "price"), "url")


@query("k5_insert_or_replace", f"SELECT url, price FROM listings WHERE url NOT IN (SELECT url FROM {_BATCH}) UNION ALL SELECT url, price FROM {_BATCH}")
def _(s, d):
    return upsert.insert_or_replace(t(s, d, "listings").select("url", "price"), _batch(s, d).select("url", "price"), "url")


@query("k11_delete", f"SELECT id, url FROM listings WHERE url NOT IN (SELECT url FROM {_BATCH})")
def _(s, d):
    return upsert.delete_keys(t(s, d, "listings").select("id", "url"), _batch(s, d), "url")


@query("k7_fill_coords", "SELECT t.id, CASE WHEN coalesce(t.zip, '') <> '' THEN z.lat ELSE t.lat END AS lat, CASE WHEN coalesce(t.zip, '') <> '' THEN z.lng ELSE t.lng END AS lng FROM tx_directory t LEFT JOIN zip_coords z ON z.zip = left(trim(t.zip), 5)")
def _(s, d):
    given = F.coalesce("zip", F.lit("")) != ""
    rows = geojoin.zip_lookup(t(s, d, "tx_directory"), t(s, d, "zip_coords"))
    return rows.select("id", F.when(given, F.col("zip_lat")).otherwise(F.col("lat")).alias("lat"), F.when(given, F.col("zip_lng")).otherwise(F.col("lng")).alias("lng"))


@query("k3_priority_match", r"""
WITH r AS (SELECT DISTINCT id, name, website, zip FROM tx_directory),
x AS (SELECT id, (SELECT min(d.id) FROM dealerships d WHERE d.website = r.website AND r.website <> '') AS k0, (SELECT min(d.id) FROM dealerships d WHERE d.name = r.name AND d.zip = r.zip AND r.name <> '' AND r.zip <> '') AS k1 FROM r)
SELECT id, coalesce(k0, k1) AS matched, CASE WHEN k0 IS NOT NULL THEN 1 WHEN k1 IS NOT NULL THEN 2 END AS match_rule, CASE WHEN k0 IS NOT NULL AND k1 <> k0 THEN k1 END AS also FROM x""")
def _(s, d):
    rows = t(s, d, "tx_directory").select(F.col("id"), "name", "website", "zip").distinct()
    known = t(s, d, "dealerships").select(F.col("id").alias("dealer"), "name", "website", "zip")
    return upsert.matched_by_priority(rows, known, [["website"], ["name", "zip"]], "dealer", "id").select("id", "matched", "match_rule", "also")


# set operations

@query("set_operations", """
SELECT state, 'both' AS kind FROM (SELECT state FROM dealerships INTERSECT SELECT state FROM state_registry)
UNION ALL SELECT city, 'directory only' FROM (SELECT city FROM tx_directory EXCEPT SELECT city FROM dealerships)""")
def _(s, d):
    both = t(s, d, "dealerships").select("state").intersect(t(s, d, "state_registry").select("state")).withColumn("kind", F.lit("both"))
    only = t(s, d, "tx_directory").select(F.col("city").alias("state")).distinct().subtract(t(s, d, "dealerships").select("city"))
    return both.unionByName(only.withColumn("kind", F.lit("directory only")))


# captured payloads

@query("s9_map_candidates", """
WITH x AS (SELECT id, coalesce(lat, center.lat) AS lat, coalesce(lon, center.lon) AS lng, tags FROM osm_sample)
SELECT id::VARCHAR AS source_id, coalesce(nullif(trim(tags['name']), ''), nullif(trim(tags['operator']), ''), nullif(trim(tags['brand']), '')) AS name, nullif(trim(concat_ws(' ', nullif(trim(tags['addr:housenumber']), ''), nullif(trim(tags['addr:street']), ''))), '') AS address,
coalesce(nullif(trim(tags['phone']), ''), nullif(trim(tags['contact:phone']), '')) AS phone, coalesce(nullif(trim(tags['website']), ''), nullif(trim(tags['contact:website']), ''), nullif(trim(tags['url']), '')) AS website, lat, lng
FROM x WHERE lat IS NOT NULL AND lng IS NOT NULL""")
def _(s, d):
    e = t(s, d, "osm_sample")
    payloads = e.select(F.to_json(F.struct(F.array(F.struct("type", "id", "lat", "lon", "center", "tags")).alias("elements"))).alias("body"))
    return captured.map_candidates(captured.payload_elements(payloads)).select("source_id", "name", "address", "phone", "website", "lat", "lng")


@query("s12_registry", "SELECT license_no AS source_id, coalesce(nullif(trim(dba), ''), name) AS name, zip FROM state_registry")
def _(s, d):
    return captured.registry_candidates(t(s, d, "state_registry")).select("source_id", "name", "zip")


def _pages(s, d):
    """A page of structured data for every listing."""
    node = F.to_json(F.struct(F.lit("Vehicle").alias("@type"), F.col("vin").alias("vehicleIdentificationNumber"), F.col("year").alias("modelDate"), F.struct(F.col("make").alias("name")).alias("brand"), "model", F.struct(F.col("price")).alias("offers"), "url"))
    return t(s, d, "listings").where("vin rlike '^[A-HJ-NPR-Z0-9]{17}$'").select("id", F.concat(F.lit("<html><script type='application/ld+json'>"), node, F.lit("</script><a href='/x?a=1&amp;b=2'>x</a></html>")).alias("page"))


@query("x6_page_listings", "SELECT id, 'json_ld' AS extractor, vin, year::VARCHAR AS year, nullif(make, '') AS make, nullif(model, '') AS model, price::VARCHAR AS price, url FROM listings WHERE regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{17}$')")
def _(s, d):
    return pages.page_listings(_pages(s, d), "id", "page").select("id", "extractor", "vin", "year", "make", "model", "price", "url")


@query("s14_links", "SELECT id, '/x?a=1&b=2' AS link FROM listings WHERE regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{17}$')")
def _(s, d):
    return _pages(s, d).select("id", F.explode(captured.links(F.col("page"))).alias("link"))


@query("x10_segments", "SELECT id, vin, mileage, price FROM listings WHERE regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{17}$') AND mileage BETWEEN 100 AND 999999 AND price BETWEEN 1000 AND 999999")
def _(s, d):
    rows = t(s, d, "listings").where("vin rlike '^[A-HJ-NPR-Z0-9]{17}$' and mileage between 100 and 999999 and price between 1000 and 999999")
    text = F.concat(F.lit("VIN "), "vin", F.lit(" with "), F.format_number("mileage", 0), F.lit(" miles from $299/mo or $"), F.format_number("price", 0))
    return rows.select("id", pages.segment_fields(text).alias("x")).select("id", "x.vin", "x.mileage", "x.price")


@query("stream_event_windows", "SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return event_windows(t(s, d, "events")).select(F.to_date("start").cast("string").alias("day"), "event_type", "n", "total")
