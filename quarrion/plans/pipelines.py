"""Queries of composed operators: dealers' quality, clusters and merges, deduplication, inventory scans, logs and lookups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from quarrion.functions import normalize as N
from quarrion.functions.geo import miles_sql
from quarrion.functions.similarity import ratio_sql, sorted_sql, token_set_sql
from quarrion.operators import dealers, dedup, discovery, geojoin, inventory, kpi, linkage, search, status, upsert
from quarrion.plans.reference import ORIGIN
from quarrion.session import table as t
from quarrion.sources import pages

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: The host of a website and the make's key, as DuckDB says them.
HOST = r"regexp_replace(regexp_extract(regexp_replace(lower(trim(coalesce({}, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^www\.', '')"
_MAKE = r"trim(regexp_replace(lower(coalesce(make, '')), '[^a-z0-9]+', ' ', 'g'))"
MAKE_KEY = f"left(CASE {_MAKE} WHEN 'chevy' THEN 'chevrolet' WHEN 'vw' THEN 'volkswagen' WHEN 'mercedes' THEN 'mercedes benz' WHEN 'benz' THEN 'mercedes benz' WHEN 'landrover' THEN 'land rover' WHEN 'rollsroyce' THEN 'rolls royce' WHEN 'alfa' THEN 'alfa romeo' ELSE {_MAKE} END, 5)"


# quality of dealers

_QUALITY = """
r AS (SELECT dealership_id, count(*) AS n, round(avg(CASE WHEN coalesce(url, '') = '' OR contains(url, '#') THEN 1.0 ELSE 0.0 END), 6) AS synthetic_urls, round(avg(CASE WHEN coalesce(vin, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS missing_vin,
 round(avg(CASE WHEN coalesce(price, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing_price, round(avg(CASE WHEN coalesce(mileage, 0) = 0 THEN 1.0 ELSE 0.0 END), 6) AS missing_mileage, round(avg(CASE WHEN coalesce(image_url, '') = '' THEN 1.0 ELSE 0.0 END), 6) AS missing_image
 FROM listings WHERE is_active = 1 AND dealership_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
f AS (SELECT r.*, array_to_string(list_filter([CASE WHEN synthetic_urls > 0.05 THEN 'synthetic_urls' END, CASE WHEN missing_vin > 0.1 THEN 'missing_vin' END, CASE WHEN missing_price > 0.2 THEN 'missing_price' END, CASE WHEN missing_mileage > 0.5 AND d.platform IN ('generic', 'sitemap') THEN 'missing_mileage' END, CASE WHEN missing_image > 0.5 THEN 'missing_image' END], lambda x: x IS NOT NULL), ',') AS flags
 FROM r LEFT JOIN dealerships d ON d.id = r.dealership_id),
q AS (SELECT *, greatest(0, CAST(round_even(100.0::DOUBLE - CASE WHEN contains(flags, 'synthetic_urls') THEN 40 * synthetic_urls ELSE 0 END - CASE WHEN contains(flags, 'missing_vin') THEN 25 * missing_vin ELSE 0 END - CASE WHEN contains(flags, 'missing_price') THEN 20 * missing_price ELSE 0 END
 - CASE WHEN contains(flags, 'missing_mileage') THEN 15 * missing_mileage ELSE 0 END - CASE WHEN contains(flags, 'missing_image') THEN 10 * missing_image ELSE 0 END, 0) AS INTEGER)) AS score FROM f),
s AS (SELECT *, score < 80 OR contains(flags, 'synthetic_urls') OR contains(flags, 'missing_vin') AS flagged FROM q)"""


def _quality(s, d):
    return dealers.quality(t(s, d, "listings"), t(s, d, "dealerships"))


@query("a9_a10_quality", f"WITH {_QUALITY} SELECT dealership_id, n, synthetic_urls, missing_vin, missing_price, missing_mileage, missing_image, flags, score, flagged FROM s")
def _(s, d):
    return _quality(s, d)


@query("a11_mean_score", f"WITH {_QUALITY} SELECT count(*) AS dealers, count(*) FILTER (WHERE flagged) AS flagged, round(avg(score), 4) AS mean_score FROM s")
def _(s, d):
    return _quality(s, d).agg(F.count(F.lit(1)).alias("dealers"), F.count_if("flagged").alias("flagged"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("g11_quality_log", f"WITH {_QUALITY} SELECT 'quality' AS run_type, 'quality_flag' AS action, dealership_id AS dealer, left('score ' || score || ': ' || flags, 400) AS detail FROM s WHERE flagged")
def _(s, d):
    return dealers.quality_log(_quality(s, d))


@query("e14_worst_dealers", f"WITH {_QUALITY} SELECT s.dealership_id, d.name, s.score, s.flags FROM s LEFT JOIN dealerships d ON d.id = s.dealership_id WHERE s.score < 90 OR s.flags <> '' ORDER BY s.score, s.n DESC, s.dealership_id LIMIT 10")
def _(s, d):
    bad = _quality(s, d).where("score < 90 or flags <> ''").orderBy("score", F.desc("n"), "dealership_id").limit(10)
    return bad.join(t(s, d, "dealerships").select(F.col("id").alias("dealership_id"), "name"), "dealership_id", "left").select("dealership_id", "name", "score", "flags")


@query("a6_unique_vins", "WITH v AS (SELECT dealership_id, vin, sum(CASE WHEN is_active = 1 THEN 1 ELSE 0 END) AS active FROM listings WHERE dealership_id IS NOT NULL AND coalesce(vin, '') <> '' GROUP BY 1, 2) SELECT dealership_id, count(*) AS vins, CAST(sum(active) AS BIGINT) AS active, count(*) FILTER (WHERE active > 1) AS repeated FROM v GROUP BY 1")
def _(s, d):
    v = t(s, d, "listings").where("dealership_id is not null and coalesce(vin, '') <> ''").groupBy("dealership_id", "vin").agg(F.sum(F.when(F.col("is_active") == 1, 1).otherwise(0)).alias("active"))
    return v.groupBy("dealership_id").agg(F.count(F.lit(1)).alias("vins"), F.sum("active").alias("active"), F.count_if(F.col("active") > 1).alias("repeated"))


_KEYS = ["vin", "year", "make", "model", "price", "mileage", "image_url", "url"]


@query("a14_filled_fields", "SELECT source, CAST(sum(" + " + ".join(f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1 ELSE 0 END" for c in _KEYS) + ") AS BIGINT) AS filled, count(*) AS n FROM listings GROUP BY source")
def _(s, d):
    full = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in _KEYS), F.lit(0))
    return t(s, d, "listings").groupBy("source").agg(F.sum(full).alias("filled"), F.count(F.lit(1)).alias("n"))


# deduplication

_PLACED = miles_sql(f"SELECT l.id, z.lat, z.lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM listings l JOIN zip_coords z ON z.zip = left(trim(l.zip), 5)", "lat", "lng", "a", "b")


def _located(s, d):
    """Active listings with their distance from ORIGIN, to one place, by their postcode."""
    rows = geojoin.zip_lookup(t(s, d, "listings"), t(s, d, "zip_coords")).withColumns({"_a": F.lit(ORIGIN[0]), "_b": F.lit(ORIGIN[1])})
    return geojoin.with_miles(rows, "zip_lat", "zip_lng", "_a", "_b").withColumn("distance_mi", F.round("miles", 1)).where("is_active = 1").drop("_a", "_b", "miles", "zip_lat", "zip_lng").withColumn("make_key", N.make_key(F.col("make")))


@query("w1_canonical_rows", f"""
WITH m AS (SELECT id, round(miles, 1) AS distance_mi FROM ({_PLACED})), g AS (SELECT l.id, l.duplicate_group_id, l.price, m.distance_mi, max(nullif(l.price, 0)) OVER (PARTITION BY l.duplicate_group_id) AS top FROM listings l LEFT JOIN m USING (id) WHERE l.is_active = 1 AND l.duplicate_group_id IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY duplicate_group_id ORDER BY coalesce(price < 1000 OR price < 0.4 * top, true), price NULLS LAST, distance_mi NULLS LAST, id) AS rank FROM g)
SELECT id, duplicate_group_id, distance_mi, rank, CAST(rank > 1 AS INTEGER) AS is_duplicate FROM k""")
def _(s, d):
    return dedup.canonical_rows(_located(s, d).drop("is_duplicate"), "duplicate_group_id").select("id", "duplicate_group_id", "distance_mi", "rank", "is_duplicate")


_LOW = "lower(coalesce({}, ''))".format
FUZZY = f"""
b AS (SELECT id, year, {MAKE_KEY} AS mk, upper(trim(coalesce(vin, ''))) AS vin, {_LOW("make")} AS make, {_LOW("model")} AS model, {_LOW("trim")} AS tr, nullif(mileage, 0) AS mi, nullif(price, 0) AS pr FROM rows_ WHERE year IS NOT NULL),
c AS MATERIALIZED (SELECT x.id AS id_a, y.id AS id_b, x.make AS ma, y.make AS mb, x.model AS oa, y.model AS ob, x.tr AS ta, y.tr AS tb FROM b x JOIN b y ON x.year = y.year AND x.mk = y.mk AND x.id < y.id
 WHERE (x.vin = y.vin OR x.vin = '' OR y.vin = '') AND (x.mi + y.mi IS NOT NULL OR x.pr + y.pr IS NOT NULL) AND coalesce(abs(x.mi::BIGINT - y.mi) <= 500, true) AND coalesce(abs(x.pr::BIGINT - y.pr) <= 500, true)),
o AS MATERIALIZED (SELECT *, {sorted_sql("ma")} AS ms, {sorted_sql("mb")} AS mt, {sorted_sql("oa")} AS os, {sorted_sql("ob")} AS ot FROM c),
p AS MATERIALIZED (SELECT * FROM o WHERE {ratio_sql("ms", "mt")} >= 85 AND {ratio_sql("os", "ot")} >= 85),
fuzzy AS MATERIALIZED (SELECT id_a, id_b FROM p WHERE ta = '' OR tb = '' OR {token_set_sql("ta", "tb")} >= 60)"""


@query("g2_fuzzy_pairs", f"WITH rows_ AS (SELECT * FROM listings WHERE is_active = 1), {FUZZY} SELECT id_a, id_b FROM fuzzy")
def _(s, d):
    rows = t(s, d, "listings").where("is_active = 1 and year is not null").withColumn("make_key", N.make_key(F.col("make")))
    return linkage.fuzzy_pairs(rows, ["year", "make_key"])


@query("g3_guarded_groups")
def _(s, d):
    rows = t(s, d, "listings").where("is_active = 1 and year is not null").withColumn("make_key", N.make_key(F.col("make")))
    return dedup.grouped(rows, ["year", "make_key"]).where("match_method = 'fuzzy'").select("id", "group_id")


@query("g4_dedup")
def _(s, d):
    return dedup.deduplicated(_located(s, d).where("year is not null"), ["year", "make_key"])


@query("g4_group_sizes", f"""
WITH RECURSIVE rows0 AS (SELECT * FROM listings WHERE is_active = 1 AND year IS NOT NULL),
v AS (SELECT vin FROM rows0 WHERE coalesce(vin, '') <> '' GROUP BY vin HAVING count(*) > 1), rows_ AS (SELECT * FROM rows0 WHERE vin IS NULL OR vin NOT IN (SELECT vin FROM v)), {FUZZY},
e AS (SELECT id_a AS a, id_b AS b FROM fuzzy UNION SELECT id_b, id_a FROM fuzzy), reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b),
part AS (SELECT id, min(r) AS root FROM reach GROUP BY id), pv AS (SELECT root, count(DISTINCT nullif(upper(trim(vin)), '')) AS vins FROM part JOIN rows_ USING (id) GROUP BY root)
SELECT 'vin' AS match_method, min(id) AS group_id, count(*) AS n FROM rows0 WHERE vin IN (SELECT vin FROM v) GROUP BY vin
UNION ALL SELECT 'fuzzy', root, count(*) FROM part JOIN pv USING (root) WHERE vins < 2 GROUP BY root""")
def _(s, d):
    """The groups that do not depend on the order in which pairs are joined: of equal vins, and of one vin at most."""
    rows = _located(s, d).where("year is not null")
    groups = dedup.grouped(rows, ["year", "make_key"])
    left = rows.join(groups.where("match_method = 'vin'").select("id"), "id", "left_anti")
    parts = linkage.components(linkage.fuzzy_pairs(left, ["year", "make_key"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    vins = parts.join(left.select("id", F.nullif(F.upper(F.trim("vin")), F.lit("")).alias("v")), "id").groupBy("root").agg(F.countDistinct("v").alias("vins")).where("vins < 2").select(F.col("root").alias("group_id"))
    sizes = groups.groupBy("match_method", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.where("match_method = 'vin'").unionByName(sizes.where("match_method = 'fuzzy'").join(vins, "group_id", "left_semi"))


# dealers: clusters, canonical ones, merges

_OWNED = "SELECT DISTINCT source || ':' || dealership_id AS o, vin AS i FROM listings WHERE dealership_id IS NOT NULL AND length(vin) = 17"


def _owned(s, d):
    return t(s, d, "listings").where("dealership_id is not null and length(vin) = 17").select(F.concat("source", F.lit(":"), F.col("dealership_id").cast("string")).alias("owner"), "vin")


@query("g6_inventory_clusters", f"""
WITH RECURSIVE m AS ({_OWNED}), n AS (SELECT o, count(*) AS n FROM m GROUP BY o), c AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM m x JOIN m y ON x.i = y.i AND x.o <> y.o GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.o = a JOIN n nb ON nb.o = b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.5),
reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b), part AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
SELECT id AS owner, first_value(id) OVER (PARTITION BY root ORDER BY n DESC, id) AS canonical FROM part JOIN n ON n.o = id""")
def _(s, d):
    return dealers.inventory_clusters(_owned(s, d), "owner", "vin", 0.5)


_NEAR = miles_sql(f"SELECT id, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM dealerships WHERE lat IS NOT NULL AND lng IS NOT NULL", "lat", "lng", "a", "b")


def _dealers_near(s, d):
    return geojoin.with_miles(t(s, d, "dealerships").withColumns({"_a": F.lit(ORIGIN[0]), "_b": F.lit(ORIGIN[1])}), "lat", "lng", "_a", "_b").withColumn("distance_mi", F.round("miles", 1)).withColumn("host", N.host(F.col("website"), keep_port=True))


@query("w4_canonical_dealers", f"""
WITH u AS (SELECT dealership_id AS id, count(DISTINCT vin) AS u FROM listings WHERE is_active = 1 AND length(vin) = 17 GROUP BY 1), h AS (SELECT d.id, {HOST.format("website")} AS host, coalesce(u, 0) AS u, round(miles, 1) AS mi FROM dealerships d LEFT JOIN u USING (id) LEFT JOIN ({_NEAR}) m USING (id))
SELECT id, first_value(id) OVER (PARTITION BY host ORDER BY u DESC, mi NULLS LAST, id) AS canonical FROM h WHERE host <> ''""")
def _(s, d):
    u = t(s, d, "listings").where("is_active = 1 and length(vin) = 17").groupBy(F.col("dealership_id").alias("id")).agg(F.countDistinct("vin").alias("u"))
    rows = _dealers_near(s, d).join(u, "id", "left").fillna({"u": 0}).where("host <> ''")
    return dealers.canonical(rows, "host", [F.col("u").desc(), F.asc_nulls_last("distance_mi")], "id")


_SCORED = f"""
h AS (SELECT id, name, address, {HOST.format("website")} AS host FROM dealerships WHERE website IS NOT NULL),
k AS (SELECT *, len(list_filter(regexp_extract_all(lower(coalesce(name, '')), '([a-z0-9]+)', 1), lambda w: length(w) > 2 AND contains(regexp_replace(host, '\\.[^.]*$', ''), w)))
 - CASE WHEN len(list_filter(regexp_extract_all(lower(coalesce(name, '')), '([a-z0-9]+)', 1), lambda w: w IN ('floral', 'flower', 'florist', 'boutique', 'salon', 'bakery', 'realty'))) > 0 THEN 5 ELSE 0 END AS score,
 trim(regexp_replace(lower(coalesce(address, '')), '[^a-z0-9]+', ' ', 'g')) AS street FROM h)"""


@query("w2_g7_best_name", f"WITH {_SCORED} SELECT id, host, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, id) AS rank FROM k")
def _(s, d):
    rows = t(s, d, "dealerships").where("website is not null").withColumn("host", N.host(F.col("website"), keep_port=True))
    return dealers.best_named(rows, ["host"], "host").select("id", "host", "score", "rank")


@query("w3_g7_garbage", f"WITH {_SCORED} SELECT id, host, street FROM k QUALIFY row_number() OVER (PARTITION BY host, street ORDER BY score DESC, id) > 1")
def _(s, d):
    rows = t(s, d, "dealerships").where("website is not null").withColumn("host", N.host(F.col("website"), keep_port=True)).withColumn("street", N.norm_address(F.col("address")))
    return dealers.best_named(rows, ["host", "street"], "host").where("rank > 1").select("id", "host", "street")


_NAME = r"array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}_\s]+|\s+', ' ', 'g')), '\s+'), lambda w: w NOT IN ('llc', 'inc', 'co', 'lp', 'ltd')), ' ')"
_ZIP5 = "CASE WHEN length(regexp_replace(coalesce(zip, ''), '[^0-9]', '', 'g')) >= 5 THEN left(regexp_replace(zip, '[^0-9]', '', 'g'), 5) ELSE '' END"
_CANDIDATES = f"""
raw AS (SELECT DISTINCT 'directory:' || id AS key, 'directory' AS source, name, address, city, state, zip, phone, website FROM tx_directory
 UNION ALL SELECT 'registry:' || id, 'registry', coalesce(nullif(trim(dba), ''), name), address, city, state, zip, phone, NULL FROM state_registry
 UNION ALL SELECT 'osm:' || id, 'osm', nullif(trim(coalesce(tags['name'], '')), ''), NULL, nullif(trim(coalesce(tags['addr:city'], '')), ''), NULL, nullif(trim(coalesce(tags['addr:postcode'], '')), ''), nullif(trim(coalesce(tags['phone'], '')), ''), nullif(trim(coalesce(tags['website'], '')), '') FROM osm_sample),
cand AS (SELECT *, {HOST.format("website")} AS host, {_NAME} AS norm, {_ZIP5} AS zip5 FROM raw),
stars AS (SELECT zip5, norm, min(key) AS low FROM cand WHERE zip5 <> '' AND norm <> '' GROUP BY 1, 2),
met AS MATERIALIZED (SELECT x.norm AS n1, y.norm AS n2, x.low AS k1, y.low AS k2 FROM stars x JOIN stars y ON x.zip5 = y.zip5 AND x.norm < y.norm),
pairs AS MATERIALIZED (SELECT s.low AS a, c.key AS b FROM cand c JOIN stars s USING (zip5, norm) WHERE c.key <> s.low UNION SELECT least(k1, k2), greatest(k1, k2) FROM met WHERE {token_set_sql("n1", "n2")} >= 90)"""


def _candidates(s, d):
    """Candidates of three sources under one schema."""
    own = ["name", "address", "city", "state", "zip", "phone", "website"]
    put = lambda df, n, **c: df.select(F.concat(F.lit(f"{n}:"), F.col("id").cast("string")).alias("key"), F.lit(n).alias("source"), *[c.get(x, F.col(x) if x in df.columns else F.lit(None)).cast("string").alias(x) for x in own])
    tag = lambda x: F.nullif(F.trim(F.coalesce(F.try_element_at("tags", F.lit(x)), F.lit(""))), F.lit(""))
    rows = put(t(s, d, "tx_directory").select("id", *own).distinct(), "directory").unionByName(put(t(s, d, "state_registry"), "registry", name=F.coalesce(F.nullif(F.trim("dba"), F.lit("")), F.col("name"))))
    return rows.unionByName(put(t(s, d, "osm_sample"), "osm", name=tag("name"), city=tag("addr:city"), zip=tag("addr:postcode"), phone=tag("phone"), website=tag("website"))).withColumn("host", N.host(F.col("website"), keep_port=True))


@query("j10_name_pairs", f"WITH {_CANDIDATES} SELECT a, b FROM pairs")
def _(s, d):
    return dealers.name_pairs(_candidates(s, d))


_MERGED = _CANDIDATES.lstrip() + """,
e0 AS (SELECT a, b FROM pairs UNION SELECT min(key) OVER (PARTITION BY host), key FROM cand WHERE host <> ''), e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach AS (SELECT a AS id, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id WHERE reach.r < e.b), part AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
w AS (SELECT coalesce(root, key) AS root, cand.*, CASE source WHEN 'registry' THEN 0 ELSE 1 END AS official, CASE source WHEN 'osm' THEN 0 WHEN 'directory' THEN 1 ELSE 2 END AS pos FROM cand LEFT JOIN part ON id = key),
mg AS MATERIALIZED (SELECT root, count(*) AS n, """ + ", ".join(f"(list({c} ORDER BY official, pos, key) FILTER (WHERE trim(coalesce({c}, '')) <> ''))[1] AS {c}" for c in ("name", "address", "city", "state", "zip", "phone")) + ", (list(website ORDER BY 1 - official, pos, key) FILTER (WHERE trim(coalesce(website, '')) <> ''))[1] AS website FROM w GROUP BY root)"


@query("g5_merged", f"WITH RECURSIVE {_MERGED} SELECT * FROM mg")
def _(s, d):
    return dealers.merged(_candidates(s, d), {"osm": 0, "directory": 1}, "registry")


_MGNEAR = miles_sql(f"SELECT mg.*, z.lat, z.lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM mg JOIN zip_coords z ON z.zip = left(trim(mg.zip), 5)", "lat", "lng", "a", "b")


@query("g9_discovered", f"""WITH RECURSIVE {_MERGED},
nr AS (SELECT *, {HOST.format("website")} AS host, {_NAME} AS norm, {_ZIP5} AS zip5 FROM ({_MGNEAR}) WHERE miles <= 120), dl AS (SELECT id, {HOST.format("website")} AS host, {_NAME} AS norm, {_ZIP5} AS zip5 FROM dealerships),
da AS (SELECT host, min(id) AS k FROM dl WHERE host <> '' GROUP BY 1), dn AS (SELECT norm, zip5, min(id) AS k FROM dl WHERE norm <> '' AND zip5 <> '' GROUP BY 1, 2)
SELECT root, coalesce(nullif(trim(name), ''), 'Unnamed dealer (candidate:' || root || ')') AS name, round(miles, 1) AS distance_mi, coalesce(da.k, dn.k) AS dealer, coalesce(da.k, dn.k) IS NULL AS is_new FROM nr LEFT JOIN da USING (host) LEFT JOIN dn ON dn.norm = nr.norm AND dn.zip5 = nr.zip5""")
def _(s, d):
    every = _candidates(s, d)
    return discovery.discovered({"all": every}, t(s, d, "dealerships"), t(s, d, "zip_coords"), {"osm": 0, "directory": 1}, "registry", *ORIGIN, 120).select("root", "name", "distance_mi", "dealer", "is_new")


# inventory over all deliveries

_ALL = "l AS (SELECT load_no, dealership_id, vin, url FROM listing_snapshots WHERE dealership_id IS NOT NULL), old AS (SELECT load_no + 1 AS load_no, dealership_id, vin, url FROM l), new AS (SELECT * FROM l WHERE load_no > (SELECT min(load_no) FROM l)), rd AS (SELECT DISTINCT load_no, dealership_id FROM new), od AS (SELECT DISTINCT load_no, dealership_id, vin FROM old WHERE coalesce(vin, '') <> ''), nd AS (SELECT DISTINCT load_no, dealership_id, vin FROM new WHERE coalesce(vin, '') <> '')"
_BY = ["load_no", "dealership_id"]


def _loads(s, d):
    return inventory.consecutive(t(s, d, "listing_snapshots").where("dealership_id is not null").select("load_no", "dealership_id", "vin", "url"), "load_no")


_DIFF = f"WITH {_ALL}, st AS (SELECT load_no, dealership_id, vin, CASE WHEN od.vin IS NULL THEN 'new' WHEN nd.vin IS NULL THEN 'sold' ELSE 'kept' END AS status FROM od FULL JOIN nd USING (load_no, dealership_id, vin) JOIN rd USING (load_no, dealership_id)), mv AS (SELECT o.* FROM old o SEMI JOIN nd USING (load_no, dealership_id, vin) ANTI JOIN (SELECT * FROM new WHERE vin IS NOT NULL) n USING (load_no, dealership_id, vin, url) WHERE coalesce(o.vin, '') <> '')"


@query("j12_all_loads", f"{_DIFF} SELECT load_no, dealership_id, vin, status FROM st")
def _(s, d):
    return inventory.inventory_diff(*_loads(s, d), _BY)


@query("j13_all_loads", f"{_DIFF} SELECT load_no, dealership_id, vin, url FROM mv")
def _(s, d):
    return inventory.moved(*_loads(s, d), _BY).select("load_no", "dealership_id", "vin", "url")


@query("g8_a17_scan_counters", f"{_DIFF} SELECT load_no, dealership_id, count(*) AS found, any_value(coalesce(c.new_, 0)) AS new, any_value(coalesce(c.kept, 0)) AS kept, any_value(coalesce(c.sold, 0)) AS sold, any_value(coalesce(m.moved, 0)) AS moved FROM new LEFT JOIN (SELECT load_no, dealership_id, count(*) FILTER (WHERE status = 'new') AS new_, count(*) FILTER (WHERE status = 'kept') AS kept, count(*) FILTER (WHERE status = 'sold') AS sold FROM st GROUP BY 1, 2) c USING (load_no, dealership_id) LEFT JOIN (SELECT load_no, dealership_id, count(*) AS moved FROM mv GROUP BY 1, 2) m USING (load_no, dealership_id) GROUP BY 1, 2")
def _(s, d):
    return inventory.scan_counters(*_loads(s, d), _BY)


@query("k13_run_audit", "WITH f AS (SELECT url, min(load_no) AS first FROM listing_snapshots WHERE url IS NOT NULL GROUP BY url) SELECT source, load_no, count(*) AS found, count(DISTINCT s.url) FILTER (WHERE s.load_no = f.first) AS inserted, CASE WHEN count(*) FILTER (WHERE s.url IS NOT NULL) > 0 THEN 'ok' ELSE 'empty' END AS status FROM listing_snapshots s LEFT JOIN f USING (url) GROUP BY 1, 2")
def _(s, d):
    return status.run_audit(t(s, d, "listing_snapshots"), "source", "load_no", "url")


# joins and lookups

@query("j2_canonical_only", f"WITH c AS (SELECT id, min(id) OVER (PARTITION BY {HOST.format('website')}) AS canonical FROM dealerships WHERE website IS NOT NULL) SELECT l.id, d.name AS dealer_name FROM listings l JOIN dealerships d ON d.id = l.dealership_id LEFT JOIN c ON c.id = d.id WHERE l.is_active = 1 AND coalesce(c.canonical, d.id) = d.id")
def _(s, d):
    rows = t(s, d, "dealerships").withColumn("host", N.host(F.col("website"), keep_port=True))
    known = rows.where("website is not null").groupBy("host").agg(F.min("id").alias("canonical"))
    kept = rows.join(known, (rows["host"] == known["host"]) & rows["website"].isNotNull(), "left").where(F.coalesce("canonical", "id") == F.col("id")).select(F.col("id").alias("dealership_id"), F.col("name").alias("dealer_name"))
    return t(s, d, "listings").where("is_active = 1").join(kept, "dealership_id").select("id", "dealer_name")


_TXNEAR = miles_sql(f"SELECT DISTINCT id, website, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM tx_directory WHERE lat IS NOT NULL AND lng IS NOT NULL", "lat", "lng", "a", "b")


@query("j14_working_set", f"SELECT id, name FROM dealerships WHERE {HOST.format('website')} <> '' AND {HOST.format('website')} IN (SELECT {HOST.format('website')} FROM ({_TXNEAR}) WHERE miles <= 120)")
def _(s, d):
    sites = geojoin.in_radius(t(s, d, "tx_directory"), *ORIGIN, 120).select(N.host(F.col("website"), keep_port=True).alias("host")).where("host <> ''")
    return t(s, d, "dealerships").withColumn("host", N.host(F.col("website"), keep_port=True)).join(sites, "host", "left_semi").select("id", "name")


@query("j5_states_in_radius", f"SELECT DISTINCT state FROM (SELECT z.state, m.miles FROM ({miles_sql(f'SELECT zip AS id, state, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM zip_coords', 'lat', 'lng', 'a', 'b')}) m JOIN zip_coords z ON z.zip = m.id) WHERE miles <= 400")
def _(s, d):
    return geojoin.in_radius(t(s, d, "zip_coords"), *ORIGIN, 400).select("state").distinct()


@query("s12_registry_in_radius", f"SELECT id, source_id, name, round(miles, 1) AS distance_mi FROM ({miles_sql(f'SELECT r.id, r.license_no AS source_id, coalesce(nullif(trim(r.dba), {chr(39) * 2}), r.name) AS name, z.lat, z.lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM state_registry r JOIN zip_coords z ON z.zip = left(trim(r.zip), 5)', 'lat', 'lng', 'a', 'b')}) WHERE miles <= 120")
def _(s, d):
    return geojoin.registry_in_radius(t(s, d, "state_registry"), t(s, d, "zip_coords"), *ORIGIN, 120).select("id", "source_id", "name", "distance_mi")


@query("j17_matched_links", r"""
WITH x AS (SELECT id, url, vin, regexp_replace(regexp_replace(lower(coalesce(year::VARCHAR, '') || ' ' || coalesce(make, '') || ' ' || coalesce(model, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, list_filter([image_url, url], lambda u: u IS NOT NULL) AS links FROM listings)
SELECT id, coalesce(list_filter(links, lambda u: length(vin) >= 6 AND contains(lower(u), lower(vin)))[1], list_filter(links, lambda u: length(slug) >= 6 AND contains(lower(u), slug))[1], '#' || coalesce(vin, slug)) AS link FROM x""")
def _(s, d):
    rows = t(s, d, "listings").withColumn("slug", N.slug(F.concat_ws(" ", F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce("make", F.lit("")), F.coalesce("model", F.lit("")))))
    return rows.select("id", status.matched_link(F.array_compact(F.array("image_url", "url")), F.col("vin"), F.col("slug")).alias("link"))


@query("j18_vin_images", "WITH i AS (SELECT vin, arg_min(image_url, (id, image_url)) AS image FROM listings WHERE length(vin) = 17 AND coalesce(image_url, '') <> '' GROUP BY vin) SELECT l.id, coalesce(nullif(l.image_url, ''), i.image) AS image_url FROM listings l LEFT JOIN i USING (vin)")
def _(s, d):
    rows = t(s, d, "listings").select("id", "vin", "image_url")
    image = linkage.preferred(rows.where("length(vin) = 17"), ["vin"], ["image_url"], F.col("id")).withColumnRenamed("image_url", "image")
    return rows.join(image, "vin", "left").select("id", F.coalesce(F.nullif("image_url", F.lit("")), "image").alias("image_url"))


@query("e15_gate", f"""
WITH r AS (SELECT DISTINCT id, cardealerdb_id, name, zip FROM tx_directory), d AS (SELECT id, {_NAME} AS norm, {_ZIP5} AS zip5, epoch_us(last_seen) AS seen FROM dealerships), n AS (SELECT norm, zip5, max(seen) AS seen FROM d WHERE norm <> '' AND zip5 <> '' GROUP BY 1, 2), i AS (SELECT id, seen FROM d)
SELECT q.id, coalesce(i.seen, n.seen) AS checked_at FROM (SELECT *, {_NAME} AS norm, {_ZIP5} AS zip5 FROM r) q LEFT JOIN i ON i.id::VARCHAR = q.cardealerdb_id LEFT JOIN n USING (norm, zip5)""")
def _(s, d):
    keyed = lambda df: df.withColumns({"norm": N.normalize_name(F.col("name")), "zip5": N.zip5(F.col("zip"))})
    rows = keyed(t(s, d, "tx_directory").select("id", "cardealerdb_id", "name", "zip").distinct())
    known = keyed(t(s, d, "dealerships")).withColumn("at", F.unix_micros("last_seen"))
    return status.gate(rows, known.withColumn("cardealerdb_id", F.col("id").cast("string")), ["cardealerdb_id"], ["norm", "zip5"], "at").select("id", F.col("at").alias("checked_at"))


# lists, pages, defaults

@query("f14_o2_platforms", "SELECT d.id, d.name, d.platform, round(miles, 1) AS distance_mi FROM dealerships d LEFT JOIN (" + _NEAR + ") m USING (id) WHERE d.platform IN ('generic', 'sitemap') ORDER BY miles NULLS LAST, d.name, d.id")
def _(s, d):
    return _dealers_near(s, d).where(F.col("platform").isin("generic", "sitemap")).orderBy(F.asc_nulls_last("miles"), "name", "id").select("id", "name", "platform", "distance_mi")


@query("o5_third_page", "SELECT id, price FROM listings WHERE is_active = 1 ORDER BY price NULLS LAST, id LIMIT 50 OFFSET 100")
def _(s, d):
    return t(s, d, "listings").where("is_active = 1").orderBy(F.asc_nulls_last("price"), "id").offset(100).limit(50).select("id", "price")


@query("f18_thin_rows", "SELECT id, url FROM listings WHERE url IS NOT NULL AND NOT contains(url, '#') AND (mileage IS NULL OR mileage = 0)")
def _(s, d):
    return t(s, d, "listings").where(search.thin("mileage")).select("id", "url")


@query("f5_f9_filters", "SELECT id FROM listings WHERE is_active = 1 AND source = 'dealer' AND is_duplicate = 0 AND year BETWEEN 2012 AND 2022 AND price >= 5000")
def _(s, d):
    return search.search(t(s, d, "listings"), t(s, d, "dealerships"), {"source": "dealer", "hide_duplicates": True, "year_min": 2012, "year_max": 2022, "price_min": 5000}).select("id")


@query("f6_f7_transmission", "SELECT id, lower(trim) LIKE '%auto%' AND NOT (lower(trim) LIKE '%manual%' AND lower(trim) NOT LIKE '%automat%') AS automatic, coalesce(lower(trim) LIKE '%manual%' AND lower(trim) NOT LIKE '%automat%', false) AS manual FROM listings WHERE trim IS NOT NULL")
def _(s, d):
    rows = t(s, d, "listings").where("trim is not null")
    hand = F.coalesce(N.manual(F.col("trim")), F.lit(False))
    return rows.select("id", (F.lower("trim").like("%auto%") & ~hand).alias("automatic"), hand.alias("manual"))


@query("k9_status", "SELECT id, CASE WHEN coalesce(scrape_status, '') = '' OR platform IS NULL OR platform IN ('', 'unknown', 'none') THEN 'generic' ELSE platform END AS platform, left(name || ': ' || coalesce(scrape_status, ''), 300) AS note FROM dealerships")
def _(s, d):
    """The statuses of a run in which every platform came back as unknown, with generic as the one known before where there was none."""
    rows = t(s, d, "dealerships")
    now = F.when(F.coalesce("scrape_status", F.lit("")) == "", F.lit("generic")).otherwise(F.lit("unknown"))
    before = F.when(F.coalesce("platform", F.lit("")).isin("", "unknown", "none"), F.lit("generic")).otherwise(F.col("platform"))
    return rows.select("id", status.kept_platform(before, now).alias("platform"), F.substring(F.concat("name", F.lit(": "), F.coalesce("scrape_status", F.lit(""))), 1, 300).alias("note"))


@query("c27_resolved_site", f"""
WITH r AS (SELECT id, name, zip, nullif(trim(coalesce(tags['website'], '')), '') AS own FROM (SELECT id, tags, nullif(trim(coalesce(tags['name'], '')), '') AS name, nullif(trim(coalesce(tags['addr:postcode'], '')), '') AS zip FROM osm_sample)),
n AS (SELECT norm, zip5, arg_min(website, (id, website)) AS site FROM (SELECT id, website, {_NAME} AS norm, {_ZIP5} AS zip5 FROM tx_directory WHERE coalesce(website, '') LIKE '%.%') WHERE norm <> '' AND zip5 <> '' GROUP BY 1, 2)
SELECT q.id, coalesce(own, site) AS website, CASE WHEN own IS NOT NULL THEN 'osm-tag' WHEN site IS NOT NULL THEN 'merge-fill' ELSE 'none' END AS website_source FROM (SELECT *, {_NAME} AS norm, {_ZIP5} AS zip5 FROM r) q LEFT JOIN n USING (norm, zip5)""")
def _(s, d):
    tag = lambda x: F.nullif(F.trim(F.coalesce(F.try_element_at("tags", F.lit(x)), F.lit(""))), F.lit(""))
    keyed = lambda df: df.withColumns({"norm": N.normalize_name(F.col("name")), "zip5": N.zip5(F.col("zip"))})
    rows = keyed(t(s, d, "osm_sample").select("id", tag("name").alias("name"), tag("addr:postcode").alias("zip"), tag("website").alias("own")))
    fill = linkage.preferred(keyed(t(s, d, "tx_directory").where("coalesce(website, '') like '%.%'")).where("norm <> '' and zip5 <> ''"), ["norm", "zip5"], ["website"], F.col("id")).withColumnRenamed("website", "site")
    return status.resolved(rows.join(fill, ["norm", "zip5"], "left"), {"osm-tag": "own", "merge-fill": "site"}).select("id", "website", "website_source")


@query("c28_budget", "WITH r AS (SELECT DISTINCT id, website FROM tx_directory WHERE coalesce(website, '') NOT LIKE '%.%') SELECT id, row_number() OVER (ORDER BY id) <= 20 AS called FROM r")
def _(s, d):
    rows = t(s, d, "tx_directory").where("coalesce(website, '') not like '%.%'").select("id", "website").distinct()
    return status.within_budget(rows, "id", 20).select("id", "called")


@query("c29_default_name", "SELECT id, coalesce(nullif(trim(coalesce(tags['name'], '')), ''), 'Unnamed dealer (osm:' || id || ')') AS name FROM osm_sample")
def _(s, d):
    return t(s, d, "osm_sample").select("id", status.named(F.try_element_at("tags", F.lit("name")), "osm", F.col("id")).alias("name"))


@query("e17_complete_deliveries", "WITH n AS (SELECT source, load_no, count(*) AS n FROM listing_snapshots GROUP BY 1, 2), e AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY source ORDER BY load_no), n) AS expected FROM n) SELECT source, load_no, n AS got, expected, n >= expected * 0.8 AS complete FROM e")
def _(s, d):
    n = t(s, d, "listing_snapshots").groupBy("source", "load_no").agg(F.count(F.lit(1)).alias("got"))
    return status.complete(n.withColumn("expected", F.coalesce(F.lag("got").over(W.partitionBy("source").orderBy("load_no")), "got")), "got", "expected", 0.8)


# matching into the dealers' table

_K3 = f"""
r AS (SELECT *, {HOST.format("website")} AS host, {_NAME} AS norm, {_ZIP5} AS zip5 FROM (SELECT DISTINCT id, cardealerdb_id, name, zip, website, lat, lng FROM tx_directory)), d AS (SELECT *, {HOST.format("website")} AS host, {_NAME} AS norm, {_ZIP5} AS zip5 FROM dealerships),
a AS (SELECT host, min(id) AS k FROM d WHERE host <> '' GROUP BY 1), c AS (SELECT norm, zip5, min(id) AS k FROM d WHERE norm <> '' AND zip5 <> '' GROUP BY 1, 2),
x AS (SELECT r.id, r.lat, r.lng, min(a.k) AS k0, min(b.id) AS k1, min(c.k) AS k2 FROM r LEFT JOIN a USING (host) LEFT JOIN d b ON b.id::VARCHAR = r.cardealerdb_id LEFT JOIN c ON c.norm = r.norm AND c.zip5 = r.zip5 GROUP BY ALL),
k AS (SELECT id, lat, lng, coalesce(k0, k1, k2) AS matched, CASE WHEN k0 IS NOT NULL THEN 1 WHEN k1 IS NOT NULL THEN 2 WHEN k2 IS NOT NULL THEN 3 END AS match_rule, coalesce(CASE WHEN k0 <> coalesce(k0, k1, k2) THEN k0 END, CASE WHEN k1 <> coalesce(k0, k1, k2) THEN k1 END, CASE WHEN k2 <> coalesce(k0, k1, k2) THEN k2 END) AS also FROM x)"""


def _matches(s, d):
    keyed = lambda df: df.withColumns({"host": N.host(F.col("website"), keep_port=True), "norm": N.normalize_name(F.col("name")), "zip5": N.zip5(F.col("zip"))})
    rows = keyed(t(s, d, "tx_directory").select("id", "cardealerdb_id", "name", "zip", "website", "lat", "lng").distinct()).withColumn("row", F.struct("id", "lat", "lng"))
    known = keyed(t(s, d, "dealerships")).select(F.col("id").alias("dealer"), F.col("id").cast("string").alias("cardealerdb_id"), "host", "norm", "zip5")
    out = upsert.matched_by_priority(rows.select("row", "cardealerdb_id", "host", "norm", "zip5"), known, [["host"], ["cardealerdb_id"], ["norm", "zip5"]], "dealer", "row")
    return out.groupBy("row").agg(*[F.min(c).alias(c) for c in ("matched", "match_rule", "also")]).select("row.*", "matched", "match_rule", "also")


@query("k3_three_rules", f"WITH {_K3} SELECT id, matched, match_rule, also FROM k")
def _(s, d):
    return _matches(s, d).select("id", "matched", "match_rule", "also")


@query("k3_folded", f"""WITH {_K3}, p AS (SELECT DISTINCT matched AS w, also AS l FROM k WHERE also IS NOT NULL), g AS (SELECT w AS id, min(nullif(phone, '')) AS phone, min(nullif(address, '')) AS address FROM p JOIN dealerships d ON d.id = p.l GROUP BY w), o AS (SELECT l AS id, min(w) AS canonical FROM p GROUP BY l)
SELECT d.id, coalesce(nullif(d.phone, ''), g.phone) AS phone, coalesce(nullif(d.address, ''), g.address) AS address, o.canonical FROM dealerships d LEFT JOIN g USING (id) LEFT JOIN o USING (id)""")
def _(s, d):
    return upsert.folded(t(s, d, "dealerships").select("id", "phone", "address"), _matches(s, d), "id", ["phone", "address"])


@query("e10_discovered", f"WITH {_K3}, m AS ({miles_sql(f'SELECT id, matched, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM k WHERE lat IS NOT NULL AND lng IS NOT NULL', 'lat', 'lng', 'a', 'b')}) SELECT count(*) AS in_range, count(*) FILTER (WHERE matched IS NULL) AS added FROM m WHERE miles <= 120")
def _(s, d):
    return geojoin.in_radius(_matches(s, d), *ORIGIN, 120).agg(F.count(F.lit(1)).alias("in_range"), F.count_if(F.col("matched").isNull()).alias("added"))


@query("k2_dealer_upsert", "WITH b AS (SELECT website, max(captured_at) AS at FROM tx_directory WHERE website IS NOT NULL GROUP BY 1) SELECT coalesce(d.website, b.website) AS website, d.name, epoch_us(CASE WHEN b.website IS NULL THEN d.last_seen ELSE b.at END) AS seen, d.website IS NULL AS is_new FROM (SELECT * FROM dealerships WHERE website IS NOT NULL) d FULL JOIN b ON b.website = d.website")
def _(s, d):
    batch = t(s, d, "tx_directory").where("website is not null").groupBy("website").agg(F.max("captured_at").alias("last_seen"))
    out = upsert.upsert(t(s, d, "dealerships").where("website is not null").select("website", "name", "last_seen"), batch, "website", [], ["last_seen"])
    return out.select("website", "name", F.unix_micros("last_seen").alias("seen"), "is_new")


@query("x12_j16_enriched", """
WITH c AS (SELECT url, vin, mileage, image_url FROM listing_snapshots), u AS (SELECT url, min(mileage) AS m, min(image_url) AS i FROM c WHERE coalesce(url, '') <> '' GROUP BY 1), v AS (SELECT vin, min(mileage) AS m, min(image_url) AS i FROM c WHERE coalesce(vin, '') <> '' GROUP BY 1)
SELECT l.id, coalesce(nullif(coalesce(nullif(l.mileage, 0), u.m), 0), v.m) AS mileage, coalesce(CASE WHEN coalesce(CASE WHEN l.image_url NOT IN ('', '0') THEN l.image_url END, u.i) NOT IN ('', '0') THEN coalesce(CASE WHEN l.image_url NOT IN ('', '0') THEN l.image_url END, u.i) END, v.i) AS image_url
FROM listings l LEFT JOIN u USING (url) LEFT JOIN v ON v.vin = l.vin""")
def _(s, d):
    return pages.enriched(t(s, d, "listings").select("id", "url", "vin", "mileage", "image_url"), t(s, d, "listing_snapshots").select("url", "vin", "mileage", "image_url"), ["url", "vin"], ["mileage", "image_url"]).select("id", "mileage", "image_url")


@query("j8_nearest_places", f"SELECT name, round(miles, 3) AS miles FROM ({miles_sql(f'SELECT zip AS name, lat, lng, {ORIGIN[0]}::DOUBLE AS a, {ORIGIN[1]}::DOUBLE AS b FROM zip_coords WHERE lat IS NOT NULL AND lng IS NOT NULL', 'lat', 'lng', 'a', 'b')}) WHERE miles <= 200 ORDER BY miles, name LIMIT 5")
def _(s, d):
    return geojoin.nearby_fixed(*ORIGIN, t(s, d, "zip_coords").select(F.col("zip").alias("name"), "lat", "lng"), 100).select("name", F.round("miles", 3).alias("miles"))
