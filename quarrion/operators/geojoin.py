"""Lookups, radius joins and nearest neighbours over postcode centres."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrion.functions.geo import box, with_miles


def zip_lookup(df: DataFrame, zips: DataFrame, zip_col: str = "zip") -> DataFrame:
    """Adds ``zip_lat`` and ``zip_lng`` of the first five characters; null where unknown. An equality join whose side Spark broadcasts only below its threshold."""
    z = zips.groupBy(F.col("zip").alias("_zip")).agg(F.min("lat").alias("zip_lat"), F.min("lng").alias("zip_lng"))
    return df.withColumn("_zip", F.substring(F.trim(zip_col), 1, 5)).join(z, "_zip", "left").drop("_zip")


def in_radius(points: DataFrame, lat: float, lng: float, miles: float) -> DataFrame:
    """Points (lat, lng) within a distance of one origin, with ``distance_mi`` to one place, the box first.

    A filter that reaches the scan; rows without coordinates are left out.
    """
    tall, wide = box(F.lit(lat), miles)
    near = points.where(F.col("lat").between(lat - tall, lat + tall) & F.col("lng").between(lng - wide, lng + wide))
    near = with_miles(near.withColumns({"_lat0": F.lit(float(lat)), "_lng0": F.lit(float(lng))}), "lat", "lng", "_lat0", "_lng0")
    return near.where(F.col("miles") <= miles).withColumn("distance_mi", F.round("miles", 1)).drop("miles", "_lat0", "_lng0")


def nearest(points: DataFrame, key: str, centres: DataFrame, name: str, reach: float = 0.5) -> DataFrame:
    """For each point the nearest centre within ``reach`` degrees either way, ties by name; null if none.

    Points and centres meet in grid cells of that size, an equality join, never all with all.
    """
    cell = lambda lat, lng, i, j: (F.floor(lat / reach) + i) * 10_000 + F.floor(lng / reach) + j
    p = points.select(F.col(key).alias("_key"), F.col("lat").alias("_plat"), F.col("lng").alias("_plng"), cell(F.col("lat"), F.col("lng"), 0, 0).alias("_cell"))
    around = F.explode(F.array(*[cell(F.col("lat"), F.col("lng"), i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    c = centres.where("lat is not null and lng is not null").select(F.col(name).alias("_name"), F.col("lat").alias("_clat"), F.col("lng").alias("_clng"), around.alias("_cell"))
    met = p.join(c, "_cell").where((F.abs(F.col("_plat") - F.col("_clat")) <= reach) & (F.abs(F.col("_plng") - F.col("_clng")) <= reach))
    best = with_miles(met, "_plat", "_plng", "_clat", "_clng").groupBy("_key").agg(F.min(F.struct("miles", "_name")).alias("b")).select(F.col("_key").alias(key), F.col("b._name").alias(f"nearest_{name}"), F.round("b.miles", 3).alias("miles"))
    return points.join(best, key, "left")


def nearby_fixed(lat: float, lng: float, places: DataFrame, radius: float, k: int = 5) -> DataFrame:
    """Of a short list of places the ``k`` nearest within the radius and a margin of 100 miles."""
    d = with_miles(places.withColumns({"_a": F.lit(float(lat)), "_b": F.lit(float(lng))}), "_a", "_b", "lat", "lng")
    return d.where(F.col("miles") <= radius + 100).orderBy("miles", "name").limit(k)


def reorigin(points: DataFrame, lat: float, lng: float, tag: str) -> DataFrame:
    """Every point with coordinates gets its distance from a new origin and its tag; others keep theirs."""
    d = with_miles(points.withColumns({"_a": F.lit(float(lat)), "_b": F.lit(float(lng))}), "_a", "_b", "lat", "lng").drop("_a", "_b")
    return d.withColumns({"distance_mi": F.round("miles", 1), "location_tag": F.when(F.col("miles").isNotNull(), F.lit(tag))}).drop("miles")


def registry_in_radius(registry: DataFrame, zips: DataFrame, lat: float, lng: float, miles: float) -> DataFrame:
    """Candidates of a registry, named by trade name, at their postcode's centre within a distance; only states with a postcode there are read."""
    near = in_radius(zips, lat, lng, miles)
    rows = registry.join(near.select("state").distinct(), "state", "left_semi")
    placed = zip_lookup(rows, zips).where("zip_lat is not null").drop("lat", "lng").withColumnsRenamed({"zip_lat": "lat", "zip_lng": "lng"})
    name = F.coalesce(F.nullif(F.trim("dba"), F.lit("")), F.col("name"))
    return in_radius(placed.withColumn("name", name).withColumn("source_id", F.col("license_no")), lat, lng, miles)
