"""Candidates of several sources merged, matched into the dealers' table and placed around an origin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarrion.functions.normalize import host, normalize_name, zip5
from quarrion.operators import geojoin, upsert
from quarrion.operators.dealers import merged
from quarrion.operators.status import named

#: Columns of a candidate.
CANDIDATE = ("key", "source", "name", "address", "city", "state", "zip", "phone", "website")


def discovered(sources: dict[str, DataFrame], dealers: DataFrame, zips: DataFrame, order: dict[str, int], registry: str, lat: float, lng: float, miles: float) -> DataFrame:
    """One row for every dealer that the sources (name to candidates with CANDIDATE, website text or null) show within ``miles`` of an origin.

    Candidates of all sources are put together and merged (G5), placed by postcode and kept inside the radius (J7), then matched to
    dealers (id, name, zip, website) by host, else by name and postcode (K3). Returns ``root``, the merged fields, ``distance_mi``,
    ``dealer`` (the matched id) and ``is_new``. Matching what was found again adds nothing. Candidates without a known postcode lie nowhere.
    """
    whole = reduce(DataFrame.unionByName, [df.select(*CANDIDATE) for df in sources.values()]).withColumn("host", host(F.col("website"), keep_port=True))
    placed = geojoin.zip_lookup(merged(whole, order, registry), zips).withColumnsRenamed({"zip_lat": "lat", "zip_lng": "lng"})
    near = geojoin.in_radius(placed.where("lat is not null"), lat, lng, miles).drop("lat", "lng")
    keyed = lambda df: df.withColumns({"host": host(F.col("website"), keep_port=True), "norm": normalize_name(F.col("name")), "zip5": zip5(F.col("zip"))})
    rows, known = keyed(near), keyed(dealers.select(F.col("id").alias("dealer"), "name", "zip", "website"))
    hit = upsert.matched_by_priority(rows.select("root", "host", "norm", "zip5"), known.select("dealer", "host", "norm", "zip5"), [["host"], ["norm", "zip5"]], "dealer", "root").select("root", F.col("matched").alias("dealer"))
    out = near.join(hit, "root", "left").withColumn("name", named(F.col("name"), "candidate", F.col("root")))
    return out.withColumn("is_new", F.col("dealer").isNull())
