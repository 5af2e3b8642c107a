"""Dealers: quality of their listings, clusters of equal inventories, canonical ones, merged candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrion.functions.normalize import name_domain_score, normalize_name, zip5
from quarrion.functions.similarity import token_set_of
from quarrion.operators import kpi
from quarrion.operators.graph import components
from quarrion.operators.linkage import set_jaccard

#: Rates with their limits and weights, in the order of the flags; platforms of which mileage is expected; flags that count alone.
RULES = [("synthetic_urls", 0.05, 40), ("missing_vin", 0.10, 25), ("missing_price", 0.20, 20), ("missing_mileage", 0.50, 15), ("missing_image", 0.50, 10)]
THIN = ("generic", "sitemap")
GRAVE = ("synthetic_urls", "missing_vin")


def quality(listings: DataFrame, dealers: DataFrame, least: int = 3) -> DataFrame:
    """(dealership_id, n, five rates, flags, score, flagged) of dealers with ``least`` active listings; one aggregation by dealer."""
    rows = listings.where("is_active = 1 and dealership_id is not null")
    gone = lambda c: ~F.coalesce(kpi.filled(c, rows), F.lit(False))
    tests = {"synthetic_urls": (F.coalesce("url", F.lit("")) == "") | F.contains("url", F.lit("#")), "missing_vin": gone("vin"), "missing_price": gone("price"), "missing_mileage": gone("mileage"), "missing_image": gone("image_url")}
    rates = kpi.shares(rows, ["dealership_id"], tests).where(F.col("n") >= least)
    rates = rates.join(dealers.select(F.col("id").alias("dealership_id"), "platform"), "dealership_id", "left")
    # mileage counts where the platform delivers it
    judged = rates.withColumn("_m", F.col("missing_mileage")).withColumn("missing_mileage", F.when(F.coalesce("platform", F.lit("")).isin(*THIN), F.col("_m")).otherwise(F.lit(0.0)))
    out = kpi.weighted_score(judged, RULES).withColumn("missing_mileage", F.col("_m")).drop("_m", "platform")
    return out.withColumn("flagged", (F.col("score") < 80) | F.arrays_overlap(F.split("flags", ","), F.array(*[F.lit(g) for g in GRAVE])))


def quality_log(scored: DataFrame) -> DataFrame:
    """A log row (run_type, action, dealer, detail) for every flagged dealer."""
    return scored.where("flagged").select(F.lit("quality").alias("run_type"), F.lit("quality_flag").alias("action"), F.col("dealership_id").alias("dealer"), F.substring(F.concat(F.lit("score "), "score", F.lit(": "), "flags"), 1, 400).alias("detail"))


def canonical(members: DataFrame, cluster: str, order: list[Column], key: str) -> DataFrame:
    """(key, canonical): of each cluster the member that ranks first, for all of its members."""
    first = F.first(key).over(W.partitionBy(cluster).orderBy(*order, F.col(key).asc()))
    return members.withColumn("canonical", first).select(key, "canonical")


def inventory_clusters(members: DataFrame, owner: str, item: str, least: float) -> DataFrame:
    """(owner, canonical) of owners whose inventories are, directly or in steps, alike by ``least``; the one with most items is canonical."""
    alike = set_jaccard(members, owner, item, least)
    parts = components(alike.select("a", "b")).withColumnRenamed("id", owner)
    n = members.where(F.col(item).isNotNull()).groupBy(owner).agg(F.countDistinct(item).alias("n"))
    return canonical(parts.join(n, owner), "root", [F.col("n").desc()], owner)


def best_named(rows: DataFrame, keys: list[str], domain: str, name: str = "name", id_: str = "id") -> DataFrame:
    """Adds ``rank`` (1 is kept, the rest is garbage): the name that says most words of the domain, ties by id."""
    score = name_domain_score(F.col(name), F.col(domain))
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(id_).asc())))


def name_pairs(rows: DataFrame, least: float = 90) -> DataFrame:
    """(a, b) keys of records (key, name, zip) of one five-digit postcode whose normalised names' words agree by ``least``.

    Different names of a postcode are compared once; records of one name are linked to the least of them, a star and not all pairs.
    """
    named = rows.select("key", normalize_name(F.col("name")).alias("name"), zip5(F.col("zip")).alias("zip5")).where("name <> '' and zip5 <> ''")
    stars = named.groupBy("zip5", "name").agg(F.min("key").alias("low"))
    same = named.join(stars, ["zip5", "name"]).where("key <> low").select(F.col("low").alias("a"), F.col("key").alias("b"))
    x, y = stars.select("zip5", F.col("name").alias("n1"), F.col("low").alias("k1")), stars.select("zip5", F.col("name").alias("n2"), F.col("low").alias("k2"))
    near = x.join(y, "zip5").where("n1 < n2").where(token_set_of(F.col("n1"), F.col("n2")) >= least).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))
    return same.unionByName(near).distinct()


def merged(rows: DataFrame, order: dict[str, int], registry: str, least: float = 90) -> DataFrame:
    """One row for every group of candidates (key, source, name, address, city, state, zip, phone, website, host) that share a host or, in a
    postcode, a name: (root, n, fields). The ``registry`` source wins who and where it is, the others the website; otherwise sources in
    ``order``, then the key."""
    low = rows.where("host <> ''").groupBy("host").agg(F.min("key").alias("a"))
    edges = rows.join(low, "host").where("key <> a").select("a", F.col("key").alias("b")).unionByName(name_pairs(rows, least))
    parts = components(edges)
    all_of = rows.join(parts.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    at = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("source")), F.lit(len(order)))
    official = F.when(F.col("source") == registry, 0).otherwise(1)

    def pick(c: str, rank: Column) -> Column:
        return F.min_by(F.col(c), F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.struct(rank, at, F.col("key")))).alias(c)

    fields = [pick(c, official) for c in ("name", "address", "city", "state", "zip", "phone")] + [pick("website", 1 - official)]
    return all_of.groupBy("root").agg(F.count(F.lit(1)).alias("n"), *fields)
