"""Faceted search over current listings and the lookups around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrion.functions.normalize import manual


def conditions(f: dict) -> list[Column]:
    """The predicates of the given filters. A missing, null, zero or empty value filters nothing."""
    on = lambda k: f.get(k)
    out = []
    if on("make"):
        out.append(F.lower("make") == on("make").lower())
    if on("model"):
        out.append(F.lower("model").like(f"%{on('model').lower()}%"))
    for key, column, low in (("year_min", "year", True), ("year_max", "year", False), ("price_min", "price", True), ("price_max", "price", False), ("mileage_max", "mileage", False)):
        if on(key):
            out.append(F.col(column) >= on(key) if low else F.col(column) <= on(key))
    if on("source"):
        out.append(F.col("source") == on("source"))
    if on("transmission") == "manual":
        out.append(manual(F.col("transmission")))
    if on("transmission") == "automatic":
        out.append((F.coalesce("transmission", F.lit("")) != "") & ~manual(F.col("transmission")))
    if on("hide_duplicates"):
        out.append(F.col("is_duplicate") == 0)
    return out


def thin(field: str) -> Column:
    """an address of its own and nothing in ``field``."""
    return F.col("url").isNotNull() & ~F.contains("url", F.lit("#")) & (F.coalesce(F.col(field), F.lit(0)) == 0)


def arguments(raw: dict[str, str | None]) -> dict:
    """filters of a request's arguments: numbers where they can be read, flags only as ``1``, the rest as text; unreadable ones are left out."""
    numbers, out = {"year_min", "year_max", "price_min", "price_max", "mileage_max"}, {}
    for k, v in raw.items():
        if v is None:
            continue
        if k in numbers:
            try:
                out[k] = int(v)
            except ValueError:
                pass
        elif k == "hide_duplicates":
            out[k] = v == "1"
        else:
            out[k] = v
    return out


def with_dealer(listings: DataFrame, dealers: DataFrame) -> DataFrame:
    """Every listing with its dealer's name and website, null without one."""
    d = dealers.select(F.col("id").alias("dealership_id"), F.col("name").alias("dealer_name"), F.col("website").alias("dealer_website"))
    return listings.join(d, "dealership_id", "left")


def search(listings: DataFrame, dealers: DataFrame, filters: dict) -> DataFrame:
    """Active listings that meet the filters, with dealer and ``duplicate_count``, the active listings of the group
    whatever the filters (1 without a group), cheapest first and unpriced last.

    Groups are counted by aggregation and joined back, so a group that holds a third of all rows is one row of the count.
    """
    active = listings.where("is_active = 1")
    sizes = active.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("n"))
    rows = reduce(lambda d, c: d.where(c), conditions(filters), active)
    rows = with_dealer(rows.join(sizes, "duplicate_group_id", "left"), dealers).withColumn("duplicate_count", F.coalesce("n", F.lit(1))).drop("n")
    return rows.orderBy(F.asc_nulls_last("price"), "id")


def dealer_counts(dealers: DataFrame, listings: DataFrame) -> DataFrame:
    """Every dealer with its number of active listings, 0 for none."""
    n = listings.where("is_active = 1").groupBy(F.col("dealership_id").alias("id")).agg(F.count(F.lit(1)).alias("active_listings"))
    return dealers.join(n, "id", "left").fillna({"active_listings": 0})


def top_of(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key in ``order``, which must break every tie."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def latest(df: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """W5 by aggregation: the values of each key's row with the greatest ``at`` (ties: greatest values). Nothing is sorted, and a hot key combines before the shuffle."""
    return df.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.max(F.struct(at, *values)).alias("r")).select(*keys, "r.*")


def ordered_distinct(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Each key's first row by position."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))
