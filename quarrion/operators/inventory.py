"""Differences between what a dealer listed before and lists now."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def inventory_diff(before: DataFrame, after: DataFrame, group: str | list[str] = "dealership_id", key: str = "vin") -> DataFrame:
    """(group, key, status) with status new, kept or sold. A group without any row afterwards is no news of it: nothing of it is sold. Rows with a null key are left out."""
    by = [group] if isinstance(group, str) else group
    old = before.where(f"{key} is not null and {key} <> ''").groupBy(*by, key).agg(F.lit(True).alias("_old"))
    new = after.where(f"{key} is not null and {key} <> ''").groupBy(*by, key).agg(F.lit(True).alias("_new"))
    read = after.groupBy(*by).agg(F.lit(True).alias("_read"))
    j = old.join(new, [*by, key], "full").join(read, by)
    return j.select(*by, key, F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "sold").otherwise("kept").alias("status"))


def moved(before: DataFrame, after: DataFrame, group: str | list[str] = "dealership_id", key: str = "vin", place: str = "url") -> DataFrame:
    """Rows of ``before`` whose key the same group now lists at another place and no longer at theirs."""
    by = [group] if isinstance(group, str) else group
    now = after.where(f"{key} is not null").select(*by, key, place).distinct()
    gone = before.where(f"{key} is not null and {key} <> ''").join(now, [*by, key, place], "left_anti")
    return gone.join(now.select(*by, key), [*by, key], "left_semi")


def consecutive(rows: DataFrame, load: str) -> tuple[DataFrame, DataFrame]:
    """Rows as what was there before each load, under that load's number, and as what the load delivered; the first load has nothing before."""
    first = rows.agg(F.min(load).alias("_first"))
    return rows.withColumn(load, F.col(load) + 1), rows.join(first, F.col(load) > F.col("_first")).drop("_first")


def scan_counters(before: DataFrame, after: DataFrame, group: list[str], key: str = "vin", place: str = "url") -> DataFrame:
    """(group, found, new, kept, sold, moved) of every group that was read: rows delivered, keys by status, and rows at a place left."""
    status = inventory_diff(before, after, group, key).groupBy(*group).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "kept", "sold")])
    gone = moved(before, after, group, key, place).groupBy(*group).agg(F.count(F.lit(1)).alias("moved"))
    found = after.groupBy(*group).agg(F.count(F.lit(1)).alias("found"))
    return found.join(status, group, "left").join(gone, group, "left").fillna(0, ["new", "kept", "sold", "moved"])
