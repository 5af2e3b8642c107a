"""Duplicate listings as one pipeline: exact keys, guarded fuzzy groups of what is left, one canonical row a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrion.operators import linkage


def canonical_rows(rows: DataFrame, group: str, price: str = "price", distance: str = "distance_mi", id_: str = "id", floor: int = 1000, share: float = 0.4) -> DataFrame:
    """Adds ``rank`` within the group and ``is_duplicate`` (rank above 1): a suspect price (none, under ``floor`` or under ``share`` of the
    group's greatest) last, then the least price, the least distance (none last), the least id. Rows without a group are left out."""
    top = F.max(F.nullif(F.col(price), F.lit(0))).over(W.partitionBy(group))
    suspect = F.coalesce((F.col(price) < floor) | (F.col(price) < share * F.col("_top")), F.lit(True))
    order = W.partitionBy(group).orderBy("_suspect", F.asc_nulls_last(price), F.asc_nulls_last(distance), id_)
    ranked = rows.where(F.col(group).isNotNull()).withColumn("_top", top).withColumn("_suspect", suspect).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("is_duplicate", (F.col("rank") > 1).cast("int")).drop("_top", "_suspect")


def grouped(rows: DataFrame, block: list[str]) -> DataFrame:
    """G1, G3 in turn: (id, group_id, match_method) of rows that share a group. Rows of equal vin first; only rows that are in no such
    group are compared by ``fuzzy_pairs`` and joined under the guard. A group's id is its least row's."""
    by_vin = linkage.key_groups(rows, "vin").select("vin", "group_id")
    exact = rows.join(by_vin, "vin").select("id", "group_id", F.lit("vin").alias("match_method"))
    left = rows.join(exact.select("id"), "id", "left_anti")
    fuzzy = linkage.guarded_groups(linkage.fuzzy_pairs(left, block), left, block)
    return exact.unionByName(fuzzy.select("id", "group_id", F.lit("fuzzy").alias("match_method")))


def deduplicated(rows: DataFrame, block: list[str]) -> DataFrame:
    """(id, group_id, match_method, rank, is_duplicate) of every grouped row. What an earlier run left in the rows is not read, so
    a second run gives the same."""
    groups = grouped(rows, block)
    return canonical_rows(rows.select("id", "price", "distance_mi").join(groups, "id"), "group_id").select("id", "group_id", "match_method", "rank", "is_duplicate")
