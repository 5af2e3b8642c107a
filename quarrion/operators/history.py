"""Validity history of an attribute by tree-reduction coalescing of unit intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarrion.operators.readings import as_listed, readings, snapshot_order


def _joined(runs: Column) -> Column:
    """Neighbouring runs of an ordered array made one where they touch and the payload is equal or, in the later one, null."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        touch = (F.size(acc) > 0) & (x["lo"] == F.try_element_at(acc, F.lit(-1))["hi"] + 1)
        same = x["v"].isNull() | F.coalesce(x["v"] == F.try_element_at(acc, F.lit(-1))["v"], F.lit(False))
        wider = F.struct(last["v"].alias("v"), last["lo"].alias("lo"), x["hi"].alias("hi"), last["first"].alias("first"), x["last"].alias("last"))
        return F.when(touch & same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    empty = F.slice(runs, 1, 0)
    return F.aggregate(runs, empty, step)


def _merged(two: Column) -> Column:
    """Runs of two neighbouring segments put together: both are coalesced already, so only the seam is looked at.

    The left one's last run meets the right one's first and, if that states no payload, its second.
    """
    left, right = F.get(two, F.lit(0))["runs"], F.get(two, F.lit(1))["runs"]
    seam = _joined(F.concat(F.slice(left, F.size(left), F.lit(1)), F.slice(right, 1, 2)))
    whole = F.concat(F.slice(left, F.lit(1), F.size(left) - 1), seam, F.slice(right, F.lit(3), F.size(right)))
    return F.when(F.size(two) == 1, left).otherwise(whole)


def coalesce_history(units: DataFrame, entity: list[str], rounds: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Versions of an entity from its unit intervals.

    ``units`` has the entity columns, ``ord`` (position, from 0), ``label`` (what to call it) and ``v`` (payload, null:
    the entity is there, the payload is not stated and the running version goes on). Returns the entity columns,
    ``v``, ``first``, ``last`` (labels). Each round halves the number of segments of an entity: the runs of two
    neighbouring segments are put together and those that touch with an equal payload become one, so 2**rounds
    positions are covered. One shuffle on the entity serves every round. A segment holds at most one run a position;
    an entity never gathers more than its positions. Leading null payloads make no version.
    """
    extra = extra or {}
    unit = F.array(F.struct(F.col("v"), F.col("ord").alias("lo"), F.col("ord").alias("hi"), F.col("label").alias("first"), F.col("label").alias("last")))
    level = units.select(*entity, F.col("ord").alias("seg"), unit.alias("runs"), *extra).repartition(*entity)
    for _ in range(max(1, rounds)):
        pair = level.groupBy(*entity, F.shiftright("seg", 1).alias("seg")).agg(F.collect_list(F.struct("seg", "runs")).alias("two"), *(f.alias(n) for n, f in extra.items()))
        level = pair.withColumn("two", F.array_sort("two")).select(*entity, "seg", _merged(F.col("two")).alias("runs"), *extra)
    return level.select(*entity, *extra, F.explode("runs").alias("run")).where("run.v is not null").select(*entity, *extra, "run.v", "run.first", "run.last")


def price_history(snapshots: DataFrame, calendar: DataFrame, listings: DataFrame) -> DataFrame:
    """(url, price, from_snapshot, to_snapshot), one row a version of a listing's price.

    Positions are a source's existing snapshots, so a week without any row of the source does not end a version. A
    null price lets the version run on; an absence or another price ends it. Empty tables give no rows.
    """
    order = snapshot_order(snapshots, calendar)
    units = readings(snapshots, calendar).join(order.drop("last_ord"), ["source", "k"]).withColumnsRenamed({"k": "label", "price": "v"})
    n = calendar.count()
    runs = coalesce_history(units, ["source", "page"], max(1, (max(n, 1) - 1).bit_length()), {"www": F.max("www")})
    return as_listed(runs, listings).select("url", F.col("v").alias("price"), F.col("first").alias("from_snapshot"), F.col("last").alias("to_snapshot"))
