"""Snapshots of a table from deliveries that arrive late, twice or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrion.functions.urls import has_www, page_key


def _dated(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``k``, the snapshot whose period holds ``seen``; rows of no period are left out.

    The calendar is joined on the day, an equality, with the exact bounds as a residual; it has a row per
    snapshot, so Spark's own size threshold decides whether it is broadcast.
    """
    days = calendar.select(F.col("load_no").alias("k"), "week_start", "week_end", F.explode(F.sequence(F.to_date("week_start"), F.to_date("week_end"))).alias("day"))
    return rows.join(days, (F.to_date(rows["seen"]) == days["day"]) & (rows["seen"] >= days["week_start"]) & (rows["seen"] < days["week_end"])).drop("day", "week_start", "week_end")


def snapshot_order(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """(source, k, ord, last_ord): a source's existing snapshots numbered without gaps from 0."""
    own = _dated(snapshots.select("source", F.col("last_seen").alias("seen")), calendar).groupBy("source", "k").agg(F.lit(1).alias("one"))
    w = W.partitionBy("source")
    return own.select("source", "k", (F.row_number().over(w.orderBy("k")) - 1).alias("ord")).withColumn("last_ord", F.max("ord").over(w))


def readings(snapshots: DataFrame, calendar: DataFrame) -> DataFrame:
    """(source, page, k, price, www): of each page in each snapshot the reading with the latest ``last_seen``.

    Ties go to the later delivery, then to the higher price. Rows without url, source or last_seen are no readings.
    """
    rows = snapshots.select("source", page_key(F.col("url")).alias("page"), has_www(F.col("url")).alias("www"), F.col("last_seen").alias("seen"), "load_no", "price")
    rows = _dated(rows.where(F.col("page").isNotNull() & F.col("source").isNotNull()), calendar)
    latest = F.max(F.struct("seen", "load_no", "price"))
    return rows.groupBy("source", "page", "k").agg(latest.alias("r"), F.max("www").alias("www")).select("source", "page", "k", F.col("r.price").alias("price"), "www")


def as_listed(found: DataFrame, listings: DataFrame) -> DataFrame:
    """Replaces ``page`` (and ``www``) by the clean ``url`` of listings; a page unknown there gets its https spelling."""
    clean = listings.where("url is not null").groupBy(page_key(F.col("url")).alias("page")).agg(F.min("url").alias("clean"))
    spelt = F.concat(F.lit("https://"), F.when(F.col("www"), F.lit("www.")).otherwise(F.lit("")), F.col("page"))
    return found.join(clean, "page", "left").withColumn("url", F.coalesce("clean", spelt)).drop("page", "www", "clean")
