"""Small row operators around runs: what was delivered, found, resolved and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Platforms that say nothing.
UNSAID = ("", "unknown", "none")


def run_audit(rows: DataFrame, source: str, load: str, key: str) -> DataFrame:
    """(source, load, found, inserted, status): rows delivered and keys that no earlier load held. Null keys are found but never inserted.

    Keys are collapsed to one row a load before their first load is looked up.
    """
    each = rows.groupBy(source, load, key).agg(F.count(F.lit(1)).alias("n"))
    first = each.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(load).alias("_first"))
    j = each.join(first, key, "left")
    there = F.sum(F.when(F.col(key).isNotNull(), F.col("n")).otherwise(0)) > 0
    return j.groupBy(source, load).agg(F.sum("n").alias("found"), F.count_if(F.col("_first") == F.col(load)).alias("inserted"), F.when(there, "ok").otherwise("empty").alias("status"))


def kept_platform(before: Column, now: Column) -> Column:
    """K9: the new platform unless it says nothing and an earlier one did."""
    said = lambda c: F.when(~F.coalesce(c, F.lit("")).isin(*UNSAID), c)
    return F.coalesce(said(now), said(before), now)


def matched_link(links: Column, vin: Column, slug: Column) -> Column:
    """The first link that holds the vin, else the first that holds the slug, else ``#`` and what there is of the two; within the row."""
    holding = lambda what: F.get(F.filter(links, lambda u: (F.length(what) >= 6) & F.contains(F.lower(u), F.lower(what))), F.lit(0))
    return F.coalesce(holding(vin), holding(slug), F.concat(F.lit("#"), F.coalesce(vin, slug)))


def gate(rows: DataFrame, known: DataFrame, first: list[str], second: list[str], at: str) -> DataFrame:
    """Adds ``at``, when the known record was last looked at: the one of equal ``first`` columns, else of equal non-empty ``second`` columns (latest)."""
    whole = F.lit(True)
    for c in second:
        whole = whole & (F.col(c) != "")
    a = known.groupBy(*first).agg(F.max(at).alias("_at1"))
    b = known.where(whole).groupBy(*second).agg(F.max(at).alias("_at2"))
    return rows.join(a, first, "left").join(b, second, "left").withColumn(at, F.coalesce("_at1", "_at2")).drop("_at1", "_at2")


def resolved(rows: DataFrame, chain: dict[str, str]) -> DataFrame:
    """Adds ``website``, the first of the columns in ``chain`` (name to column) that says something, and ``website_source``, its name or none."""
    given = [(n, F.nullif(F.trim(c), F.lit(""))) for n, c in chain.items()]
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in given], F.lit("none"))
    return rows.withColumns({"website": F.coalesce(*[c for _, c in given]), "website_source": source})


def within_budget(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Adds ``called``, whether a row is among the first ``most`` in order; only those are numbered, by a top-k and not by sorting all."""
    first = rows.orderBy(order).limit(most).select(F.col(order).alias("_o"), F.lit(True).alias("_in")).distinct()
    return rows.join(first, F.col(order) == F.col("_o"), "left").withColumn("called", F.col("_in").isNotNull()).drop("_o", "_in")


def named(name: Column, source: str, key: Column) -> Column:
    """The name, or one made of source and key where it says nothing."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit(f"Unnamed dealer ({source}:"), key.cast("string"), F.lit(")")))


def complete(rows: DataFrame, got: str, expected: str, least: float = 1.0) -> DataFrame:
    """Adds ``complete``, whether at least that share of what was expected arrived."""
    return rows.withColumn("complete", F.col(got) >= F.col(expected) * least)
