"""Counts, completeness and shares over listings and dealers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def filled(column: str, df: DataFrame) -> Column:
    """Whether a field says something: not null, blank or zero."""
    c = F.col(column)
    return c.isNotNull() & ((c != "") if dict(df.dtypes)[column] == "string" else (c != 0))


def completeness(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Per group and field the percentage of filled values, one row a field. One pass and one shuffle of a row a group and task."""
    aggs = [F.bround(100.0 * F.sum(F.when(filled(f, rows), 1).otherwise(0)) / F.count(F.lit(1)), 1).alias(f) for f in fields]
    wide = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggs)
    return wide.unpivot([by, "n"], fields, "field", "pct")


def shares(rows: DataFrame, by: list[str], tests: dict[str, Column]) -> DataFrame:
    """Per group the number of rows and the share of rows that meet each test."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.when(t, 1.0).otherwise(0.0)), 6).alias(k) for k, t in tests.items()])


def weighted_score(rates: DataFrame, rules: list[tuple[str, float, float]]) -> DataFrame:
    """Flags of rates over their limit, and 100 less weight times rate of each, rounded half to even and at least 0.

    ``rules``: (rate column, limit, weight) in the flags' order.
    """
    over = [(r, F.col(r) > limit, w) for r, limit, w in rules]
    score = F.lit(100.0)
    for r, t, w in over:
        score = score - F.when(t, F.lit(float(w)) * F.col(r)).otherwise(0.0)
    flags = F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t, _ in over]))
    return rates.withColumns({"flags": F.concat_ws(",", flags), "score": F.greatest(F.lit(0), F.bround(score).cast("int"))})


def argmax(rows: DataFrame, keys: list[str], value: str, rank: list[Column]) -> DataFrame:
    """The value of each key's row that ranks highest, by aggregation."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*rank)).alias(value))
