"""Keyed changes of a table: snapshot in, snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def collapsed(batch: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row a key of a batch: per column the last non-null value in order, as if the rows were applied one by one."""
    at = F.struct(*order)
    return batch.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def upsert(current: DataFrame, batch: DataFrame, key: str, fill: list[str], replace: list[str] = ()) -> DataFrame:
    """Rows of ``current`` and ``batch`` (one row a key) by key. ``fill`` columns take the batch's value unless it is null,
    ``replace`` columns always, the rest keep theirs; new keys get what the batch has. Columns as in ``current``, and ``is_new``.
    """
    b = batch.select(key, *[F.col(c).alias(f"_new_{c}") for c in batch.columns if c != key], F.lit(True).alias("_in_batch"))
    j = current.withColumn("_old", F.lit(True)).join(b, key, "full")
    old, new = F.col("_old").isNotNull(), F.col("_in_batch").isNotNull()

    def value(c: str):
        if c == key or c not in batch.columns:
            return F.col(c)
        n = F.col(f"_new_{c}")
        if c in fill:
            return F.coalesce(n, F.col(c)).alias(c)
        if c in replace:
            return F.when(new, n).otherwise(F.col(c)).alias(c)
        return F.when(old, F.col(c)).otherwise(n).alias(c)

    return j.select(*[value(c) for c in current.columns], (~old).alias("is_new"))


def insert_or_ignore(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of the batch whose key is new are added."""
    return current.unionByName(batch.join(current.select(key), key, "left_anti").select(current.columns))


def insert_or_replace(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """K5: rows of the batch take the place of those with their key."""
    return current.join(batch.select(key), key, "left_anti").unionByName(batch.select(current.columns))


def delete_keys(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """K11."""
    return current.join(gone.select(key), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """K6: only the partitions that ``df`` has are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def matched_by_priority(rows: DataFrame, current: DataFrame, rules: list[list[str]], key: str, row_key: str) -> DataFrame:
    """For each row the key of the current row that the first rule to match names; ``match_rule`` is its number (null: none), and
    ``also`` the key that a later rule names instead, to be folded. Each rule is a list of equal columns; null or empty ones do not match.
    """
    out = rows
    for i, cols in enumerate(rules):
        whole = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in cols]
        known = current
        for w in whole:
            known = known.where(w)
        known = known.groupBy(*cols).agg(F.min(key).alias(f"_k{i}"))
        hit = rows
        for w in whole:
            hit = hit.where(w)
        out = out.join(hit.join(known, cols).groupBy(row_key).agg(F.min(f"_k{i}").alias(f"_k{i}")), row_key, "left")
    keys = [F.col(f"_k{i}") for i in range(len(rules))]
    first = F.coalesce(*keys)
    rule = F.coalesce(*[F.when(k.isNotNull(), F.lit(i + 1)) for i, k in enumerate(keys)])
    other = F.coalesce(*[F.when(k != first, k) for k in keys])
    return out.withColumns({"matched": first, "match_rule": rule, "also": other}).drop(*[f"_k{i}" for i in range(len(rules))])


def folded(current: DataFrame, matches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """K3: ``current`` after rows that matched two of its keys (``matched``, ``also``): the second is folded into the first.

    Adds ``canonical``, the key that a folded row stands for (null for others; of several the least). Fields that a winner
    lacks are filled from those folded into it, the least value. A row that wins over others and is folded itself keeps what it was given.
    """
    pairs = matches.where(F.col("also").isNotNull()).select(F.col("matched").alias("_w"), F.col("also").alias("_l")).distinct()
    said = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    given = pairs.join(current.select(F.col(key).alias("_l"), *[said(c).alias(f"_f_{c}") for c in fields]), "_l").groupBy(F.col("_w").alias(key)).agg(*[F.min(f"_f_{c}").alias(f"_f_{c}") for c in fields])
    lost = pairs.groupBy(F.col("_l").alias(key)).agg(F.min("_w").alias("canonical"))
    out = current.join(given, key, "left").join(lost, key, "left")
    return out.withColumns({c: F.coalesce(said(c), F.col(f"_f_{c}")) for c in fields}).drop(*[f"_f_{c}" for c in fields])
