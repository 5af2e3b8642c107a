"""Connected components of a plain edge list by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrion.session import durable


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (a, b; any one orderable type): root is the least vertex of its component.

    Alternating stars reach the result in logarithmically many rounds; hubs are keys of aggregations that combine before
    the shuffle. Nulls and loops are no edges; no edges give no rows.
    """
    big = durable(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), broadcast=False)
    before = None
    while True:
        ring = big.unionByName(big.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ring.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = ring.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        big = durable(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), broadcast=False)
        now = big.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if now == before:
            return big.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(big.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = now
