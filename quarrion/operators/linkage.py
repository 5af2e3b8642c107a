"""Record linkage by exact keys, blocks and shared sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrion.functions.similarity import token_set_of, token_sort_of
from quarrion.operators.graph import components
from quarrion.session import durable


def key_groups(rows: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """G1, A5: (key, group_id, n) of keys that two or more rows hold; group_id is the least id."""
    return rows.where(f"{key} is not null and {key} <> ''").groupBy(key).agg(F.min(id_).alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


def blocked_pairs(rows: DataFrame, block: list[str], id_: str, columns: list[str]) -> DataFrame:
    """Pairs of rows of one block, the lesser id first, with the columns of both sides. Equal rows are to be collapsed before; a hot block is a skewed key of an equality join."""
    a = rows.select(*block, F.col(id_).alias("id_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select(*block, F.col(id_).alias("id_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, block).where("id_a < id_b")


def alike(make: float = 85, trim: float = 60, apart: int = 500) -> tuple[Column, Column]:
    """G2 over the columns of ``blocked_pairs``: no two different vins, make and model alike, trims alike where both are given,
    mileage and price close wherever both are given, and at least one of the two given. Zero is missing. Returns what numbers and vins say, and what the texts say."""
    given = lambda c: (F.coalesce(F.col(f"{c}_a"), F.lit(0)) != 0) & (F.coalesce(F.col(f"{c}_b"), F.lit(0)) != 0)
    close = lambda c: ~given(c) | (F.abs(F.col(f"{c}_a").cast("bigint") - F.col(f"{c}_b")) <= apart)
    v = lambda s: F.upper(F.trim(F.coalesce(f"vin_{s}", F.lit(""))))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    cheap = ((v("a") == v("b")) | (v("a") == "") | (v("b") == "")) & (given("mileage") | given("price")) & close("mileage") & close("price")
    texts = (token_sort_of(low("make_a"), low("make_b")) >= make) & (token_sort_of(low("model_a"), low("model_b")) >= make)
    trims = (low("trim_a") == "") | (low("trim_b") == "") | (token_set_of(low("trim_a"), low("trim_b")) >= trim)
    return cheap, texts & trims


def near_pairs(rows: DataFrame, block: list[str], id_: str, columns: list[str], apart: int = 500) -> DataFrame:
    """Pairs of rows of one block that can be close in mileage and price, each once, with the columns of both sides (a and b in either order).

    No pair that ``alike`` takes is lost: where both rows give both numbers both must be close, otherwise the one that both
    give. So rows meet in cells of ``apart`` miles and dollars and the cells beside them, or in stretches of one number
    if a row lacks the other. Rows without either number have no pair. A hot block is cut by its cells.
    """
    at = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.floor(F.col(c).cast("bigint") / apart))
    cell = lambda view, x, y, mirrored=False: F.struct(F.lit(view).alias("view"), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(mirrored).alias("mirrored"))
    m, p, zero = at("mileage"), at("price"), F.lit(0)
    both = m.isNotNull() & p.isNotNull()
    rows = rows.where(m.isNotNull() | p.isNotNull())
    # of two cells side by side only one looks into the other; within a cell, and of two rows that lack the same number, each looks at the other
    looks = F.when(both, F.array(cell(0, m, p))).when(m.isNotNull(), F.array(*[cell(1, m + d, zero) for d in (-1, 0, 1)])).otherwise(F.array(*[cell(2, zero, p + d) for d in (-1, 0, 1)]))
    beside = [cell(0, m + x, p + y, (x, y) == (0, 0)) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]
    seen = F.when(both, F.array(*beside, cell(1, m, zero), cell(2, zero, p))).when(m.isNotNull(), F.array(cell(1, m, zero, True))).otherwise(F.array(cell(2, zero, p, True)))
    side = lambda s, cells: rows.select(*block, F.col(id_).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns], F.explode(cells).alias("cell"))
    key = ["cell.view", "cell.x", "cell.y"]
    a = side("a", looks).select("*", *key).drop("cell")
    b = side("b", seen).select("*", *key, "cell.mirrored").drop("cell")
    return a.join(b, [*block, "view", "x", "y"]).where("not mirrored or id_a < id_b").drop("view", "x", "y", "mirrored")


def fuzzy_pairs(rows: DataFrame, block: list[str]) -> DataFrame:
    """J9 with G2: (id_a, id_b), the lesser first. Numbers are compared in the join, texts afterwards and only for what is left."""
    cheap, texts = alike()
    met = near_pairs(rows, block, "id", ["vin", "make", "model", "trim", "mileage", "price"])
    return met.where(cheap).where(texts).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


#: Pairs of a component up to which one task works through them in order; larger components are worked through by rounds.
MOST_PAIRS = 50_000


def guarded_groups(pairs: DataFrame, rows: DataFrame, block: list[str], most: int = MOST_PAIRS) -> DataFrame:
    """(id, group_id) by joining pairs in order of ids unless that would put two vins into a group.

    A component of the pairs with at most one vin is a group whatever the order. Others depend on it: up to ``most`` pairs are worked through in one
    piece; a larger component is worked through by ``_by_rounds``, with the same result. ``block`` is not needed for the result.
    """
    parts = durable(components(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    vins = rows.select("id", F.upper(F.trim(F.coalesce("vin", F.lit("")))).alias("vin"))
    members = durable(parts.join(vins, "id"))
    sizes = pairs.join(parts.withColumnRenamed("id", "id_a"), "id_a").groupBy("root").agg(F.count(F.lit(1)).alias("pairs"))
    kinds = durable(members.groupBy("root").agg(F.min(F.when(F.col("vin") != "", F.col("vin"))).alias("low"), F.max("vin").alias("high")).join(sizes, "root").select("root", "pairs", F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("mixed")))
    plain = members.join(kinds.where("not mixed"), "root").select("id", F.col("root").alias("group_id"))
    edges = pairs.join(parts.withColumnRenamed("id", "id_a"), "id_a").join(kinds.where("mixed"), "root").join(vins.select(F.col("id").alias("id_a"), F.col("vin").alias("vin_a")), "id_a").join(vins.select(F.col("id").alias("id_b"), F.col("vin").alias("vin_b")), "id_b")
    edges = durable(edges.select("root", "pairs", "id_a", "vin_a", "id_b", "vin_b"))

    def unite(part: pd.DataFrame) -> pd.DataFrame:
        up, vin = {}, {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for r in part.sort_values(["id_a", "id_b"]).itertuples():
            for i, v in ((r.id_a, r.vin_a), (r.id_b, r.vin_b)):
                if i not in up:
                    up[i], vin[i] = i, v
            x, y = top(r.id_a), top(r.id_b)
            if x != y and not (vin[x] and vin[y] and vin[x] != vin[y]):
                x, y = min(x, y), max(x, y)
                up[y], vin[x] = x, vin[x] or vin[y]
        return pd.DataFrame({"id": list(up), "group_id": [top(i) for i in up]})

    small = edges.where(F.col("pairs") <= most).groupBy("root").applyInPandas(unite, "id long, group_id long")
    groups = plain.unionByName(small)
    large = edges.where(F.col("pairs") > most)
    if large.limit(1).count():
        groups = groups.unionByName(_by_rounds(large))
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return groups.join(sizes, "group_id").select("id", "group_id")


def _by_rounds(edges: DataFrame) -> DataFrame:
    """(id, group_id) as if ``edges`` were worked through one by one in order, many at a time.

    A pair that is the first left of both its groups is not touched by any earlier one, so all such pairs of a round are
    joined at once. Groups keep their vin and never lose it, so a pair of two vins can be dropped as soon as it is seen.
    """
    ids = edges.select(F.col("id_a").alias("id"), F.col("vin_a").alias("vin")).unionByName(edges.select(F.col("id_b").alias("id"), F.col("vin_b").alias("vin"))).distinct()
    state = durable(ids.select("id", F.col("id").alias("group_id"), "vin"))
    left = durable(edges.select("id_a", "id_b"))
    while True:
        a = state.select(F.col("id").alias("id_a"), F.col("group_id").alias("g_a"), F.col("vin").alias("v_a"))
        b = state.select(F.col("id").alias("id_b"), F.col("group_id").alias("g_b"), F.col("vin").alias("v_b"))
        left = durable(left.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").where("g_a <> g_b and (v_a = '' or v_b = '' or v_a = v_b)"))
        pair = F.struct("id_a", "id_b")
        first = left.select(F.explode(F.array("g_a", "g_b")).alias("g"), pair.alias("p")).groupBy("g").agg(F.min("p").alias("p"))
        ready = left.withColumn("p", pair).join(first.withColumnRenamed("g", "g_a"), ["g_a", "p"], "left_semi").join(first.withColumnRenamed("g", "g_b"), ["g_b", "p"], "left_semi")
        moves = durable(ready.select(F.explode(F.array("g_a", "g_b")).alias("group_id"), F.least("g_a", "g_b").alias("to"), F.when(F.col("v_a") != "", F.col("v_a")).otherwise(F.col("v_b")).alias("to_vin")))
        if not moves.limit(1).count():
            return state.select("id", "group_id")
        state = durable(state.join(moves, "group_id", "left").select("id", F.coalesce("to", "group_id").alias("group_id"), F.coalesce("to_vin", "vin").alias("vin")))


def set_jaccard(members: DataFrame, owner: str, item: str, least: float) -> DataFrame:
    """(a, b, jaccard) of owners whose item sets overlap by at least ``least``.

    Two such owners share one of their rarest items: of n items all but ``least`` times n, and one. Only these meet in the inverted index, so an
    item that very many owners hold (a stand-in) pairs nobody by itself; whole sets are counted for the pairs that met.
    """
    m = members.where(f"{owner} is not null and {item} is not null").select(F.col(owner).alias("o"), F.col(item).alias("i")).distinct()
    held = m.groupBy("i").agg(F.count(F.lit(1)).alias("held"))
    n = m.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    m = durable(m.join(n, "o").join(held, "i"))
    rarest = m.withColumn("at", F.row_number().over(W.partitionBy("o").orderBy("held", "i"))).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    a, b = rarest.select("i", F.col("o").alias("a"), F.col("n").alias("na")), rarest.select("i", F.col("o").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "i").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb"))).select("a", "b", "na", "nb").distinct()
    both = met.join(m.select(F.col("o").alias("a"), "i"), "a").join(m.select(F.col("o").alias("b"), "i"), ["b", "i"]).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("common"))
    return both.withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).where(F.col("jaccard") >= least).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def preferred(rows: DataFrame, keys: list[str], columns: list[str], rank: Column) -> DataFrame:
    """Per key and column the non-empty value of the row that ranks lowest, by aggregation."""
    return rows.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(rank, F.col(c)))).alias(c) for c in columns])
