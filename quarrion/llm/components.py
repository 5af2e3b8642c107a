"""Groups of records linked directly or indirectly: strip leaves, compress chains, solve the core, restore labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quarrion import session
from quarrion.operators.graph import components

#: Share of vertices of degree one or two below which a round hands over to the solver of the core.
HAND_OVER = 0.1
#: Doublings of pointers between two checkpoints.
DOUBLINGS = 1


def durable(df: DataFrame) -> DataFrame:
    """A round's result, without broadcasts and in no more partitions than a shuffle has: unions would add theirs up."""
    return session.durable(df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), broadcast=False)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge once in either direction, without loops."""
    e = edges.where("u <> v")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is in ``gone`` (x)."""
    for end in ("u", "v"):
        edges = edges.join(gone.select(F.col("x").alias(end)), end, "left_anti")
    return edges.select("u", "v")


def _leaves(ends: DataFrame) -> DataFrame:
    """(x, to): degree-one vertices with their neighbour; of two joined leaves only the greater goes."""
    one = ends.where("deg = 1").select(F.col("u").alias("x"), F.col("a").alias("to"))
    mate = one.select(F.col("x").alias("to"), F.lit(True).alias("leaf"))
    return one.join(mate, "to", "left").where("leaf is null or x > to").select("x", "to")


def _rank_chains(chain: DataFrame) -> DataFrame:
    """(x, p, q, low): the ends p <= q of the chain of each degree-two vertex x (u, a, b); a closed ring has no ends
    but its least vertex ``low``.

    List ranking by pointer doubling over directed arcs: the arc that enters x from one side leads to the arc
    that leaves on the other, and each round doubles the distance, so a chain of n takes log2(n) rounds. ``low``
    is the least vertex passed. Rounds end when no pointer and no least vertex changes, which only rings outlast.
    """
    step = lambda s, t: chain.select(F.col(s).alias("from"), F.col("u").alias("x"), F.col("u").alias("at"), F.col(t).alias("next"), F.least("u", t).alias("low"))
    arcs = step("a", "b").unionByName(step("b", "a"))
    arcs = durable(arcs.join(chain.select(F.col("u").alias("next"), F.lit(True).alias("open")), "next", "left").select("from", "x", "at", "next", "low", F.coalesce("open", F.lit(False)).alias("open")))
    while True:
        arcs = arcs.withColumn("news", F.lit(False))
        for _ in range(DOUBLINGS):
            ahead = arcs.select(F.col("from").alias("at"), F.col("x").alias("next"), F.col("at").alias("at2"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("open").alias("open2"))
            moved = arcs.where("open").join(ahead, ["at", "next"]).select("from", "x", F.col("at2").alias("at"), F.col("next2").alias("next"), F.least("low", "low2").alias("low"), F.col("open2").alias("open"), (F.col("news") | ~F.col("open2") | (F.col("low2") < F.col("low"))).alias("news"))
            arcs = arcs.where("not open").unionByName(moved)
        arcs = durable(arcs)
        state = arcs.agg(F.max("open").alias("open"), F.max("news").alias("news")).first()
        arcs = arcs.drop("news")
        if not state["open"] or not state["news"]:
            break
    return arcs.groupBy("x").agg(F.min(F.when(~F.col("open"), F.col("next"))).alias("p"), F.max(F.when(~F.col("open"), F.col("next"))).alias("q"), F.min("low").alias("low"))


def _follow(parents: DataFrame) -> DataFrame:
    """(x, to) with ``to`` the root, by doubling; a vertex without a parent is a root."""
    while True:
        up = parents.select(F.col("x").alias("to"), F.col("to").alias("to2"))
        parents = durable(parents.join(up, "to", "left").select("x", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")))
        more = parents.where("moved").limit(1).count()
        parents = parents.drop("moved")
        if not more:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(x, root) for every vertex of ``edges`` (u, v long): vertices have the same root if and only if they are linked.

    Every round strips the degree-one vertices and compresses the maximal chains of degree-two vertices to one edge by
    list ranking, each taken vertex pointing at the one that stays; rounds are logarithmic in a tree's size. When a
    round finds too few of them to be worth a pass over the edges (HAND_OVER), what is left, most of it of degree three and more, is
    solved by stars; then pointers are followed back. A hub of any degree is one
    key of aggregations that combine before the shuffle; joins on it are left to the adaptive skew join. Nothing
    but counts reaches the driver. Nulls and loops are no edges, repeated edges count once, no edges give no rows.
    """
    edges = durable(_both_ways(edges.where("u is not null and v is not null").select("u", "v")))
    taken = []
    while True:
        ends = durable(edges.groupBy("u").agg(F.count(F.lit(1)).alias("deg"), F.min("v").alias("a"), F.max("v").alias("b")))
        n = ends.agg(F.count_if(F.col("deg") == 1).alias("one"), F.count_if(F.col("deg") == 2).alias("two"), F.count(F.lit(1)).alias("all")).first()
        if n["one"] + n["two"] <= HAND_OVER * n["all"]:
            break
        out, links = [], None
        if n["one"]:
            gone = durable(_leaves(ends))
            taken.append(gone)
            out.append(gone.select("x"))
        if n["two"]:
            # degrees before the strip: a vertex that has just lost a leaf waits for the next round
            chain = ends.where("deg = 2").select("u", "a", "b")
            if n["one"]:
                for end in ("a", "b"):
                    chain = chain.join(gone.select(F.col("x").alias(end)), end, "left_anti")
            chain = durable(chain)
            if chain.limit(1).count():
                ranks = durable(_rank_chains(chain))
                taken.append(ranks.select("x", F.coalesce("p", "low").alias("to")).where("x <> to"))
                links = _both_ways(ranks.where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v")))
                out.append(ranks.select("x"))
        # one removal a round, for leaves and chains together
        edges = _without(edges, reduce(DataFrame.unionByName, out))
        edges = durable(edges if links is None else edges.unionByName(links).distinct())
    if n["all"]:
        taken.append(components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("x"), F.col("root").alias("to")).where("x <> to"))
    if not taken:
        return edges.select(F.col("u").alias("x"), F.col("v").alias("root"))
    parents = _follow(durable(reduce(DataFrame.unionByName, taken)))
    roots = parents.select(F.col("to").alias("x")).distinct()
    return parents.withColumnRenamed("to", "root").unionByName(roots.select("x", F.col("x").alias("root"))).distinct()


def listing_links(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): links of listings. A group id or vin links each of its listings to the least of them, a star and never all
    pairs; a value of one listing links nothing and is dropped before the graph is built.

    Pairs: the latest decision on two listings counts in either order (ties: the greatest pair_id). A pair with a null
    id or a listing paired with itself links nothing. Vins: blanks and hyphens removed, upper case, 17 characters.
    Values are compared by 64 bits of hash.
    """
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    decided = pairs.where("id_a is not null and id_b is not null and id_a <> id_b").groupBy(low.alias("u"), high.alias("v"))
    by_pair = decided.agg(F.max(F.struct("decided_at", "pair_id", "is_match")).alias("last")).where("last.is_match = 1").select("u", "v")
    vin = F.upper(F.regexp_replace("vin", r"[\s\-]", ""))
    named = lambda kind, key: F.when(key.isNotNull(), F.xxhash64(F.lit(kind), key))
    keys = F.array_compact(F.array(named("g", F.col("duplicate_group_id")), named("v", F.when(F.length(vin) == 17, vin))))
    held = listings.where("id is not null").select(F.col("id").alias("u"), F.explode(keys).alias("h"))
    stars = held.groupBy("h").agg(F.min("u").alias("v"), F.max("u").alias("top")).where("v < top").select("h", "v")
    return by_pair.unionByName(held.join(stars, "h").where("u <> v").select("u", "v"))


def listing_groups(listings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id) of every listing in a group of two or more; group_id is the smallest id of the group.

    Empty tables give no rows.
    """
    parts = durable(connected_components(listing_links(listings, pairs)))
    least = parts.groupBy("root").agg(F.min("x").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return parts.join(least, "root").select(F.col("x").alias("id"), "group_id")
