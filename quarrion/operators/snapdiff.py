"""Changes between consecutive full snapshots by content-defined chunks of key-sorted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quarrion.operators.readings import as_listed, readings, snapshot_order

#: Mean rows of a chunk, and rows of all snapshots that one sorted stretch should hold.
CHUNK_ROWS = 8
STRETCH_ROWS = 40_000


def chunked(rows: DataFrame, stretches: int) -> DataFrame:
    """Chunks of ``rows`` (source, ord, page, price, ...): (source, stretch, chunk, ord, digest, rows).

    A snapshot is cut into stretches by a hash of the key, so that no source's snapshot meets in one task, and each
    stretch is sorted by key. A chunk begins at every key whose hash is a multiple of CHUNK_ROWS: its bounds depend on
    the keys there, and an insertion or removal changes only the chunk that it falls into. The digest is the count
    and two xors of 64-bit row hashes.
    """
    h = F.xxhash64("page")
    rows = rows.withColumn("stretch", F.pmod(F.xxhash64("page", F.lit(7)), F.lit(stretches))).repartition("source", "stretch")
    before = W.partitionBy("source", "stretch", "ord").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("chunk", F.coalesce(F.last(F.when(F.pmod(h, F.lit(CHUNK_ROWS)) == 0, h), ignorenulls=True).over(before), F.lit(0)))
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("page", "price", F.col("price").isNull())).alias("a"), F.bit_xor(F.xxhash64(F.lit(3), "price", F.col("price").isNull(), "page")).alias("b"))
    return rows.groupBy("source", "stretch", "chunk", "ord", "k", "last_ord").agg(digest.alias("digest"), F.collect_list(F.struct("page", "price", "www")).alias("rows"))


def snapshot_changes(snapshots: DataFrame, calendar: DataFrame, listings: DataFrame) -> DataFrame:
    """(snapshot_no, url, change_kind): added, removed or changed against the source's snapshot before.

    Chunks with the digest of the same chunk in the neighbouring snapshot are discarded; only rows of the others are
    matched by key. A null price is a price of its own. The first snapshot of a source gives nothing; empty
    tables give no rows.
    """
    order = snapshot_order(snapshots, calendar)
    rows = readings(snapshots, calendar).join(order, ["source", "k"])
    chunks = chunked(rows, max(1, snapshots.count() // STRETCH_ROWS))
    w = W.partitionBy("source", "stretch", "chunk").orderBy("ord")
    like = lambda f, d: F.coalesce((f("ord").over(w) == F.col("ord") + d) & (f("digest").over(w) == F.col("digest")), F.lit(False))
    chunks = chunks.withColumns({"as_new": (F.col("ord") > 0) & ~like(F.lag, -1), "as_old": (F.col("ord") < F.col("last_ord")) & ~like(F.lead, 1)})
    roles = F.array_compact(F.array(F.when(F.col("as_new"), F.struct(F.col("ord").alias("at"), F.lit(True).alias("new"))), F.when(F.col("as_old"), F.struct((F.col("ord") + 1).alias("at"), F.lit(False).alias("new")))))
    open_rows = chunks.where("as_new or as_old").select("source", "stretch", F.explode(roles).alias("role"), "rows").select("source", "stretch", "role.*", F.explode("rows").alias("r"))
    new, old = F.col("new"), ~F.col("new")
    sides = open_rows.groupBy("source", "stretch", F.col("r.page").alias("page"), "at").agg(
        F.max(new).alias("in_new"), F.max(old).alias("in_old"), F.max(F.when(new, F.col("r.price"))).alias("p_new"), F.max(F.when(old, F.col("r.price"))).alias("p_old"), F.max("r.www").alias("www")
    )
    kind = F.when(~F.col("in_old"), F.lit("added")).when(~F.col("in_new"), F.lit("removed")).when(~F.col("p_new").eqNullSafe(F.col("p_old")), F.lit("changed"))
    found = sides.withColumn("change_kind", kind).where("change_kind is not null")
    named = found.join(order.select("source", F.col("ord").alias("at"), F.col("k").alias("snapshot_no")), ["source", "at"])
    return as_listed(named, listings).select("snapshot_no", "url", "change_kind")
