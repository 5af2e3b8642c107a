"""Column profiles by character-class masks, and the loads whose columns came altered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quarrion.session import durable

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

#: Share of rows a mask must have in a column's ordinary loads; below it a value violates the pattern.
RARE = 0.01
#: Least change of a load against its source's ordinary loads that counts as altered: share of nulls,
#: factor between shares of distinct values, and Jensen-Shannon divergence in bits of the two mask distributions.
NULLS, DISTINCT, DIVERGENCE = 0.25, 2.0, 0.025


def text_mask(v: Column) -> Column:
    """Character-class mask of a text: letters and digits by class, runs of a class as one.

    A code (letters and digits in one word of at most 40 characters) keeps its length instead, with X for an upper-case
    letter or digit and x for a code in lower case, since the places of its letters say nothing. Long texts
    are masked over their whole length. Blank texts have the mask of an empty text.
    """
    v = F.trim(v)
    code = (F.length(v) <= 40) & v.rlike("^[A-Za-z0-9]*$") & v.rlike("[0-9]")
    as_code = F.when(v == F.upper(v), F.regexp_replace(v, "[A-Z0-9]", "X")).otherwise(F.regexp_replace(v, "[A-Za-z0-9]", "x"))
    plain = F.translate(v, UPPER + LOWER + DIGIT, "A" * 26 + "a" * 26 + "9" * 10)
    return F.when(code, as_code).otherwise(F.regexp_replace(plain, r"(.)\1+", "$1"))


def number_mask(v: Column) -> Column:
    """Digits as 9 with the trailing zeros kept, and the magnitude in quarters of a power of two."""
    text = F.regexp_replace(F.abs(v).cast("string"), "[1-9][0-9]*?(?=0*$)", "9")
    size = F.floor(F.log2(F.abs(v).cast("double") + 1) * 4).cast("int")
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), text, F.lit("|"), size.cast("string"))


def time_mask(v: Column, week: Column | None = None) -> Column:
    """T where the time of day is set, else D, and the signed offset in hours from the load's week in halves of a power of two; without a week the offset is from 1970."""
    v = v.cast("timestamp")
    hours = (F.unix_seconds(v) - (F.lit(0) if week is None else F.coalesce(F.unix_seconds(week.cast("timestamp")), F.lit(0)))) / 3600
    size = (F.signum(hours) * F.floor(F.log2(F.abs(hours) + 1) * 2)).cast("int")
    return F.concat(F.when(F.date_trunc("day", v) == v, F.lit("D")).otherwise(F.lit("T")), F.lit("|"), F.when(v.isNotNull(), size).cast("string"))


def _mask(df: DataFrame, name: str, week: Column | None = None) -> Column:
    kind, v = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.NumericType,)):
        return number_mask(v)
    if isinstance(kind, T.StringType):
        return text_mask(v)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return time_mask(v, week)
    return F.lit(kind.simpleString())


def mask_counts(df: DataFrame, by: list[str], columns: list[str], week: Column | None = None) -> DataFrame:
    """(by, column_name, mask, n): how often each mask occurs; the mask of null is null.

    One pass over the named columns with partial aggregation before the only shuffle; a hot group arrives as one row
    per mask and task. The counts are kept, since shares and divergences read them several times.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), _mask(df, c, week).alias("mask")) for c in columns]))
    return durable(df.select(*by, cells.alias("c")).groupBy(*by, "c.column_name", "c.mask").count().withColumnRenamed("count", "n"))


def column_stats(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column_name, n_rows, n_null, n_distinct, low, high); n_distinct by HyperLogLog with 2 % error.

    ``low`` and ``high`` are the least and greatest value, as text. A blank text is a value.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        v = F.col(c)
        aggs += [F.struct(F.count_if(v.isNull()).alias("n_null"), F.approx_count_distinct(v, 0.02).alias("n_distinct"), F.min(v).cast("string").alias("low"), F.max(v).cast("string").alias("high")).alias(f"stat_{c}")]
    flat = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"stat_{c}")[x].alias(x) for x in ("n_null", "n_distinct", "low", "high")]) for c in columns]))
    return df.groupBy(*by).agg(*aggs).select(*by, "n_rows", flat.alias("s")).select(*by, "n_rows", "s.*")


def _shares(counts: DataFrame, source: list[str], load: str) -> DataFrame:
    """Adds each mask's share in its load and its ordinary share, the median over the source's loads (a load without it has 0).

    The ordinary shares of a column are scaled to sum to 1.
    """
    of_load = counts.groupBy(*source, load, "column_name").agg(F.sum("n").alias("_all"))
    loads = counts.groupBy(*source, "column_name").agg(F.countDistinct(load).alias("loads"))
    counts = counts.join(of_load, [*source, load, "column_name"]).withColumn("share", F.col("n") / F.col("_all")).drop("_all").join(loads, [*source, "column_name"])
    ordered = F.sort_array(F.concat(F.collect_list("share"), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.first("loads").cast("int") - F.count(F.lit(1)).cast("int")))))
    half = lambda d: F.element_at(ordered, F.floor((F.first("loads") + d) / 2).cast("int"))
    ordinary = counts.groupBy(*source, "column_name", "mask").agg(((half(1) + half(2)) / 2).alias("ordinary"))
    total = ordinary.groupBy(*source, "column_name").agg(F.sum("ordinary").alias("_all"))
    ordinary = ordinary.join(total, [*source, "column_name"]).withColumn("ordinary", F.coalesce(F.try_divide("ordinary", "_all"), F.lit(0.0))).drop("_all")
    keys = [c for c in (*source, "column_name")]
    grid = counts.select(*source, load, "column_name").distinct().join(ordinary, keys)
    own = counts.select(*source, load, "column_name", F.coalesce("mask", F.lit("\0")).alias("mask"), "n", "share")
    return grid.withColumn("mask", F.coalesce("mask", F.lit("\0"))).join(own, [*source, load, "column_name", "mask"], "left").fillna({"share": 0.0, "n": 0})


def _divergence(shares: DataFrame, by: list[str], mask: Column) -> DataFrame:
    """Jensen-Shannon divergence (bits) of a load's shares of ``mask`` from the ordinary ones."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    term = F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)
    return shares.groupBy(*by, mask.alias("m")).agg(F.sum("share").alias("p"), F.sum("ordinary").alias("q"), F.sum("n").alias("n")).groupBy(*by).agg((F.sum(term) / 2).alias("js"), F.count_if((p > 0) | (q > 0)).alias("cells"), F.sum("n").alias("rows"))


def load_divergence(counts: DataFrame, source: list[str], load: str) -> DataFrame:
    """(source, load, column_name, divergence): greater of the divergences of masks and of magnitudes, less what chance gives."""
    shares = _shares(counts, source, load)
    by = [*source, load, "column_name"]
    whole, size = F.substring_index("mask", "|", 1), F.regexp_extract("mask", r"\|(-?\d+)$", 1)
    net = F.greatest(F.lit(0.0), F.col("js") - F.col("cells") / (F.greatest("rows", F.lit(1)) * 4 * 0.693))
    parts = [_divergence(shares, by, m).select(*by, net.alias("divergence")) for m in (whole, size)]
    return parts[0].unionByName(parts[1]).groupBy(*by).agg(F.max("divergence").alias("divergence"))


def profile(df: DataFrame, source: list[str], load: str, columns: list[str], weeks: DataFrame | None = None) -> DataFrame:
    """Profile of every column per source and load, with mask violations and divergence between loads.

    A rare-mask violation is a value whose mask has less than RARE of the column's values in the source's
    ordinary loads. Nulls are counted as nulls and as a mask of their own. Empty input gives no rows.
    Timestamps are masked by their offset from the load's week in ``weeks`` (load, week_start).
    """
    by = [*source, load]
    if weeks is None:
        counts = mask_counts(df, by, columns)
    else:
        known = weeks.groupBy(load).agg(F.min("week_start").alias("\0week"))
        counts = mask_counts(df.select(*by, *columns).join(known, load, "left"), by, columns, F.col("\0week"))
    shares = _shares(counts, source, load)
    top = F.max(F.when(F.col("mask") != "\0", F.struct("share", "mask"))).getField("mask")
    masks = shares.groupBy(*by, "column_name").agg(F.sum(F.when((F.col("mask") != "\0") & (F.col("ordinary") < RARE), F.col("n")).otherwise(0)).alias("n_violations"), F.count_if(F.col("n") > 0).alias("n_masks"), top.alias("dominant_mask"))
    return column_stats(df, by, columns).join(masks, [*by, "column_name"]).join(load_divergence(counts, source, load), [*by, "column_name"])


def altered_loads(df: DataFrame, source: list[str], load: str, columns: list[str]) -> DataFrame:
    """(source, load, column_name) of the columns that a load carries altered.

    Against the medians over the source's loads: a share of nulls higher or lower by NULLS, distinct values among the
    non-null ones fewer (or more) by the factor DISTINCT, or a mask or magnitude distribution apart by DIVERGENCE.
    A median does not follow single bad loads, and slow drift stays below the thresholds.
    """
    by = [*source, load, "column_name"]
    stats = column_stats(df, [*source, load], columns)
    w = W.partitionBy(*source, "column_name")
    stats = stats.withColumns({"null_rate": F.col("n_null") / F.col("n_rows"), "variety": F.try_divide(F.col("n_distinct"), (F.col("n_rows") - F.col("n_null")))})
    stats = stats.withColumns({"null_mid": F.median("null_rate").over(w), "variety_mid": F.median("variety").over(w)})
    joined = stats.join(load_divergence(mask_counts(df, [*source, load], columns), source, load), by)
    nulls = F.abs(F.col("null_rate") - F.col("null_mid")) > NULLS
    variety = (F.col("variety") * DISTINCT < F.col("variety_mid")) | (F.col("variety") > DISTINCT * F.col("variety_mid"))
    return joined.withColumn("altered", F.coalesce(nulls | variety | (F.col("divergence") > DIVERGENCE), F.lit(False)))
