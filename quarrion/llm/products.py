"""Listings of one product: rare-token blocks, inverse-frequency-weighted n-gram cosine, vetoes, clusters around versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrion.session import durable

#: Least cosine of two words' n-grams at which they are compared as one word misspelt.
COSINE = 0.2
#: Words in a row that can be one name.
WIDEST = 3
#: Rows (of some fifty bytes) of the catalogue or of misspelt words up to which they are broadcast; more are joined by a shuffle.
MOST_SENT = 100_000
#: Spellings of drives with the drives they allow (1 all, 2 front, 4 rear), and units of power in horse power.
DRIVES = [
    (1, r"\b(?:awd|4wd|4x4|4 ?x ?4|all[ -]wheel(?:[ -]drive)?|four[ -]wheel(?:[ -]drive)?|quattro)\b"),
    (2, r"\b(?:fwd|front[ -]wheel(?:[ -]drive)?)\b"),
    (4, r"\b(?:rwd|rear[ -]wheel(?:[ -]drive)?)\b"),
    (6, r"\b(?:2wd|4x2|two[ -]wheel(?:[ -]drive)?)\b"),
]
POWER = {"hp": 1.0, "bhp": 1.0, "ps": 0.98632, "kw": 1.34102}
#: Advertising that holds the word of a trim, short forms of trims, bodies.
PRAISE = r"(?i)\b(?:limited (?:offer|time|warranty)|premium (?:sound|audio|wheels|package)|sport (?:seats|suspension|mode)|touring tires)\b"
SHORT = {r"(?i)\bprem\.?(?=\s|$)": "premium", r"(?i)\b(?:ltd\.?|lim\.)(?=\s|$)": "limited", r"(?i)\btitan\.(?=\s|$)": "titanium", r"(?i)\btour\.(?=\s|$)": "touring"}
BODY = r"(?i)\b(?:sedan|coupe|hatchback|suv|pickup|wagon)\b"
_POWER = r"(?i)(\d{2,4})\s*(hp|bhp|ps|kw)\b"
_CUBIC = r"(?i)\b(\d{3,4})\s*(?:ccm|cm3|cc)\b"
_LITRE = r"(?i)\b(\d)[.,](\d)\s*(?:l\b|liter\b|litre\b|-liter\b|-litre\b|l?(?=[\s/,;-]|$))"


def _sent(small: DataFrame) -> DataFrame:
    """A kept table that is broadcast if it was counted to hold no more than MOST_SENT rows."""
    small = durable(small)
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def bare(text: Column) -> Column:
    """The letters and digits of a text, in lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _cut(df: DataFrame, pattern: str) -> DataFrame:
    return df.withColumn("text", F.regexp_replace("text", pattern, " "))


def wordings(listings: DataFrame) -> DataFrame:
    """(make, model, trim, words, drives, litres, power): the different wordings, numbers and drives taken out of the text.

    ``words`` are the bare words that remain; ``drives``, ``litres`` and ``power`` are null where nothing is stated.
    """
    df = listings.select("make", "model", "trim").distinct()
    df = _cut(df.withColumn("text", F.concat_ws(" ", "make", "model", "trim")), PRAISE)
    for short, whole in SHORT.items():
        df = df.withColumn("text", F.regexp_replace("text", short, whole))
    df = df.withColumn("drives", F.lit(None).cast("int"))
    for kinds, p in DRIVES:
        p = f"(?i){p}"
        df = _cut(df.withColumn("drives", F.when(F.col("text").rlike(p), F.coalesce("drives", F.lit(7)).bitwiseAND(F.lit(kinds))).otherwise(F.col("drives"))), p)
    first = lambda p, i: F.nullif(F.regexp_extract("text", p, i), F.lit(""))
    unit = F.create_map(*[F.lit(x) for kv in POWER.items() for x in kv])
    df = _cut(df.withColumn("power", first(_POWER, 1).try_cast("double") * F.try_element_at(unit, F.lower(first(_POWER, 2)))), _POWER)
    df = _cut(df.withColumn("litres", F.round(first(_CUBIC, 1).try_cast("double") / 1000, 1)), _CUBIC)
    df = _cut(df.withColumn("litres", F.coalesce(F.concat(first(_LITRE, 1), F.lit("."), first(_LITRE, 2)).try_cast("double"), "litres")), _LITRE)
    df = _cut(df, BODY)
    words = F.filter(F.transform(F.split("text", r"[\s/,;|()*★]+"), bare), lambda w: w != "")
    return df.select("make", "model", "trim", words.alias("words"), "drives", "litres", "power", (F.coalesce(bare(F.col("make")), F.lit("")) != "").alias("says_make"))


def grams(word: Column) -> Column:
    """The different pieces of two and three letters of a word with its ends marked."""
    w = F.concat(F.lit("^"), word, F.lit("$"))
    pieces = lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array())
    return F.array_distinct(F.concat(pieces(2), pieces(3)))


def name_pieces(names: DataFrame) -> tuple[DataFrame, int]:
    """(name, kind, g, weight, name_norm) of the pieces of names (name, kind), weighted by inverse frequency, and the number of different names."""
    names = names.distinct()
    total = names.select("name").distinct().count()
    pieces = names.select("name", "kind", F.explode(grams(F.col("name"))).alias("g"))
    pieces = pieces.withColumn("weight", F.log(1 + F.lit(total) / F.size(F.collect_set("name").over(W.partitionBy("g"))))).repartition("name")
    return pieces.withColumn("name_norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("name", "kind")))), total


def near_names(asked: DataFrame, pieces: DataFrame, total: int, kind: str) -> DataFrame:
    """(w, name_, cosine): for every asked word (w) the names of a kind that it misspells.

    Pieces of letters are the blocks: a word meets the names that share one, are at most two letters longer or shorter and have the
    same digits (numbers that conflict never meet). The cosine is weighted by the inverse frequency of the pieces
    among the names and summed by aggregation; what reaches COSINE is confirmed by its edits, one, two from eight letters
    on, where neighbouring letters exchanged are one.
    """
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    weights = pieces.select("g", "weight").distinct()
    own = asked.select("w", F.explode(grams(F.col("w"))).alias("g")).join(weights, "g", "left")
    own = own.withColumn("norm", F.sum(F.pow(F.coalesce("weight", F.lit(math.log(1 + total))), F.lit(2))).over(W.partitionBy("w"))).where("weight is not null").drop("weight")
    met = own.join(pieces.where(F.col("kind") == kind), "g").where((F.abs(F.length("w") - F.length("name")) <= 2) & (digits(F.col("w")) == digits(F.col("name"))))
    dots = met.groupBy("w", "name", "norm", "name_norm").agg(F.sum(F.col("weight") * F.col("weight")).alias("dot"))
    close = dots.withColumn("cosine", F.col("dot") / F.sqrt("norm") / F.col("name_norm")).where(F.col("cosine") >= COSINE)
    edits = F.levenshtein("w", "name")
    letters = lambda c: F.array_sort(F.split(c, ""))
    allowed = 1 + (F.least(F.length("w"), F.length("name")) >= 8).cast("int")
    # letters exchanged cost Levenshtein two and keep the letters' multiset
    return close.where((edits <= allowed) | ((edits <= 2 * allowed) & (letters(F.col("w")) == letters(F.col("name"))))).select("w", F.col("name").alias("name_"), "cosine")


def _spelt(windows: DataFrame, catalogue: tuple[DataFrame, int], kind: str) -> DataFrame:
    """(w, name_, cosine): the names of a kind that the different stretches of ``windows`` misspell."""
    return _sent(near_names(windows.select("w").distinct(), *catalogue, kind))


def _windows(df: DataFrame, words: Column, widest: int, narrowest: int = 1) -> DataFrame:
    """Adds a row for every stretch of up to ``widest`` words: its place ``i`` (from 1), size ``n`` and joined letters ``w``."""

    def of(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.struct(i.alias("i"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, F.lit(n)), "").alias("w")))
        return F.when(F.size(words) >= n, each).otherwise(F.array())

    places = F.flatten(F.array(*[of(n) for n in range(widest, narrowest - 1, -1)]))
    return df.select("*", F.explode(places).alias("x")).select("*", "x.i", "x.n", "x.w").drop("x")


def _without(words: Column, i: Column, n: Column) -> Column:
    """Words but for the ``n`` ones from place ``i`` on."""
    return F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + n, F.size(words)))


def _with_makes(names: DataFrame, makes: DataFrame, models: DataFrame, catalogue: tuple[DataFrame, int]) -> DataFrame:
    """Adds ``makes``, the makes that the first words can mean (null: none), and ``rest``, the words but for theirs.

    Two words before one, exact before misspelt; then the first word misspelt, shortened (its letters stand in a make's name in order, the
    first one first) or as initials.
    """
    head = _windows(names.select("name", "words"), F.slice(F.col("words"), 1, 3), 2).where("i <= 2")
    exact = head.join(makes.select(F.col("make").alias("w"), "make"), "w").select("name", "i", "n", F.lit(0).alias("wrong"), F.lit(0.0).alias("far"), "make")
    spelt = _spelt(head, catalogue, "make")
    wrong = head.where("n = 2").join(spelt, "w").select("name", "i", "n", F.lit(1).alias("wrong"), (-F.col("cosine")).alias("far"), F.col("name_").alias("make"))
    best = exact.unionByName(wrong).groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("wide"), "i", "wrong", "far", "make")).alias("m"))
    best = best.select("name", F.array("m.make").alias("makes"), F.col("m.i").alias("at"), (-F.col("m.wide")).alias("many"))
    lone = names.select("name", F.get("words", F.lit(0)).alias("w")).where("w is not null").join(best, "name", "left_anti").join(models.select(F.col("model").alias("w")).distinct(), "w", "left_anti")
    asked = lone.select("w").distinct()
    long = asked.where(F.length("w") >= 3)
    misspelt = long.join(spelt, "w").groupBy("w").agg(F.array(F.min(F.struct(-F.col("cosine"), "name_"))["name_"]).alias("makes"))
    in_order = F.rlike("make", F.concat(F.lit("^"), F.array_join(F.split("w", ""), ".*")))
    # blocked by the first letter
    short = long.join(misspelt, "w", "left_anti").join(makes, F.substring("w", 1, 1) == F.substring("make", 1, 1)).where(in_order).groupBy("w").agg(F.array_sort(F.collect_set("make")).alias("makes"))
    initials = asked.where(F.length("w") == 2).join(makes.select(F.col("initials").alias("w"), "make"), "w").groupBy("w").agg(F.array(F.min("make")).alias("makes"))
    alone = lone.join(misspelt.unionByName(short).unionByName(initials), "w").select("name", "makes", F.lit(1).alias("at"), F.lit(1).alias("many"))
    out = names.join(best.unionByName(alone), "name", "left")
    return out.withColumn("rest", F.when(F.col("makes").isNull(), F.col("words")).otherwise(_without(F.col("words"), F.col("at"), F.col("many")))).drop("at", "many", "words")


def _with_family(names: DataFrame, models: DataFrame, makes: DataFrame, trims: DataFrame, catalogue: tuple[DataFrame, int]) -> DataFrame:
    """Adds the family (``make``, ``model``) that the words name, exact names before misspelt and longer before shorter, and ``left``, the words but for it."""
    windows = _windows(names.select("name", "makes", "rest"), F.col("rest"), WIDEST).drop("rest")
    allowed = F.col("makes").isNull() | F.array_contains("makes", F.col("make"))
    exact = windows.join(models.withColumn("w", F.col("model")), "w").where(allowed).groupBy("name", "i", "n").agg(F.count(F.lit(1)).alias("families"), F.min("make").alias("make"), F.min("model").alias("model")).where("families = 1")
    exact = exact.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("wide"), "i", "make", "model")).alias("e"))
    taken = trims.select(F.col("trim").alias("w")).unionByName(makes.select(F.col("make").alias("w"))).distinct()
    exact = durable(exact)
    open_ = windows.where(F.length("w") >= 4).join(exact, "name", "left_anti").join(taken, "w", "left_anti")
    wrong = open_.join(_spelt(open_, catalogue, "model"), "w").join(models.withColumn("name_", F.col("model")), "name_").where(allowed)
    wrong = wrong.groupBy("name").agg(F.min(F.struct((-F.round("cosine", 9)).alias("far"), (-F.col("n")).alias("wide"), "i", "make", "model")).alias("s"))
    j = names.join(exact, "name", "left").join(wrong, "name", "left")
    pick = lambda c: F.coalesce(F.col(f"e.{c}"), F.when(F.col("e").isNull(), F.col(f"s.{c}")))
    return j.where("e is not null or s is not null").select("name", "rest", pick("make").alias("make"), pick("model").alias("model"), pick("i").alias("at"), (-pick("wide")).alias("many")).select("name", "make", "model", _without(F.col("rest"), F.col("at"), F.col("many")).alias("left"))


def _with_trim(named: DataFrame, versions: DataFrame, trims: DataFrame, catalogue: tuple[DataFrame, int]) -> DataFrame:
    """(name, make, model, trim) of names with one trim: exact ones, two words before one, trims of other families counting as a conflict; if
    there is none, the family's own trim that a word misspells."""
    windows = _windows(named.select("name", "make", "model", "left"), F.col("left"), 2)
    hits = windows.join(trims.select(F.col("trim").alias("w")), "w").where("n = 1 or length(element_at(left, i)) > 1").select("name", "i", "n", "w")
    by = W.partitionBy("name").orderBy("i")
    double = hits.where("n = 2").withColumn("before", F.lag("i").over(by)).where("before is null or before < i - 1").select("name", "i", "w")
    covered = double.select("name", F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("i"))
    single = hits.where("n = 1").join(covered, ["name", "i"], "left_anti").select("name", "w")
    found = double.select("name", "w").unionByName(single).groupBy("name").agg(F.min("w").alias("trim"), F.max("w").alias("last"))
    own = versions.select("make", "model", F.col("trim").alias("name_")).distinct()
    found = durable(found)
    long = windows.where(F.length("w") >= 5).join(found, "name", "left_anti")
    best = long.join(_spelt(long, catalogue, "trim"), "w").groupBy("name", "make", "model", "i", "n").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "name_"))["name_"].alias("name_"))
    wrong = best.join(own, ["make", "model", "name_"]).groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("wide"), "i", "name_"))["name_"].alias("spelt"))
    j = named.join(found, "name", "left").join(wrong, "name", "left").where("trim is null or trim = last")
    return j.withColumn("trim", F.coalesce("trim", "spelt")).where("trim is not null").select("name", "make", "model", "trim")


def offered_versions(listings: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, version_id) of every listing whose make, model and trim together tell one version.

    Each different wording loses its numbers and drives, and each different name that is left is matched once: its stretches of words
    meet the catalogue's names where they are equal (a rare token) and otherwise by weighted cosine of their pieces
    (``near_names``). A name confirmed so belongs to the cluster of one family and trim; numbers, drives, engines and
    powers that conflict are vetoes, and what is left must be one version. Every step is a join or an aggregation over
    different names, so the catalogue may be of any size and listings of one wording are one row. Nulls are missing words;
    empty tables give no rows.
    """
    given = versions.where("version_id is not null and make is not null and model is not null")
    litres = F.replace(F.regexp_extract("engine", r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")
    drive = F.when(F.upper("drivetrain") == "AWD", 1).when(F.upper("drivetrain") == "FWD", 2).when(F.upper("drivetrain") == "RWD", 4).otherwise(0)
    v = given.select("version_id", bare(F.col("make")).alias("make"), bare(F.col("model")).alias("model"), F.coalesce(bare(F.col("trim")), F.lit("")).alias("trim"), drive.alias("v_drive"), F.coalesce(litres, F.lit(-1.0)).alias("v_litres"), F.coalesce(F.col("power_hp"), F.lit(0)).alias("v_power"))
    v = _sent(v)
    initials = F.array_join(F.regexp_extract_all(F.lower("make"), F.lit("([a-z0-9])[a-z0-9]*"), F.lit(1)), "")
    makes = given.select(bare(F.col("make")).alias("make"), initials.alias("initials")).groupBy("make").agg(F.min("initials").alias("initials"))
    makes = _sent(makes)
    models, trims = _sent(v.select("make", "model").distinct()), _sent(v.where("trim <> ''").select("trim").distinct())
    kinds = makes.select(F.col("make").alias("name"), F.lit("make").alias("kind")).unionByName(models.select(F.col("model").alias("name"), F.lit("model").alias("kind"))).unionByName(trims.select(F.col("trim").alias("name"), F.lit("trim").alias("kind")))
    pieces, total = name_pieces(kinds)
    catalogue = (_sent(pieces), total)
    said = durable(wordings(listings).withColumn("name", F.concat(F.array_join("words", " "), F.when(F.col("says_make"), F.lit("|")).otherwise(F.lit("")))))
    names = durable(said.groupBy("name").agg(F.first("words").alias("words"), F.first("says_make").alias("says_make")))
    made = durable(_with_makes(names, makes, models, catalogue).where("makes is not null or not says_make"))
    named = durable(_with_family(made, models, makes, trims, catalogue))
    trimmed = _with_trim(named, v, trims, catalogue)
    fit = (F.col("drives").isNull() | (F.col("drives").bitwiseAND(F.col("v_drive")) != 0)) & (F.col("litres").isNull() | (F.abs(F.col("v_litres") - F.col("litres")) < 0.05)) & (F.col("power").isNull() | (F.abs(F.col("v_power") - F.col("power")) <= 2.5))
    clusters = said.join(trimmed.select("name", F.col("make").alias("c_make"), F.col("model").alias("c_model"), F.col("trim").alias("c_trim")), "name")
    of = v.select(F.col("make").alias("c_make"), F.col("model").alias("c_model"), F.col("trim").alias("c_trim"), "version_id", "v_drive", "v_litres", "v_power")
    told = clusters.join(of, ["c_make", "c_model", "c_trim"]).where(fit).groupBy("make", "model", "trim").agg(F.min("version_id").alias("version_id"), F.max("version_id").alias("last")).where("version_id = last").drop("last")
    return joined(listings.select("id", "make", "model", "trim"), told)


def joined(listings: DataFrame, texts: DataFrame) -> DataFrame:
    """Listings with the version of their wording; equal nulls are equal words."""
    t = texts.select(*[F.col(c).alias(f"t_{c}") for c in ("make", "model", "trim")], "version_id")
    same = [listings[c].eqNullSafe(t[f"t_{c}"]) for c in ("make", "model", "trim")]
    return listings.where("id is not null").join(t, same[0] & same[1] & same[2]).select("id", "version_id").distinct()
