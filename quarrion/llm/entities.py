"""Records of one dealership across sources without keys: q-gram bit vectors, multi-index Hamming search, weighted Dice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarrion.llm.addresses import distance, durable, locality, parse

#: A vector has BLOCKS words of WIDTH bits; two vectors at most RADIUS = BLOCKS - 2 bits apart agree in two whole words. A word of
#: at most SPARSE bits says too little to be a key alone.
BLOCKS, WIDTH, RADIUS, SPARSE = 8, 16, 6, 1
#: Words of a company's form or greeting, which say nothing about which dealership it is.
FORM = frozenset("llc l.l.c inc lp ltd co corp company corporation the of at welcome to and in".split())
#: Words of the trade; a name without them is still the same name.
TRADE = frozenset("auto autos automotive automobile car cars truck trucks motor motors mtrs used preowned pre owned sales mart plaza center centre group imports wholesale dealership vehicles".split())
#: Weights of the evidence, as the logarithm of how much more likely it is among records of one dealership.
WEIGHTS = {"phone": 6.0, "no_phone": -3.0, "page": 5.0, "host": 2.5, "other_branch": -6.0, "other_host": -2.0, "address": 3.0, "other_address": -1.5, "name": 3.5, "near_name": 2.0, "other_name": -3.0, "legal_name": -0.5, "far_name": -1.5, "nothing_against": 1.5}
#: Confidence from which two records are one dealership.
SURE = 0.8
#: Evidence without the phone at which the weights alone give even odds, and labelled cases that these odds count for.
EVEN, PRIOR = 2.5, 4.0
#: Nearest places of a record without a stated one in which a name has its full weight; farther off only beside a phone, page or address.
NAMED = 3


@lru_cache(100_000)
def _of_trade(word: str) -> bool:
    """Whether a word is one of the trade, one error allowed in five letters and two in nine."""
    return word in TRADE or any(len(t) > 4 and abs(len(t) - len(word)) <= 1 and t[0] == word[0] and distance(word, t) <= (1 if len(t) < 9 else 2) for t in TRADE)


def name_parts(name: str | None, places: list[str]) -> tuple[str, str]:
    """(core, trade) of a name: sorted words without greeting, company form and place, and those of the trade."""
    s = (name or "").lower().split("|")[0]
    s = re.sub(r"l\.\s?l\.\s?c\.?", " ", s).replace("pre-owned", "preowned")
    words = re.findall(r"[a-z0-9]+", s)
    words = [w for w in words if w not in FORM]
    while len(words) > 2 and any(distance(words[-1], p) <= (len(p) > 5) for p in places):
        words.pop()
    core, trade = [w for w in words if not _of_trade(w)], [w for w in words if _of_trade(w)]
    return (" ".join(sorted(core or trade)), " ".join(sorted(trade)) if core else "")


def trade_letters(trade: str, page: str, core: str, cities: list[str]) -> str:
    """The letters of the trade's words in order of the alphabet; where a name has none, what the site's name adds to it."""
    if not trade and page:
        rest = re.sub(r"[^a-z]", "", page.split("/")[0].rsplit(".", 1)[0])
        for w in [*core.split(" "), *cities]:
            rest = rest.replace(w, "", 1)
        trade = rest if len(rest) <= 16 and any(t in rest for t in TRADE if len(t) > 3) else ""
    return "".join(sorted(trade.replace(" ", "")))


def page_of(website: str | None, email: str | None) -> str:
    """Host (without www) and path of a website, or an email's host; '' if there is none."""
    w = (website or "").strip().lower()
    if "." in w:
        w = re.sub(r"^(?:https?:)?/*(?:www\.)?", "", w)
        return re.sub(r"/+$", "", w.split("#")[0].split("?")[0])
    e = (email or "").strip().lower()
    return e.split("@", 1)[1] if "@" in e and "." in e else ""


def vector(text: str, grams: int = 2) -> tuple[int, int]:
    """The bits of a text's q-grams as two signed 64-bit words; each q-gram sets one of 128 bits."""
    import xxhash

    bits, t = 0, f"^{text}$"
    for i in range(len(t) - grams + 1):
        bits |= 1 << (xxhash.xxh64_intdigest(t[i : i + grams], 5) & 127)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits & (1 << 64) - 1), signed(bits >> 64)


def records(tables: dict[str, DataFrame], osm: DataFrame, zips: DataFrame) -> DataFrame:
    """(key, source, name, dba, address, city, state, zip, phone, website, email, near) of the sources, exact repeats once.

    ``near``: for a map element without postcode the places of the postcodes within half a degree, nearest first; the
    fixed table of postcodes bounds them. ``zips`` has a row per postcode and is joined on a grid of half degrees.
    """
    text = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    columns = ("name", "dba", "address", "city", "state", "zip", "phone", "website", "email")
    out = None
    for n, df in tables.items():
        part = df.where("id is not null").select(F.concat(F.lit(f"{n}:"), F.col("id").cast("string")).alias("key"), F.lit(n).alias("source"), *[text(df, c) for c in columns], F.lit(None).cast("array<string>").alias("near"))
        out = part if out is None else out.unionByName(part)
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("tags")[x]), F.lit("")) for x in names])
    unit = F.when(tag("addr:unit").isNotNull(), F.concat(F.lit(", Unit "), tag("addr:unit"))).otherwise("")
    flat = osm.where("id is not null and tags is not null").select(
        F.concat(F.lit("osm_sample:"), F.col("id").cast("string")).alias("key"), F.lit("osm_sample").alias("source"), tag("name", "operator", "brand").alias("name"), F.lit(None).cast("string").alias("dba"), F.concat(tag("addr:housenumber"), F.lit(" "), tag("addr:street"), unit).alias("address"),
        tag("addr:city").alias("city"), F.lit(None).cast("string").alias("state"), tag("addr:postcode").alias("zip"), tag("phone", "contact:phone").alias("phone"), tag("website", "contact:website", "url").alias("website"), F.lit(None).cast("string").alias("email"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
    )
    cell = lambda lat, lon, d, e: (F.floor(lat * 2) + d) * 1000 + F.floor(lon * 2) + e
    grid = zips.where("lat is not null and lng is not null").select(F.col("lat").alias("zlat"), F.col("lng").alias("zlng"), F.concat(F.lower(F.regexp_replace("city", "[^A-Za-z]", "")), F.lit("|"), F.upper("state")).alias("zplace"), F.explode(F.array(*[cell(F.col("lat"), F.col("lng"), d, e) for d in (-1, 0, 1) for e in (-1, 0, 1)])).alias("cell"))
    far = F.pow(F.col("lat") - F.col("zlat"), 2) + F.pow((F.col("lon") - F.col("zlng")) * F.cos(F.radians("lat")), 2)
    near = flat.where("zip is null and lat is not null and lon is not null").select("key", "lat", "lon", cell(F.col("lat"), F.col("lon"), 0, 0).alias("cell")).join(grid, "cell").groupBy("key", "zplace").agg(F.min(far).alias("far")).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("far", "zplace"))), lambda x: x["zplace"]).alias("near"))
    return out.unionByName(flat.drop("lat", "lon").join(near, "key", "left")).distinct()


_FIELDS = "key string, source string, places array<string>, core string, core2 string, trade string, legal boolean, page string, phone string, number string, street string, kind string, side string, unit string, n1 long, n2 long, m1 long, m2 long, a1 long, a2 long"


def encoded(rows: DataFrame, zips: DataFrame) -> DataFrame:
    """Normalised fields and bit vectors of records: n and m of the name and the trade name, a of the address."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                # a city without a state is each near one of that name; without either, all near places are looked at
                near = r["near"] or []
                said = (r["place"] or "").split("|")[0] if r["city"] or r["zip"] else ""
                whole = said and not r["place"].endswith("|")
                places = [r["place"]] if whole else [p for p in near if said and distance(said, p.split("|")[0]) <= 1] or near or ([r["place"]] if r["place"] else [])
                cities = [p.split("|")[0] for p in places]
                core, trade = name_parts(r["name"], cities)
                core2, trade2 = name_parts(r["dba"], cities) if r["dba"] and r["dba"].strip() else ("", "")
                phone = re.sub(r"\D", "", r["phone"] or "")[-10:]
                phone = phone if len(phone) == 10 and len(set(phone)) > 2 else ""
                a = parse(r["address"], (r["city"], r["zip_city"])) or dict.fromkeys(("number", "street", "kind", "side", "unit"), "")
                n, m = vector(core) if core else (0, 0), vector(core2) if core2 else (0, 0)
                v = vector(f"{a['number']} {a['street']}") if a["number"] else (0, 0)
                legal = r["source"] == "state_registry" and not core2
                page = page_of(r["website"], r["email"])
                letters = trade_letters(trade2 or trade, page, core2 or core, cities)
                out.append((r["key"], r["source"], places, core, core2, letters, legal, page, phone, *(a[k] for k in ("number", "street", "kind", "side", "unit")), *n, *m, *v))
            cols = list(zip(*out)) or [()] * 20
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 3, pa.bool_(), *[pa.string()] * 7, *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _FIELDS.split(", ")])

    return locality(rows, zips).select("key", "source", "name", "dba", "address", "city", "zip", "phone", "website", "email", "near", "place", "zip_city").mapInArrow(read, _FIELDS)


def _words(a: Column, b: Column) -> list[Column]:
    """The BLOCKS words of a vector."""
    return [F.shiftright(x, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1)) for x in (a, b) for i in range(BLOCKS // 2)]


def close_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) keys of records of different sources at one place with a view (name, trade name, address, phone, page) at most
    RADIUS bits apart, all of them.

    Multi-index Hamming search: every view's vector is entered under the hash of place, view and a key, a key being each word of more
    than SPARSE bits and each two of the others together; by the pigeonhole principle two words of such a pair agree, so
    none is missed (most that are one bit farther apart are met as well and kept), and no key is an empty word that a third of a place's records would share. A record without a stated place
    is entered with every view in all of its places; what a name is worth in a far one is decided by its weight. Pairs that meet are held against the bound
    inside the join. A frequent word is a skewed key of that join, which adaptive execution splits.
    """
    exact = lambda c: F.struct(F.xxhash64(c).alias("x"), F.xxhash64(F.lit(1), c).alias("y"))
    views = [
        ("name", F.col("core") != "", F.struct(F.col("n1").alias("x"), F.col("n2").alias("y"))), ("name", F.col("core2") != "", F.struct(F.col("m1").alias("x"), F.col("m2").alias("y"))),
        ("address", F.col("number") != "", F.struct(F.col("a1").alias("x"), F.col("a2").alias("y"))), ("phone", F.col("phone") != "", exact("phone")), ("page", F.col("page") != "", exact("page")),
    ]
    each = F.array_compact(F.array(*[F.when(there, F.struct(F.lit(n).alias("view"), v.alias("v"))) for n, there, v in views]))
    flat = rows.select("key", "source", F.explode("places").alias("place"), each.alias("views")).select("key", "source", "place", F.explode("views").alias("view")).select("key", "source", "place", "view.view", "view.v.x", "view.v.y")
    words = F.transform(F.array(*_words(F.col("x"), F.col("y"))), lambda w, i: F.struct(i.alias("i"), w.alias("w"), (F.bit_count(w) > SPARSE).alias("full")))
    full, rest = F.filter("words", lambda w: w["full"]), F.filter("words", lambda w: ~w["full"])
    alone = F.transform(full, lambda w: F.xxhash64(w["i"], w["w"]))
    twos = F.flatten(F.transform(rest, lambda w: F.transform(F.filter(rest, lambda v: v["i"] > w["i"]), lambda v: F.xxhash64(w["i"], w["w"], v["i"], v["w"]))))
    # an exact view is one key
    keys = F.when(F.col("view").isin("name", "address"), F.concat(alone, twos)).otherwise(F.array(F.xxhash64("x", "y")))
    index = flat.withColumn("words", words).select("place", "view", "key", "source", "x", "y", F.explode(keys).alias("k")).select(F.xxhash64("place", "view", "k").alias("h"), "key", "source", "x", "y")
    a, b = index.select("h", *[F.col(c).alias(f"{c}_a") for c in ("key", "source", "x", "y")]), index.select("h", *[F.col(c).alias(f"{c}_b") for c in ("key", "source", "x", "y")])
    apart = F.bit_count(F.col("x_a").bitwiseXOR(F.col("x_b"))) + F.bit_count(F.col("y_a").bitwiseXOR(F.col("y_b")))
    return a.join(b, "h").where((F.col("key_a") < F.col("key_b")) & (F.col("source_a") != F.col("source_b")) & (apart <= RADIUS + 1)).select("key_a", "key_b").distinct()


def _dice(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Dice coefficient of two bit vectors; null if either is empty."""
    both = F.bit_count(a1.bitwiseAND(b1)) + F.bit_count(a2.bitwiseAND(b2))
    total = F.bit_count(a1) + F.bit_count(a2) + F.bit_count(b1) + F.bit_count(b2)
    return F.when((a1.bitwiseOR(a2) != 0) & (b1.bitwiseOR(b2) != 0), 2.0 * both / total)


def scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs with ``rest`` (weighted evidence without the phone), ``phone`` (1 equal, 0 unknown, -1 different), ``far`` (nothing but a name
    in a place that is not among the nearest NAMED) and ``score``."""
    cols = [c for c in rows.columns if c not in ("places",)]
    side = lambda s: rows.select(*[F.col(c).alias(f"{c}_{s}") for c in cols], F.slice("places", 1, NAMED).alias(f"nearest_{s}"))
    j = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    A, B = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    zero = F.lit(0.0)
    name = F.greatest(*[_dice(A(f"{p}1"), A(f"{p}2"), B(f"{q}1"), B(f"{q}2")) for p in "nm" for q in "nm"])
    trades = (A("trade") == "") | (B("trade") == "") | (A("trade") == B("trade")) | (F.levenshtein(A("trade"), B("trade")) <= 2)
    name_w = F.when(name.isNull(), zero).when((name >= 0.8) & trades, w["name"]).when(name >= 0.55, w["near_name"]).when((name < 0.4) & (A("legal") | B("legal")), w["legal_name"]).when(name < 0.4, w["other_name"]).otherwise(zero)
    host = lambda c: F.substring_index(c, "/", 1)
    path = lambda c: F.contains(c, F.lit("/"))
    pages = (A("page") != "") & (B("page") != "")
    page_w = F.when(~pages, zero).when(A("page") == B("page"), F.when(path(A("page")), w["page"]).otherwise(w["page"] - 1)).when((host(A("page")) == host(B("page"))) & path(A("page")) & path(B("page")), w["other_branch"]).when(host(A("page")) == host(B("page")), w["host"]).otherwise(w["other_host"])
    placed = (A("number") != "") & (B("number") != "")
    agree = lambda c: (A(c) == "") | (B(c) == "") | (A(c) == B(c))
    same = (A("number") == B("number")) & (F.levenshtein(A("street"), B("street")) <= 3) & agree("kind") & agree("side") & agree("unit")
    address_w = F.when(~placed, zero).when(same, w["address"]).otherwise(w["other_address"])
    phone = F.when((A("phone") == "") | (B("phone") == ""), 0).when(A("phone") == B("phone"), 1).otherwise(-1)
    j = j.withColumns({"name_w": name_w, "page_w": page_w, "address_w": address_w, "phone": phone})
    j = j.withColumn("far", ~F.arrays_overlap("nearest_a", "nearest_b") & (F.col("name_w") > 0) & (F.col("page_w") <= 0) & (F.col("address_w") <= 0) & (F.col("phone") < 1))
    alone = F.when(F.col("far"), w["far_name"]).when((F.col("name_w") == WEIGHTS["name"]) & (F.col("page_w") >= 0) & (F.col("address_w") >= 0) & (F.col("phone") >= 0), w["nothing_against"]).otherwise(zero)
    rest = F.col("name_w") + F.col("page_w") + F.col("address_w") + alone
    j = j.withColumn("rest", rest)
    phone_w = F.when(F.col("phone") == 1, w["phone"]).when(F.col("phone") == -1, w["no_phone"]).otherwise(zero)
    return j.select("key_a", "key_b", "rest", "phone", "name_w", "page_w", "address_w", "far", (F.col("rest") + phone_w).alias("score"))


def matched(tables: dict[str, DataFrame], osm: DataFrame, zips: DataFrame) -> DataFrame:
    """(key_a, key_b, confidence) of every two records of different sources that may describe one dealership; from SURE on they do.

    Confidences are calibrated on the data's own labels: among candidates with two phones the share of equal ones at each
    value of the other evidence (in steps of a half) is the chance that evidence gives, smoothed by PRIOR cases with the odds that the weights
    themselves give, and made to rise with the evidence; an equal or different phone multiplies the odds by its weight.
    Names in far places are candidates of less evidence but no labels, since one with an equal phone is not far.
    Null or unusable fields are no evidence; records without any place are left out; empty tables give no rows.
    """
    rows = durable(encoded(records(tables, osm, zips), zips))
    pairs = durable(scored(durable(close_pairs(rows)), rows))
    step = F.greatest(F.lit(-8.0), F.least(F.lit(13.0), F.round(F.col("rest") * 2) / 2))
    own = 1 / (1 + F.exp(F.lit(EVEN) - F.col("step")))
    known = pairs.groupBy(step.alias("step")).agg(F.count_if(F.col("phone") == 1).alias("same"), F.count_if((F.col("phone") != 0) & ~F.col("far")).alias("n"))
    chance = known.withColumn("p", (F.col("same") + PRIOR * own) / (F.col("n") + PRIOR))
    # at most 43 steps, whatever the data: between the greatest chance of lesser evidence and the least of greater
    other = chance.select(F.col("step").alias("s2"), F.col("p").alias("p2"))
    below = chance.join(other, F.col("s2") <= F.col("step")).groupBy("step").agg(F.max("p2").alias("low"))
    above = chance.join(other, F.col("s2") >= F.col("step")).groupBy("step").agg(F.min("p2").alias("high"))
    rising = below.join(above, "step").select("step", ((F.col("low") + F.col("high")) / 2).alias("p"))
    out = pairs.withColumn("step", step).join(rising, "step")
    odds = F.col("p") / (1 - F.col("p")) * F.exp(F.when(F.col("phone") == 1, WEIGHTS["phone"]).when(F.col("phone") == -1, WEIGHTS["no_phone"]).otherwise(0.0))
    return out.select("key_a", "key_b", F.round(odds / (1 + odds), 4).alias("confidence"), "score", "name_w", "page_w", "address_w", "phone")
