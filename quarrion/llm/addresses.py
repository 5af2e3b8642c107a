"""Address records of one location: component parsing, deletion-neighbourhood index, assignment with hard vetoes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarrion import session

#: Many joins of small tables: none of them is broadcast, since the driver keeps some megabytes of each.
durable = partial(session.durable, broadcast=False)

#: Street types and directions with their spellings, and words that lead into an address or a unit.
TYPES = {
    "avenue": "avenue ave av aven", "boulevard": "boulevard blvd boul blv", "circle": "circle cir circ crcl", "court": "court ct crt", "drive": "drive dr drv", "lane": "lane ln", "parkway": "parkway pkwy pky pkway",
    "road": "road rd", "street": "street st str", "terrace": "terrace ter terr", "place": "place pl", "trail": "trail trl", "way": "way wy", "loop": "loop lp", "square": "square sq", "plaza": "plaza plz", "highway": "highway hwy", "expressway": "expressway expy", "freeway": "freeway fwy",
}
DIRECTIONS = {"n": "n north no", "s": "s south so", "e": "e east", "w": "w west"}
_TYPE = {s: t for t, all_of in TYPES.items() for s in all_of.split()}
_SIDE = {s: d for d, all_of in DIRECTIONS.items() for s in all_of.split()}
_LEAD = re.compile(r"^\s*(?:c/o [^,]*,|attn:? [^,]*,|located at|corner lot at|near|at)\s*", re.I)
_UNIT = re.compile(r"\(?(?:#|\b(?:suite|ste|unit|bldg|building|apt|room|rm)\b\.?)\s*#?\s*([a-z]?\d+[a-z]?)\)?", re.I)
_STATE_ZIP = re.compile(r"[,\s]+[a-z]{2}\.?[,\s]+\d{5}(?:-\d{4})?\s*$", re.I)
_ROADS = [
    ("fm", re.compile(r"\b(?:f\.?\s*m\.?|farm[\s-]*to[\s-]*market)[\s-]*(?:road|rd)?\.?[\s-]*(\d+)\b")),
    ("us", re.compile(r"\b(?:(?:highway|hwy)[\s-]*)?u\.?\s*s\.?[\s-]*(?:highway|hwy)?\.?[\s-]*(\d+)\b")),
    ("ih", re.compile(r"\b(?:interstate|ih|i)[\s-]*(?:highway|hwy)?\.?[\s-]*(\d+)\b")),
    ("sh", re.compile(r"\b(?:(?:state|st)\.?[\s-]*(?:highway|hwy|route|road|rd)|sh|sr|tx|fl|highway|hwy)\.?[\s-]*(\d+)\b")),
]


def distance(a: str, b: str) -> int:
    """Edits between two words; two neighbouring letters exchanged count once."""
    n, m = len(a), len(b)
    two, one = [], list(range(m + 1))
    for i in range(1, n + 1):
        row = [i] + [0] * m
        for j in range(1, m + 1):
            row[j] = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], two[j - 2] + 1)
        two, one = one, row
    return one[m]


def parse(address: str | None, cities: tuple[str | None, ...] = ()) -> dict | None:
    """Number, street (letters without blanks, or a kind of road with its number), its ``words`` in alphabetical order, type, side and unit of an address.

    Missing parts are ''. Anything without a number or a street gives None. Components are told by what they are, not
    by where they stand; the record's own city, a state and a postcode at the end are dropped.
    """
    if not address:
        return None
    s = _STATE_ZIP.sub("", _LEAD.sub("", " ".join(address.lower().split()))).strip(" ,.")
    unit = _UNIT.search(s)
    if unit:
        s = s[: unit.start()] + " , " + s[unit.end() :]
    s = re.sub(r"[,\s]+$", "", s)
    for c in cities:
        if c and len(s) > len(c) and s.endswith(c.lower()) and not s[-len(c) - 1].isalnum():
            s = s[: -len(c)].rstrip(" ,")
            break
    street = kind = ""
    for road, pattern in _ROADS:
        m = pattern.search(s)
        if m and re.search(r"\d", s[: m.start()] + s[m.end() :]):
            street, kind, s = road + m[1], "numbered", s[: m.start()] + " , " + s[m.end() :]
            break
    parts = [[t.strip(".-'\"") for t in p.split()] for p in s.split(",")]
    number = next((t for p in parts for t in p if t.isdigit()), "")
    side, words, done = "", [], False
    for p in parts:
        p = [t for t in p if t and not t.isdigit()]
        if done and any(t not in _SIDE for t in p):
            continue  # a part after the street that is no direction: a locality
        for k, t in enumerate(p):
            if t in _SIDE and not (words and not done and k + 1 < len(p) and p[k + 1] in _TYPE):
                side = side or _SIDE[t]
            elif not done and not (kind == "numbered"):
                near = t if t in _TYPE else next((x for x in TYPES if len(t) > 4 and t[0] == x[0] and distance(t, x) == 1), None)
                if words and near:
                    kind, done = _TYPE[near], True
                else:
                    words.append(re.sub(r"[^a-z0-9]", "", t))
        done = done or bool(words)
    in_order = " ".join(sorted(w for w in words if w)) if not street else street
    street = street or "".join(words)
    if not number or not street:
        return None
    return {"number": str(int(number)), "street": street, "words": in_order, "kind": kind, "side": side, "unit": str(unit[1]).lstrip("0") if unit else ""}


def deletions(word: Column, letters: int = 1) -> Column:
    """The word and what is left of it without so many letters: words as many edits or exchanges apart have one in common.

    Roads with a number have themselves alone, since another number is another road.
    """
    forms = F.array(word)
    for _ in range(letters):
        less = F.flatten(F.transform(forms, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
        forms = F.array_distinct(F.concat(forms, less))
    return F.when(word.rlike("[0-9]"), F.array(word)).otherwise(forms)


def assigned(a: str, b: str) -> int:
    """Edits between two streets, words in alphabetical order, under the best assignment of their words to each other.

    As many words on both sides are assigned in every order up to four words, more in their alphabetical order; a
    different number of words is one word split, so the letters are compared as they stand.
    """
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y) or len(x) > 4:
        return distance("".join(x), "".join(y))
    return min(sum(distance(v, w) for v, w in zip(x, o)) for o in permutations(y))


def parts_agree(a: dict, b: dict) -> bool:
    """Whether two parsed addresses can be the same street: the best assignment of their components leaves no conflict.

    Numbers and units that differ are a veto, a missing unit is not. A type or side that one lacks costs nothing,
    two different ones are a veto.
    """
    if a["number"] != b["number"] or (a["unit"] and b["unit"] and a["unit"] != b["unit"]):
        return False
    if any(a[p] and b[p] and a[p] != b[p] for p in ("kind", "side")):
        return False
    cost = min(distance(a["street"], b["street"]), assigned(a["words"], b["words"]))
    return cost <= (0 if any(c.isdigit() for c in a["street"] + b["street"]) else 1 + (min(len(a["street"]), len(b["street"])) >= 9))


def locality(records: DataFrame, zips: DataFrame) -> DataFrame:
    """Adds ``place`` (city and state as in ``zips``): by the five-digit postcode, else by the city's name, one edit allowed;
    and ``beside``, the place of the city's name where it is another one than the postcode's.

    A city name that matches nothing is a place of its own; without either the place is null. ``zips`` has a row per
    postcode; Spark's own threshold decides on its broadcast.
    """
    five = F.regexp_extract(F.coalesce("zip", F.lit("")), r"^\s*(\d{5})", 1)
    letters = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")
    by_zip = zips.groupBy(F.col("zip").alias("zip5")).agg(F.min(F.concat(letters(F.col("city")), F.lit("|"), F.upper("state"))).alias("by_zip"), F.min("city").alias("zip_city"))
    left = lambda w: F.array_distinct(F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))
    known = zips.select(letters(F.col("city")).alias("name"), F.upper("state").alias("st")).where("name <> ''").distinct()
    spelt = known.select("st", "name", F.explode(left(F.col("name"))).alias("form"))
    asked = records.select(letters(F.col("city")).alias("said"), F.upper("state").alias("st")).where("said <> ''").distinct()
    best = asked.select("said", "st", F.explode(left(F.col("said"))).alias("form")).join(spelt, ["st", "form"]).groupBy("said", "st").agg(F.min(F.struct(F.levenshtein("said", "name").alias("d"), "name")).alias("b")).select("said", "st", F.concat("b.name", F.lit("|"), "st").alias("by_name"))
    out = records.withColumns({"zip5": five, "said": letters(F.col("city")), "st": F.upper("state")}).join(by_zip, "zip5", "left").join(best, ["said", "st"], "left")
    own = F.when(F.col("said") != "", F.concat("said", F.lit("|"), F.coalesce("st", F.lit(""))))
    return out.withColumn("place", F.coalesce("by_zip", "by_name", own)).withColumn("beside", F.when(F.col("by_name") != F.col("by_zip"), F.col("by_name"))).drop("said", "st", "zip5")


PARTS = ("number", "street", "words", "kind", "side", "unit")
PARSED = ", ".join(f"{p} string" for p in PARTS)
#: Degrees, either way, within which the places of a record's postcode and of its city are neighbours.
NEIGHBOURS = 0.5


def parsed(records: DataFrame) -> DataFrame:
    """(key, place, beside, and PARTS) of the records (key, place, beside, address, city, zip_city) with a usable address."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, p, n, parse(a, (c, z))) for k, p, n, a, c, z in zip(*(b.column(i).to_pylist() for i in range(6)))]
            rows = [x for x in rows if x[3]]
            cols = [*([x[i] for x in rows] for i in range(3)), *([x[3][f] for x in rows] for f in PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["key", "place", "beside", *PARTS])

    return records.select("key", "place", "beside", "address", "city", "zip_city").mapInArrow(read, f"key string, place string, beside string, {PARSED}")


def neighbouring(zips: DataFrame) -> DataFrame:
    """(place, beside) of every two places with postcodes within NEIGHBOURS degrees of each other, met on a grid of that size."""
    letters = F.regexp_replace(F.lower(F.coalesce("city", F.lit(""))), "[^a-z]", "")
    at = zips.where("lat is not null and lng is not null").select(F.concat(letters, F.lit("|"), F.upper("state")).alias("p"), "lat", "lng")
    cell = lambda i, j: F.struct((F.floor(F.col("lat") / NEIGHBOURS) + i).alias("x"), (F.floor(F.col("lng") / NEIGHBOURS) + j).alias("y"))
    a = at.select(F.col("p").alias("place"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), cell(0, 0).alias("cell"))
    b = at.select(F.col("p").alias("beside"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.explode(F.array(*[cell(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("cell"))
    near = (F.abs(F.col("lat1") - F.col("lat2")) <= NEIGHBOURS) & (F.abs(F.col("lng1") - F.col("lng2")) <= NEIGHBOURS)
    return a.join(b, "cell").where(near & (F.col("place") != F.col("beside"))).select("place", "beside").distinct()


def _placed(rows: DataFrame, zips: DataFrame) -> DataFrame:
    """Rows without ``beside``: a record whose postcode and city name two neighbouring places lies in the city's if
    only there another record has its number and street, one letter apart allowed; otherwise in the postcode's."""
    form = lambda df, at: df.select("key", F.col(at).alias("at"), "number", F.explode(deletions(F.col("street"))).alias("form"))
    doubtful = durable(rows.where("beside is not null").join(neighbouring(zips), ["place", "beside"], "left_semi"))
    known = rows.where("beside is null").join(doubtful.select("number").distinct(), "number", "left_semi")
    known = durable(form(known, "place").select("at", "number", "form").distinct())
    at = lambda c: form(doubtful, c).join(known, ["at", "number", "form"], "left_semi").select("key").distinct()
    moved = at("beside").join(at("place"), "key", "left_anti").withColumn("moves", F.lit(True))
    return rows.join(moved, "key", "left").withColumn("place", F.when(F.col("moves"), F.col("beside")).otherwise(F.col("place"))).drop("beside", "moves")


def _settled(rows: DataFrame, at: list[str], part: str) -> DataFrame:
    """Fills a missing ``part`` ('') with the only one known at ``at``; with several or none known it stays ''.

    Known parts are counted by aggregation; an address that very many records have is one row there.
    """
    known = rows.where(F.col(part) != "").groupBy(*at).agg(F.min(part).alias("low"), F.max(part).alias("high")).where("low = high").select(*at, F.col("low").alias("only"))
    return rows.join(known, at, "left").withColumn(part, F.when(F.col(part) == "", F.coalesce("only", F.lit(""))).otherwise(F.col(part))).drop("only")


def _named(nodes: DataFrame, letters: int, apart: int) -> DataFrame:
    """(place, number, street, name): each street's best neighbour in the index of deletions, taken twice.

    The index holds a street's letters as written and, of several words, in their alphabetical order; a number with one street needs none. Different streets of one place and number that share a
    form meet, all of them, and are neighbours if their letters are ``apart`` or fewer edits from each other, as written or under the best
    assignment of their words; each different pair of spellings is assigned once.
    """
    rank = F.struct("everywhere", "here", "street").alias("rank")
    both = F.array_distinct(F.concat(deletions(F.col("street"), letters), F.transform(deletions(F.replace("words", F.lit(" "), F.lit("")), letters), lambda f: F.concat(F.lit("~"), f))))
    several = nodes.groupBy("place", "number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("place", "number")
    index = durable(nodes.join(several, ["place", "number"], "left_semi").select("place", "number", "street", "words", rank, F.explode(F.when(F.contains("words", F.lit(" ")), both).otherwise(deletions(F.col("street"), letters))).alias("form")))
    other = index.select("place", "number", "form", F.col("rank").alias("rank_b"), F.col("words").alias("words_b"))
    met = index.join(other, ["place", "number", "form"]).where("rank.street <> rank_b.street").select("place", "number", "street", "words", "rank_b", "words_b").distinct()
    met = durable(met.withColumn("edits", F.levenshtein("street", "rank_b.street")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = [assigned(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost, pa.int32())], names=["words", "words_b", "cost"])

    costs = met.where(F.col("edits") > apart).select("words", "words_b").distinct().mapInArrow(assign, "words string, words_b string, cost int")
    near = met.join(costs, ["words", "words_b"], "left").where((F.col("edits") <= apart) | (F.col("cost") <= apart)).select("place", "number", "street", F.col("rank_b").alias("rank"))
    own = nodes.select("place", "number", "street", rank)
    to = durable(near.unionByName(own).groupBy("place", "number", "street").agg(F.max("rank").alias("rank")).select("place", "number", "street", F.col("rank.street").alias("name")))
    again = to.select("place", "number", F.col("street").alias("name"), F.col("name").alias("name2"))
    return to.join(again, ["place", "number", "name"], "left").select("place", "number", "street", F.coalesce("name2", "name").alias("name"))


def _streets(rows: DataFrame) -> DataFrame:
    """(place, number, street, name): for every street as written at a number the street it means.

    Streets of one place and number are neighbours if they share a form with one letter deleted; a street takes the
    name of the neighbour, itself included, that most records of the corpus write. Where several names are left
    at a number, the names are compared once more with two letters deleted, for records that both hold an error.
    """
    counts = rows.groupBy("street").agg(F.count(F.lit(1)).alias("everywhere"))
    nodes = durable(rows.groupBy("place", "number", "street").agg(F.count(F.lit(1)).alias("here"), F.min("words").alias("words")).join(counts, "street"))
    first = durable(_named(nodes, 1, 2))
    several = first.groupBy("place", "number").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("place", "number")
    left = nodes.join(first.select("place", "number", F.col("name").alias("street")).distinct(), ["place", "number", "street"], "left_semi").join(several, ["place", "number"], "left_semi")
    left = durable(left)
    second = _named(left.where(F.length("street") >= 7), 2, 3).select("place", "number", F.col("name").alias("last"), F.col("street").alias("name"))
    return first.join(second, ["place", "number", "name"], "left").select("place", "number", "street", F.coalesce("last", "name").alias("name"))


def locations(records: DataFrame, zips: DataFrame) -> DataFrame:
    """(key, place, number, name, kind, side, unit) of records (key, address, city, state, zip): equal rows but for the key are one location.

    A type, side or unit that a record lacks is the only one known at its street and number; where several are known
    it stays open, a location of its own. Records without a usable address are left out.
    """
    rows = durable(parsed(locality(records, zips)).where("place is not null").distinct())
    rows = durable(_placed(rows, zips))
    rows = durable(rows.join(_streets(rows), ["place", "number", "street"]).drop("street", "words"))
    at = ["place", "number", "name"]
    rows = durable(_settled(_settled(rows, [*at, "side"], "kind"), [*at, "kind"], "side"))
    rows = _settled(_settled(rows, at, "kind"), [*at, "kind"], "side")
    return durable(_settled(rows, [*at, "kind", "side"], "unit"))


def keyed(table_name: str, df: DataFrame) -> DataFrame:
    """(key, address, city, state, zip) of a table, exact repeats once."""
    cols = [F.col(c).cast("string").alias(c) for c in ("address", "city", "state", "zip")]
    return df.where("id is not null").select(F.concat(F.lit(f"{table_name}:"), F.col("id").cast("string")).alias("key"), *cols).distinct()


def same_location(tables: dict[str, DataFrame], zips: DataFrame) -> DataFrame:
    """(key_a, key_b): every two records at one location, each pair once, the key that sorts first as key_a.

    Every pair of a location is what is asked for, so the result itself grows with the square of a location's records;
    the join's skew is left to adaptive splitting.
    """
    records = None
    for name, df in tables.items():
        records = keyed(name, df) if records is None else records.unionByName(keyed(name, df))
    where = ["place", "number", "name", "kind", "side", "unit"]
    found = locations(records, zips).select(F.struct(*where).alias("at"), "key").distinct()
    a, b = found.select("at", F.col("key").alias("key_a")), found.select("at", F.col("key").alias("key_b"))
    return a.join(b, "at").where("key_a < key_b").select("key_a", "key_b").distinct()
