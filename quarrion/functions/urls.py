"""Column functions on page addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query parameters that say where a click came from, never which page is meant.
TRACKING = r"^(utm_[a-z]+|ref|src|gclid|fbclid)(=.*)?$"


def page_key(url: Column) -> Column:
    """Host and path of a page, the same for every spelling of its address.

    Scheme, ``www.``, letter case of the host, a trailing slash, the fragment and tracking parameters do not
    count; other query parameters do. Null and blank addresses give null.
    """
    bare = F.regexp_replace(F.substring_index(F.trim(url), "#", 1), r"(?i)^\s*(https?:)?//(www\.)?", "")
    path = F.substring_index(bare, "?", 1)
    host = F.lower(F.substring_index(path, "/", 1))
    rest = F.regexp_replace(F.substring(path, F.length(host) + 1, F.length(path)), "/+$", "")
    query = F.when(
        F.contains(bare, F.lit("?")),
        F.array_join(F.filter(F.split(F.substring(bare, F.length(path) + 2, F.length(bare)), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&"),
    )
    key = F.concat(host, rest, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.nullif(key, F.lit(""))


def has_www(url: Column) -> Column:
    return url.rlike(r"(?i)^\s*(https?:)?//www\.")


#: Makes of two words, drives and bodies as they stand in slugs, and the range of years.
TWO_WORDS = ("land rover", "alfa romeo", "aston martin", "mercedes benz", "rolls royce")
SLUG_DRIVES = ("awd", "fwd", "rwd", "4wd", "2wd", "4x4", "4x2")
BODIES = ("sport utility", "4dr car", "2dr car", "3dr car", "5dr car", "4dr suv", "crew cab", "extended cab", "quad cab", "mega cab", "regular cab", "double cab", "king cab", "access cab", "passenger van", "cargo van", "convertible", "coupe", "sedan", "hatchback", "wagon", "pickup", "minivan", "van", "suv", "car")
YEARS = (1950, 2039)


def _cased(word: Column) -> Column:
    return F.when((F.length(word) <= 3) | word.rlike("[0-9]"), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000)))


def slug_parts(url: Column) -> Column:
    """(year, make, model) of a detail page's slug such as ``used-2019-honda-civic-sedan-123456``.

    The first path segment with a delimited year counts. Behind it, numbers of five digits or more and vins at the end, drives, and one
    body at the end are dropped; the make is the first word or two; short and numeric words are joined to the model by a hyphen and
    written in capitals. Without a year all three are null.
    """
    is_year = lambda w: (F.length(w) == 4) & F.coalesce(w.try_cast("int").between(*YEARS), F.lit(False))
    path = F.regexp_replace(F.lower(F.regexp_replace(url, r"[?#].*$", "")), r"^[a-z][a-z0-9+.-]*://[^/]*", "")
    segments = F.transform(F.split(path, "/"), lambda g: F.split(g, "[-_]"))
    seg = F.get(F.filter(segments, lambda g: F.exists(g, is_year)), F.lit(0))
    year = F.get(F.filter(seg, is_year), F.lit(0))
    behind = F.array_join(F.slice(seg, F.array_position(seg, year).cast("int") + 1, F.size(seg)), " ")
    told = F.regexp_replace(F.trim(F.regexp_replace(behind, "[^a-z0-9]+", " ")), "(?:(?:^| )(?:[0-9]{5,}|[a-hj-npr-z0-9]{17}))+$", "")
    words = F.split(told, " ")
    two = F.array_join(F.slice(words, 1, 2), " ").isin(*TWO_WORDS)
    make = F.slice(words, F.lit(1), F.when(two, 2).otherwise(1))
    rest = F.filter(F.slice(words, F.when(two, 3).otherwise(2), F.size(words)), lambda w: ~w.isin(*SLUG_DRIVES))
    left = F.split(F.trim(F.regexp_replace(F.array_join(rest, " "), f"(?:^| )(?:{'|'.join(BODIES)})$", "")), " ")
    tail = F.transform(F.slice(left, F.lit(2), F.size(left)), lambda w: F.concat(F.when(w.rlike("^[0-9]+$") | (F.length(w) <= 2), F.lit("-")).otherwise(F.lit(" ")), _cased(w)))
    model = F.concat(_cased(F.get(left, F.lit(0))), F.array_join(tail, ""))
    return F.struct(year.try_cast("int").alias("year"), F.nullif(F.array_join(F.transform(make, _cased), " "), F.lit("")).alias("make"), F.nullif(model, F.lit("")).alias("model"))
