"""Column functions that bring names, sites, codes and numbers to one form. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Legal forms that a normalised name leaves out, words of other trades, and spellings of makes.
FORMS = ("llc", "inc", "co", "lp", "ltd")
OTHER_TRADES = ("floral", "flower", "florist", "boutique", "salon", "bakery", "realty")
MAKES = {"chevy": "chevrolet", "vw": "volkswagen", "mercedes": "mercedes benz", "benz": "mercedes benz", "landrover": "land rover", "rollsroyce": "rolls royce", "alfa": "alfa romeo"}
BLOCKED = ("facebook.com", "instagram.com", "google.com", "yelp.com", "cars.com", "cargurus.com", "carsforsale.com", "autotrader.com", "craigslist.org")


def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def host(url: Column, keep_port: bool = False) -> Column:
    """Lower-case host without ``www.``; '' for null or empty (C2 with the port, C1 without)."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    h = F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^www\.", "")
    return h if keep_port else F.regexp_replace(h, r":\d*$", "")


def canonical_website(url: Column) -> Column:
    """Https:// and the host; null without a dot in it."""
    h = host(url)
    return F.when(F.contains(h, F.lit(".")), F.concat(F.lit("https://"), h))


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation as blanks, legal forms left out; '' for null."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}_\s]+|\s+", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*FORMS)), " ")


def zip5(code: Column) -> Column:
    """C4: the first five digits, '' if there are fewer."""
    d = F.regexp_replace(F.coalesce(code, F.lit("")), r"[^0-9]", "")
    return F.when(F.length(d) >= 5, F.substring(d, 1, 5)).otherwise(F.lit(""))


def norm_address(a: Column) -> Column:
    """Lower case words with single blanks; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(a, F.lit(""))), "[^a-z0-9]+", " "))


def make_key(make: Column) -> Column:
    """The first five characters of a make after aliases."""
    m = norm_address(make)
    known = F.create_map(*[F.lit(x) for kv in MAKES.items() for x in kv])
    return F.substring(F.coalesce(F.try_element_at(known, m), m), 1, 5)


def name_domain_score(name: Column, domain: Column) -> Column:
    """Words of more than two letters that stand in the domain without its last part; five less for other trades."""
    stem = F.regexp_replace(domain, r"\.[^.]*$", "")
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    hits = F.size(F.filter(words, lambda w: (F.length(w) > 2) & F.contains(stem, w)))
    return hits - F.when(F.exists(words, lambda w: w.isin(*OTHER_TRADES)), 5).otherwise(0)


def money_to_int(text: Column) -> Column:
    """The digits of a text as a number; null without any."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("bigint")


def bounded(value: Column, low: int, high: int) -> Column:
    """A whole number from low to high, else null."""
    n = F.regexp_replace(value.cast("string"), r"[,\s]", "").try_cast("bigint")
    return F.when(n.between(low, high), n)


def looks_like_vin(v: Column) -> Column:
    """C10."""
    return F.coalesce(F.upper(F.trim(v)).rlike("^[A-HJ-NPR-Z0-9]{17}$"), F.lit(False))


def slug(text: Column) -> Column:
    """C11: words joined by hyphens; '' for null."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_path_key(url: Column) -> Column:
    """Lower-case path without a trailing slash."""
    path = F.regexp_extract(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"^([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def cache_key(url: Column, params: Column) -> Column:
    """SHA-256 of an address and its sorted parameters (a map of strings)."""
    pairs = F.transform(F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.sha2(F.concat(url, F.lit("?"), F.array_join(pairs, "&")), 256)


def blocked_host(domain: Column) -> Column:
    """a listed host or one under it."""
    return F.coalesce(F.exists(F.array(*[F.lit(b) for b in BLOCKED]), lambda b: (domain == b) | F.endswith(domain, F.concat(F.lit("."), b))), F.lit(False))


def title_parts(title: Column) -> Column:
    """(year, miles, price) of an advert's title."""
    miles = F.regexp_replace(F.regexp_extract(title, r"(?i)([\d,]+)\s*(?:mi|miles|k)", 1), ",", "").try_cast("bigint")
    thousand = F.regexp_extract(title, r"(?i)[\d,]+\s*(mi|miles|k)", 1)
    return F.struct(
        F.regexp_extract(title, r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"),
        F.when(F.lower(thousand) == "k", miles * 1000).otherwise(miles).alias("miles"),
        F.regexp_replace(F.regexp_extract(title, r"\$\s*([\d,]+)", 1), ",", "").try_cast("bigint").alias("price"),
    )


def manual(transmission: Column) -> Column:
    """says manual and not automatic."""
    t = F.lower(transmission)
    return t.like("%manual%") & ~t.like("%automat%")
