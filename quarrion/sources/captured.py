"""Readers of captured payloads: files and columns of text in, typed rows out. None of them touches a network."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

GEONAMES = "country string, zip string, city string, state_name string, state string, c5 string, c6 string, c7 string, c8 string, lat string, lng string, accuracy string"


def zip_centres(spark: SparkSession, path: str) -> DataFrame:
    """(zip, lat, lng, city, state) from a tab-separated postcode file; lines of too few fields or without numbers for coordinates are left out, the last line of a zip counts."""
    raw = spark.read.csv(path, sep="\t", schema=GEONAMES, quote="")
    rows = raw.select("zip", F.col("lat").try_cast("double").alias("lat"), F.col("lng").try_cast("double").alias("lng"), "city", "state", F.monotonically_increasing_id().alias("pos"))
    rows = rows.where("zip is not null and lat is not null and lng is not null")
    return rows.groupBy("zip").agg(F.max_by(F.struct("lat", "lng", "city", "state"), "pos").alias("r")).select("zip", "r.*")


def sheet_rows(sheet: DataFrame, names: dict[str, list[str]], keep: dict[str, list[str]]) -> DataFrame:
    """Columns of a sheet by header name (parts of an address are joined by blanks), rows whose columns hold a listed value only."""
    for column, allowed in keep.items():
        sheet = sheet.where(F.trim(F.col(column)).isin(allowed))
    say = lambda cols: F.nullif(F.trim(F.concat_ws(" ", *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cols])), F.lit(""))
    return sheet.select(*[say(cols).alias(n) for n, cols in names.items()])


class _Tables(HTMLParser):
    """Rows of cells of every table of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None


def table_rows(pages: DataFrame, key: str, page: str, needed: str) -> DataFrame:
    """(key, cells) of those tables of a page whose header holds a given name, a row's cells by header; rows with that cell blank are left out. Arrow batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, p in zip(b.column(0), b.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(p or "")
                for t in parser.tables:
                    head = [c.upper() for c in t[0]] if t else []
                    for row in t[1:] if needed.upper() in head else ():
                        cells = dict(zip(head, row))
                        if cells.get(needed.upper()):
                            keys.append(k.as_py()), out.append(list(cells.items()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(out, pa.map_(pa.string(), pa.string()))], names=[b.schema.names[0], "cells"])

    return pages.select(key, page).mapInArrow(read, f"`{key}` {pages.schema[key].dataType.simpleString()}, cells map<string,string>")


ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def map_candidates(elements: DataFrame) -> DataFrame:
    """Candidates of map elements (id, lat, lon, center, tags): own or centre coordinates, the first tag of each chain that says something. Elements without coordinates are left out."""
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("tags", F.lit(x))), F.lit("")) for x in names])
    e = elements.select("id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"), "tags").where("lat is not null and lng is not null")
    street = F.nullif(F.trim(F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))), F.lit(""))
    return e.select(F.col("id").cast("string").alias("source_id"), F.lit("osm").alias("source"), tag("name", "operator", "brand").alias("name"), street.alias("address"), tag("addr:city").alias("city"), tag("addr:postcode").alias("zip"), tag("phone", "contact:phone").alias("phone"), tag("website", "contact:website", "url").alias("website"), "lat", "lng")


def payload_elements(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Elements of JSON payloads; a payload that cannot be read has none."""
    return payloads.select(F.explode(F.from_json(column, ELEMENTS)["elements"]).alias("e")).select("e.*")


def area_query(lat: float, lng: float, miles: float) -> str:
    """The text of a query for car shops around a point, metres rounded down."""
    m = int(miles * 1609.34)
    kinds = "".join(f'{k}["shop"="car"](around:{m},{lat},{lng});' for k in ("node", "way"))
    return f"[out:json][timeout:180];({kinds});out center tags;"


def registry_candidates(registry: DataFrame) -> DataFrame:
    """Candidates of a licence registry, named by the trade name where there is one."""
    name = F.coalesce(F.nullif(F.trim("dba"), F.lit("")), F.col("name"))
    return registry.select(F.col("license_no").alias("source_id"), F.lit("registry").alias("source"), name.alias("name"), "address", "city", "state", "zip", "phone")


def links(page: Column) -> Column:
    """Hrefs of a page in order, entities of ampersands decoded."""
    return F.transform(F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#][^"']*)["']"""), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def sitemap_urls(xml: Column, wanted: str, unwanted: str) -> Column:
    """Addresses of a sitemap that match one pattern and not the other, each once in order."""
    locs = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(locs, lambda u: u.rlike(wanted) & ~u.rlike(unwanted)))


def robots_sitemaps(robots: Column) -> Column:
    """Addresses of a robots file's Sitemap lines."""
    return F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def inventory_links(pages: DataFrame, key: str, page: str, k: int = 6) -> DataFrame:
    """Per page the ``k`` first inventory links, those that say used first, then the shortest."""
    from quarrion.operators.search import top_of

    urls = pages.select(key, F.explode(F.array_distinct(links(F.col(page)))).alias("url")).where(F.col("url").rlike(r"(?i)inventory|used|pre-?owned|vehicles"))
    return top_of(urls, [key], [(~F.col("url").ilike("%used%")).asc(), F.length("url").asc(), F.col("url").asc()], k)


@F.pandas_udf(T.StringType())
def _joined_links(base: pd.Series, link: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return pd.Series([None if x is None else urljoin(b or "", x) for b, x in zip(base, link)], dtype="object")


def absolute(base: Column, link: Column) -> Column:
    """A link as an absolute address; null for none. Addresses with a scheme stay as they are without leaving the JVM."""
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).otherwise(_joined_links(base, link))


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Entities decoded, in Arrow batches."""
    return text.map(html.unescape, na_action="ignore")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body) of a folder of captured pages, one row a file; files that cannot be read are skipped, empty ones have no row."""
    raw = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    return raw.select("path", F.try_validate_utf8("content").alias("body") if hasattr(F, "try_validate_utf8") else F.col("content").cast("string").alias("body")).where("coalesce(body, '') <> ''")


def last_good(payloads: DataFrame, key: str, at: str, body: str, ok: Column) -> DataFrame:
    """Per key the body of its latest payload that is ``ok``, however old; keys without one are left out."""
    return payloads.where(ok & F.col(body).isNotNull()).groupBy(key).agg(F.max(F.struct(at, body)).alias("r")).select(key, "r.*")


def fresh(payloads: DataFrame, at: str, now: Column, ttl: str) -> DataFrame:
    """Cached payloads younger than ``ttl`` (an interval's text)."""
    return payloads.where(F.col(at) > now - F.expr(f"INTERVAL {ttl}"))


def merged_config(default: dict, saved: dict | None) -> dict:
    """Saved sections over the defaults, key by key within a section; unknown sections are kept."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in default.items()}
    for k, v in (saved or {}).items():
        out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def sitemap_pages(documents: DataFrame, url: str, body: str, roots: list[str], wanted: str, unwanted: str, rounds: int = 3) -> DataFrame:
    """(url) of the pages that sitemaps (url, body) name, from ``roots`` through indexes of up to ``rounds`` levels, each once."""
    known = documents.select(F.col(url).alias("_u"), F.explode(sitemap_urls(F.col(body), ".", "^$")).alias("_to"))
    front = documents.sparkSession.createDataFrame([(r,) for r in roots], "_u string")
    named = None
    for _ in range(rounds):
        to = known.join(front.distinct(), "_u", "left_semi").select(F.col("_to").alias("_u"))
        named = to if named is None else named.unionByName(to)
        front = to
    return named.where(F.col("_u").rlike(wanted) & ~F.col("_u").rlike(unwanted)).select(F.col("_u").alias(url)).distinct()


def json_rows(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def market_rows(payloads: DataFrame, key: str, body: str, items: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, fields) of the results pages of a marketplace: ``items`` is the path of the list, ``fields`` gives each column's path in an item and type.

    Pages and items are variants, so sources differ by paths only; what is missing or of another type is null, and a page that
    cannot be read has no rows.
    """
    v = payloads.select(F.col(key), F.try_variant_get(F.try_parse_json(body), items, "array<variant>").alias("_all")).select(key, F.explode("_all").alias("_one"))
    return v.select(key, *[F.try_variant_get("_one", path, kind).alias(name) for name, (path, kind) in fields.items()])
