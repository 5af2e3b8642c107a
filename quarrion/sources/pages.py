"""Listing rows of captured pages: embedded JSON, structured data, event handlers and free segments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROW = "extractor string, vin string, year string, make string, model string, trim string, price string, mileage string, image string, url string, name string"
_FIELDS = [f.split()[0] for f in ROW.split(", ")[1:]]
#: The names under which pages give each field.
KEYS = {
    "vin": ("vin", "vehicleIdentificationNumber", "mpn", "sku"), "year": ("year", "modelYear", "vehicleModelDate", "modelDate"), "make": ("make", "brand", "manufacturer"), "model": ("model",), "trim": ("trim", "vehicleConfiguration", "trimName"),
    "price": ("price", "internetPrice", "salePrice", "finalPrice", "askingPrice", "retailPrice", "internet_price", "our_price"), "mileage": ("mileage", "odometer", "miles", "mileageFromOdometer"), "image": ("vdp_hero_image", "image_url", "image", "thumbnail", "imageUrl", "photo", "primaryImage", "image_urls", "images"), "url": ("url", "link", "vdpUrl", "vdp_url", "detailUrl", "href", "@id", "mainEntityOfPage"), "name": ("name", "title"),
}
#: Fields that only a vehicle has, makes of cars, types of nodes, and how deep a value is walked.
SIGNALS = ("vehicleIdentificationNumber", "vin", "mileageFromOdometer", "vehicleModelDate", "vehicleTransmission", "vehicleEngine", "bodyType", "driveWheelConfiguration")
CAR_MAKES = frozenset([
    "acura", "alfa romeo", "aston martin", "audi", "bentley", "bmw", "buick", "cadillac", "chevrolet", "chevy", "chrysler", "dodge", "ferrari", "fiat", "ford", "genesis", "gmc", "honda", "hummer", "hyundai", "infiniti",
    "jaguar", "jeep", "kia", "lamborghini", "land rover", "lexus", "lincoln", "lotus", "lucid", "maserati", "maybach", "mazda", "mclaren", "mercedes-benz", "mercedes benz", "mercedes", "mercury", "mini", "mitsubishi", "nissan",
    "oldsmobile", "polestar", "pontiac", "porsche", "ram", "rivian", "rolls-royce", "rolls royce", "saab", "saturn", "scion", "smart", "subaru", "suzuki", "tesla", "toyota", "volkswagen", "vw", "volvo",
])
VEHICLES, PRODUCTS = {"Vehicle", "Car"}, {"Product", "IndividualProduct"}
DEEPEST = 12
_VIN = re.compile(r"^[A-HJ-NPR-Z0-9]{17}$")


def _plain(v):
    """A scalar of a nested value: the name, value or price of an object, the first of a list that says something."""
    while isinstance(v, (list, dict)):
        v = next((v[k] for k in ("name", "value", "price", "lowPrice", "url", "uri", "src", "contentUrl", "@id") if v.get(k) not in (None, "")), None) if isinstance(v, dict) else next((x for x in v if x not in (None, "", [], {})), None)
    return None if v in (None, "") else str(v)


def record(node: dict) -> dict:
    """The fields of one vehicle node; offers give the price if the node does not."""
    low = {str(k).lower(): v for k, v in node.items()}
    out = {f: next((p for k in ks if (p := _plain(low.get(k.lower()))) is not None), None) for f, ks in KEYS.items()}
    if out["price"] is None:
        out["price"] = next((p for k in ("offers", "pricing") if (p := _plain(low.get(k))) is not None), None)
    # an article number can be the vin, and a vin that is none is left out
    out["vin"] = next((p.strip().upper() for k in KEYS["vin"] if (p := _plain(low.get(k.lower()))) and _VIN.match(p.strip().upper())), None)
    if out["url"]:
        out["url"] = out["url"].split("#")[0].strip() or None
    return out


def from_name(row: dict) -> dict:
    """Year, make, model and trim that a row lacks, from a name such as ``2019 Honda Civic LX``."""
    words = (row["name"] or "").split()
    if words and words[0].isdigit():
        first, words = words[0], words[1:]
        if not row["year"] and 1900 <= int(first) <= 2100:
            row["year"] = first
    for k, part in enumerate(("make", "model")):
        if not row[part] and len(words) > k:
            row[part] = words[k]
    if not row["trim"] and row["make"] and row["model"] and len(words) > 2:
        row["trim"] = " ".join(words[2:])
    return row


def is_car(node: dict) -> bool:
    """A field that only a vehicle has, or a car's make as brand."""
    return any(node.get(k) for k in SIGNALS) or str(_plain(node.get("brand") or node.get("manufacturer")) or "").strip().lower() in CAR_MAKES


def typed_nodes(value):
    """Nodes of structured data that are vehicles by type, or products that are cars; other products (a dentist's) are not."""
    stack = [(value, 0)]
    while stack:
        v, d = stack.pop()
        if d > DEEPEST:
            continue
        if isinstance(v, dict):
            kinds = v.get("@type")
            kinds = set(kinds if isinstance(kinds, list) else [kinds])
            if kinds & VEHICLES or kinds & PRODUCTS and is_car(v):
                yield v
            else:
                stack += [(x, d + 1) for x in reversed(list(v.values()))]
        elif isinstance(v, list):
            stack += [(x, d + 1) for x in reversed(v)]


def largest_list(value) -> list[dict]:
    """The longest list of vehicle-like objects anywhere in a value; of equally long ones the first met."""
    like = lambda x: isinstance(x, dict) and ("vin" in (low := {str(k).lower() for k in x}) or {"year", "make", "model"} <= low or {"make", "model", "price"} <= low)
    best, stack = [], [(value, 0)]
    while stack:
        v, d = stack.pop()
        if d > DEEPEST:
            continue
        if isinstance(v, list):
            found = [x for x in v if like(x)]
            if len(found) > len(best):
                best = found
        if isinstance(v, (list, dict)):
            stack += [(x, d + 1) for x in reversed(list(v.values()) if isinstance(v, dict) else v)]
    return best


def nodes(value, depth: int = DEEPEST):
    """Vehicle-like objects of a JSON value in order: they give a vin, or a make and a model. Deeper than ``depth`` is not looked."""
    stack = [(value, 0)]
    while stack:
        v, d = stack.pop()
        if d > depth:
            continue
        if isinstance(v, dict):
            low = {str(k).lower() for k in v}
            kind = v.get("@type")
            if low & {"vin", "vehicleidentificationnumber"} or {"make", "model"} <= low or {"brand", "model"} <= low or kind in ("Vehicle", "Car"):
                yield v
            else:
                stack += [(x, d + 1) for x in reversed(list(v.values()))]
        elif isinstance(v, list):
            stack += [(x, d + 1) for x in reversed(v)]


def decoded_at(text: str, at: int):
    """The JSON value that begins at or after a place of a text, or None."""
    m = re.compile(r"[\[{]").search(text, at)
    try:
        return json.JSONDecoder().raw_decode(text, m.start())[0] if m else None
    except ValueError:
        return None


_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)
_NEXT = re.compile(r"<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>", re.I)
_STATE = re.compile(r"(?:DDC\.WS\.state\[[^\]]*\]|window\.__[A-Z_]+__|inventoryData|vehicles)\s*=\s*")
_INLINE = re.compile(r"\"vin\"\s*:\s*\"[A-HJ-NPR-Z0-9]{17}\"", re.I)
_HANDLER = re.compile(r"vehicleDetails\(\s*\$event\s*,\s*(\{.*?\})\s*\)", re.S)


def _json_ld(page):
    for block in _LD.findall(page):
        yield from typed_nodes(decoded_at(block, 0))


def _next_data(page):
    yield from max((largest_list(decoded_at(page, m.end())) for m in _NEXT.finditer(page)), key=len, default=[])


def _state(page):
    for m in _STATE.finditer(page):
        yield from nodes(decoded_at(page, m.end()))


def _handlers(page):
    for block in _HANDLER.findall(page.replace("&quot;", '"')):
        yield from nodes(decoded_at(block, 0))


def _inline(page):
    for m in _INLINE.finditer(page):
        start = page.rfind("{", max(0, m.start() - 12_000), m.start())
        if start >= 0:
            yield from nodes(decoded_at(page, start))


#: In order of preference; of equally complete ones the earlier counts.
EXTRACTORS = {"json_ld": _json_ld, "next_data": _next_data, "state": _state, "handlers": _handlers, "inline": _inline}


def best_rows(page: str | None) -> tuple[str, list[dict]]:
    """The extractor whose rows fill most fields, with its rows, repeats of a vin or address left out."""
    best = ("", [], 0)
    for name, find in EXTRACTORS.items():
        rows, seen = [], set()
        for node in find(page or ""):
            r = from_name(record(node)) if name == "json_ld" else record(node)
            key = r["vin"] or r["url"] or json.dumps(r, sort_keys=True)
            if any(r.values()) and key not in seen:
                seen.add(key)
                rows.append(r)
        full = sum(v is not None for r in rows for v in r.values())
        if full > best[2]:
            best = (name, rows, full)
    return best[:2]


def page_listings(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, fields of ROW) of captured pages, each by its best extractor; a page that holds none, null or broken gives no row. Arrow batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = [], []
            for k, p in zip(b.column(0), b.column(1).to_pylist()):
                name, rows = best_rows(p)
                keys += [k.as_py()] * len(rows)
                out += [(name, *(r[f] for f in _FIELDS)) for r in rows]
            cols = list(zip(*out)) or [()] * (len(_FIELDS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *(pa.array(c, pa.string()) for c in cols)], names=[b.schema.names[0], "extractor", *_FIELDS])

    return pages.select(key, page).mapInArrow(read, f"`{key}` {pages.schema[key].dataType.simpleString()}, {ROW}")


#: What a page of each platform holds.
PLATFORMS = {"dealer.com": r"DDC\.WS\.state|static\.dealer\.com", "dealer_inspire": r"SEARCH_SERVICE|dealerinspire"}


def platform_of(page: Column) -> Column:
    """The platform that a page's marks tell, else generic; none for a null or empty page."""
    out = F.when(F.coalesce(page, F.lit("")) == "", F.lit("none"))
    for name, marks in PLATFORMS.items():
        out = out.when(page.rlike(marks), F.lit(name))
    return out.otherwise(F.lit("generic"))


API = """vehicles array<struct<vin:string,stock:string,year:string,make:string,model:string,trim:string,mileage:string,vdp_url:string,
    pricing:struct<price:string,internet_price:string,our_price:string>,styles:struct<exterior_color:string>,mechanical:struct<transmission:string>,media:struct<images:array<string>>>>"""


def api_vehicles(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, vin, year, make, model, trim, mileage, price, exterior_color, transmission, image_url, url) of the pages of a search service; a broken page gives no row."""
    v = payloads.select(key, F.explode(F.from_json(body, API)["vehicles"]).alias("v"))
    number = lambda c: F.regexp_replace(F.col(c), "[,\\s]", "").try_cast("int")
    price = F.coalesce(*[F.nullif(number(f"v.pricing.{p}"), F.lit(0)) for p in ("price", "internet_price", "our_price")])
    return v.select(key, "v.vin", number("v.year").alias("year"), "v.make", "v.model", "v.trim", number("v.mileage").alias("mileage"), price.alias("price"), "v.styles.exterior_color", "v.mechanical.transmission", F.get("v.media.images", F.lit(0)).alias("image_url"), F.col("v.vdp_url").alias("url"))


def segment_fields(text: Column) -> Column:
    """(vin, mileage, price) of a free segment; a price with a payment period behind it does not count."""
    amounts = F.regexp_extract_all(text, F.lit(r"(?i)\$\s*([\d,]{3,})(?!\S*\s*(?:/|per\b|a\s)\s*(?:mo|month|wk|week))(?![\d,])"), F.lit(1))
    number = lambda s: F.regexp_replace(s, ",", "").try_cast("int")
    return F.struct(
        F.nullif(F.upper(F.regexp_extract(text, r"(?i)\b([A-HJ-NPR-Z0-9]{17})\b", 1)), F.lit("")).alias("vin"),
        number(F.regexp_extract(text, r"(?i)([\d,]+)\s*(?:mi|miles)\b", 1)).alias("mileage"),
        number(F.get(amounts, F.lit(0))).alias("price"),
    )


def enriched(rows: DataFrame, cards: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Missing, blank or zero fields of ``rows`` from ``cards`` by the first key that matches; nothing present is overwritten."""
    for k in keys:
        c = cards.where(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").groupBy(k).agg(*[F.min(f).alias(f"_c_{f}") for f in fields])
        rows = rows.join(c, k, "left")
        for f in fields:
            own = F.when(~F.coalesce(F.col(f).cast("string"), F.lit("")).isin("", "0"), F.col(f))
            rows = rows.withColumn(f, F.coalesce(own, F.col(f"_c_{f}")))
        rows = rows.drop(*[f"_c_{f}" for f in fields])
    return rows
