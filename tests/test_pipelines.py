import itertools
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarrion import session
from quarrion.functions.urls import slug_parts
from quarrion.operators import dealers, discovery, inventory, linkage, search, status, upsert
from quarrion.sources import captured, pages, provider

V = "1HGCM82633A004352"


def ld(*nodes):
    return "<html><script type='application/ld+json'>" + json.dumps(list(nodes)) + "</script></html>"


def test_pages_of_structured_data(spark):
    """Typed nodes only, products that are no cars left out, gaps filled from the name, offers as object or list, fragments cut off."""
    bodies = [
        ld({"@type": "Product", "name": "Dental cleaning", "brand": "Smile", "model": "Basic", "offers": {"price": 90}}),
        ld({"@type": ["Product"], "name": "2019 Honda Civic LX Sport", "brand": {"name": "Honda"}, "sku": V, "offers": [{"price": 17000}], "url": "https://a.test/v/1#top"}),
        ld({"@graph": [{"@type": "Car", "name": "2020 Kia Soul EX", "vehicleIdentificationNumber": "short", "mileageFromOdometer": {"value": 5, "unitCode": "SMI"}, "offers": {"lowPrice": 9000}, "image": [{"url": "https://a.test/i.jpg"}]}]}),
        """<script id="__NEXT_DATA__">{"a":[{"vin":"x"}],"b":{"c":[{"make":"Kia","model":"Rio","price":1},{"make":"Kia","model":"Soul","price":2}]}}</script>""",
        None, "",
    ]
    got = {(r.id, r.extractor, r.vin, r.year, r.make, r.model, r.trim, r.price, r.mileage, r.image, r.url) for r in pages.page_listings(spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "id long, page string, vin string"), "id", "page").collect()}
    assert got == {
        (1, "json_ld", V, "2019", "Honda", "Civic", "LX Sport", "17000", None, None, "https://a.test/v/1"), (2, "json_ld", None, "2020", "Kia", "Soul", "EX", "9000", "5", "https://a.test/i.jpg", None),
        (3, "next_data", None, None, "Kia", "Rio", None, "1", None, None, None), (3, "next_data", None, None, "Kia", "Soul", None, "2", None, None, None),
    }
    marks = spark.createDataFrame([("DDC.WS.state",), ("var SEARCH_SERVICE = {}",), ("<html>",), (None,)], "p string")
    assert [r[0] for r in marks.select(pages.platform_of(F.col("p"))).collect()] == ["dealer.com", "dealer_inspire", "generic", "none"]


def test_api_pages(spark):
    body = json.dumps({"vehicles": [{"vin": V, "year": 2019, "make": "Kia", "model": "Rio", "mileage": "12,000", "pricing": {"price": 0, "our_price": "9,500"}, "media": {"images": ["u1", "u2"]}, "vdp_url": "/v"}, {"vin": None}]})
    got = [tuple(r) for r in pages.api_vehicles(spark.createDataFrame([(1, body), (2, "{broken"), (3, None)], "id int, body string"), "id", "body").collect()]
    assert got == [(1, V, 2019, "Kia", "Rio", None, 12000, 9500, None, None, "u1", "/v"), (1, *[None] * 11)]


def test_slugs(spark):
    cases = {
        "/details/used-2009-bentley-continental/125246228": (2009, "Bentley", "Continental"), "/viewdetails/used/x/2025-mazda-cx-30-sport-utility": (2025, "Mazda", "CX-30"), "/viewdetails/used/x/2021-jeep-grand-cherokee-sport-utility": (2021, "Jeep", "Grand Cherokee"), "/viewdetails/used/1g1zg5st7pf199927": (None, None, None),
        "https://a.test/2019-land-rover-range-rover-awd-4dr-suv-123456?x=2001": (2019, "Land Rover", "Range Rover"), "/1949-ford-x": (None, None, None), "/2040-ford-x": (None, None, None), f"/used/2015-bmw-x3-{V.lower()}": (2015, "BMW", "X3"), "/2012": (2012, None, None), None: (None, None, None),
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", slug_parts(F.col("u")).alias("x")).select("u", "x.year", "x.make", "x.model").collect()
    assert {r.u: (r.year, r.make, r.model) for r in rows} == cases


def test_captured(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>1</p>")
    (tmp_path / "b.html").write_text("")
    assert [r.body for r in captured.read_pages(spark, str(tmp_path)).collect()] == ["<p>1</p>"]
    p = spark.createDataFrame([("k", 1, "old", 200), ("k", 2, "new", 200), ("k", 3, "bad", 500), ("z", 1, "x", 500), ("k", 4, None, 200)], "key string, at int, body string, code int")
    assert [tuple(r) for r in captured.last_good(p, "key", "at", "body", F.col("code") == 200).collect()] == [("k", 2, "new")]
    t = spark.sql("select timestamp'2025-01-01 00:00:00' as at, 1 as k union all select timestamp'2025-01-02 00:00:00', 2")
    assert [r.k for r in captured.fresh(t, "at", F.expr("timestamp'2025-01-02 06:00:00'"), "12 HOURS").collect()] == [2]
    assert captured.merged_config({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"y": 5}, "c": 1}) == {"a": {"x": 1, "y": 5}, "b": 3, "c": 1}
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    maps = spark.createDataFrame([("r", loc("i1", "/used/0")), ("i1", loc("i2", "/used/1", "/blog/1")), ("i2", loc("/used/2", "i1")), ("other", loc("/used/9"))], "url string, body string")
    assert {r.url for r in captured.sitemap_pages(maps, "url", "body", ["r"], "used", "blog").collect()} == {"/used/0", "/used/1", "/used/2"}
    captured.json_rows(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "b"]
    links = spark.createDataFrame([("https://a.test/x/", "../y"), ("https://a.test/x/", "https://b.test/"), (None, "z"), ("q", None)], "b string, l string")
    assert [r[0] for r in links.select(captured.absolute(F.col("b"), F.col("l"))).collect()] == ["https://a.test/y", "https://b.test/", "z", None]


def test_jaccard_of_hot_items(spark):
    """The index of rarest items loses no pair, an item that all owners hold included."""
    r = random.Random(3)
    sets = {i: {"hot"} | {f"v{r.randrange(12)}" for _ in range(r.randrange(1, 7))} for i in range(30)} | {90: {"hot"}, 91: {"hot"}}
    rows = spark.createDataFrame([(o, v) for o, s in sets.items() for v in s] + [(0, "hot"), (None, "hot"), (5, None)], "o long, v string")
    for least in (0.3, 0.5, 0.9):
        want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(x.a, x.b): x.jaccard for x in linkage.set_jaccard(rows, "o", "v", least).collect()} == want and want
    assert linkage.set_jaccard(rows.limit(0), "o", "v", 0.5).count() == 0


def test_dealers(spark):
    rows = spark.createDataFrame([("r:1", "registry", "Acme Motors LLC", "1 Main", "Dunton", "TX", "70001-123", None, None, ""), ("o:1", "osm", "ACME MOTORS", None, None, None, "70001", "555", "acme.test", "acme.test"), ("d:1", "directory", "Other", "2 Main", None, None, "70009", "556", "www.acme.test", "acme.test"), ("d:2", "directory", None, None, None, None, None, None, None, "")], "key string, source string, name string, address string, city string, state string, zip string, phone string, website string, host string")
    got = {r.root: (r.n, r.name, r.address, r.phone, r.website) for r in dealers.merged(rows, {"osm": 0, "directory": 1}, "registry").collect()}
    assert got == {"d:1": (3, "Acme Motors LLC", "1 Main", "555", "acme.test"), "d:2": (1, None, None, None, None)}
    cars = spark.createDataFrame([(1, f"u{i}", V, 5, 5, "i", 1) for i in range(4)] + [(2, "u#", None, None, None, None, 1)] * 3 + [(3, "u", V, 5, 5, "i", 1)], "dealership_id long, url string, vin string, price int, mileage int, image_url string, is_active int")
    q = {r.dealership_id: (r.n, r.score, r.flags, r.flagged) for r in dealers.quality(cars, spark.createDataFrame([(1, "generic"), (2, None)], "id long, platform string")).collect()}
    assert q == {1: (4, 100, "", False), 2: (3, 5, "synthetic_urls,missing_vin,missing_price,missing_image", True)}


def test_status(spark):
    df = spark.createDataFrame([("dealer.com", None), ("dealer.com", "unknown"), (None, "none"), ("generic", "dealer.com"), ("", "")], "b string, n string")
    assert [r[0] for r in df.select(status.kept_platform(F.col("b"), F.col("n"))).collect()] == ["dealer.com", "dealer.com", "none", "dealer.com", ""]
    links = spark.createDataFrame([(["/x", f"/v/{V.lower()}"], V, "2019-kia-rio"), (["/2019-kia-rio-1"], V, "2019-kia-rio"), ([], V, "s"), ([], None, None)], "l array<string>, v string, s string")
    assert [r[0] for r in links.select(status.matched_link(F.col("l"), F.col("v"), F.col("s"))).collect()] == [f"/v/{V.lower()}", "/2019-kia-rio-1", f"#{V}", None]
    loads = spark.createDataFrame([(1, 1, "a", "u"), (2, 1, "a", "w"), (2, 1, "b", "x"), (3, 2, "c", "y")], "load_no int, d long, vin string, url string")
    got = {tuple(r) for r in inventory.scan_counters(*inventory.consecutive(loads, "load_no"), ["load_no", "d"]).select("load_no", "d", "found", "new", "kept", "sold", "moved").collect()}
    assert got == {(2, 1, 2, 1, 1, 0, 1), (3, 2, 1, 1, 0, 0, 0)}
    assert search.arguments({"year_min": "2010", "price_max": "x", "hide_duplicates": "yes", "make": "Kia", "source": None}) == {"year_min": 2010, "hide_duplicates": False, "make": "Kia"}
    now = spark.createDataFrame([(1, 5.0, 3, "a")], "website int, distance_mi double, last_seen int, name string")
    batch = spark.createDataFrame([(1, None, 9, "b"), (2, 1.0, 9, "c")], "website int, distance_mi double, last_seen int, name string")
    assert {tuple(r) for r in upsert.upsert(now, batch, "website", [], ["distance_mi", "last_seen"]).collect()} == {(1, None, 9, "a", False), (2, 1.0, 9, "c", True)}


def test_market_rows(spark):
    body = json.dumps({"data": {"hits": [{"vin": V, "price": {"amount": 9000}, "year": "2019"}, {"vin": 5, "price": None}, "odd"]}})
    df = spark.createDataFrame([(1, body), (2, "{broken"), (3, None), (4, "[]")], "id int, body string")
    got = [tuple(r) for r in captured.market_rows(df, "id", "body", "$.data.hits", {"vin": ("$.vin", "string"), "price": ("$.price.amount", "int"), "year": ("$.year", "int")}).collect()]
    assert got == [(1, V, 9000, 2019), (1, "5", None, None), (1, None, None, None)]


def test_provider_and_discovery(spark, tmp_path):
    """A provider's folder read as a data source, merged with a registry, matched and placed; what was found again adds nothing."""
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "name": "Acme Motors", "zip": "70001", "website": "https://acme.test", "phone": 5}) + "\n{broken\n[]\n" + json.dumps({"id": 2, "name": None, "zip": "70009"}) + "\n")
    (tmp_path / "b.json").write_bytes(b"\xff\xfe")
    provider.register(spark)
    found = spark.read.format("candidates").option("source", "osm").load(str(tmp_path))
    assert {(r.key, r.name, r.phone) for r in found.collect()} == {("osm:1", "Acme Motors", "5"), ("osm:2", None, None)}
    assert spark.read.format("candidates").load(str(tmp_path / "missing")).count() == 0
    registry = spark.createDataFrame([("registry:7", "registry", "ACME MOTORS LLC", "1 Main", "Dunton", "TX", "70001-5", None, None), ("registry:8", "registry", "Far Cars", "2 Main", "Far", "TX", "79999", None, None), ("registry:9", "registry", "New Cars", "3 Main", "Dunton", "TX", "70001", None, None)], provider.SCHEMA)
    zips = spark.createDataFrame([("70001", 30.0, -95.0), ("70009", 30.1, -95.0), ("79999", 40.0, -95.0)], "zip string, lat double, lng double")
    known = spark.createDataFrame([(4, "Old name", "00000", "http://www.acme.test/x")], "id long, name string, zip string, website string")
    run = lambda dealers_: {r.root: (r.name, r.address, r.website, r.dealer, r.is_new) for r in discovery.discovered({"osm": found, "registry": registry}, dealers_, zips, {"osm": 0}, "registry", 30.0, -95.0, 50).collect()}
    assert run(known) == {"osm:1": ("ACME MOTORS LLC", "1 Main", "https://acme.test", 4, False), "osm:2": ("Unnamed dealer (candidate:osm:2)", None, None, None, True), "registry:9": ("New Cars", "3 Main", None, None, True)}
    again = known.unionByName(spark.createDataFrame([(5, "New Cars", "70001", None)], known.schema))
    assert not run(again)["registry:9"][4] and run(known.limit(0))["osm:1"][4]


def test_checkpoint_folder_on_a_cluster():
    """Without the setting a cluster gets an error and not a folder of one machine; with it the named folder is used."""
    made = []
    sc = SimpleNamespace(getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append, getConf=lambda: SimpleNamespace(get=lambda k: None), master="spark://x:7077")
    fake = lambda named: SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: named))
    with pytest.raises(ValueError):
        session.checkpoint_folder(fake(None))
    assert session.checkpoint_folder(fake("hdfs:///ck")) == "hdfs:///ck" and made == ["hdfs:///ck"]
