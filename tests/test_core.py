import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from quarrion.functions import normalize as N
from quarrion.functions.similarity import ratio, token_set, token_sort
from quarrion.operators import history, inventory, linkage, profile, search, snapdiff, upsert
from quarrion.operators.graph import components
from quarrion.plans import pipelines, reference, training
from quarrion.sources import captured, pages
from quarrion.streaming.inventory import apply_batches, event_windows, read_stream

SNAP = "load_no int, source string, dealership_id long, url string, vin string, mileage int, price int, image_url string, first_seen timestamp, last_seen timestamp"


def frames(spark, data, *names):
    return [spark.read.parquet(f"{data}/{n}.parquet") for n in names]


def test_snapshots_against_brute_force(spark, data):
    tables = frames(spark, data, "listing_snapshots", "load_calendar", "listings")
    by = brute.weeks(*(pd.read_parquet(f"{data}/{n}.parquet") for n in ("listing_snapshots", "load_calendar")))
    url = {brute.key(u): u for u in pd.read_parquet(f"{data}/listings.parquet").url}
    assert {tuple(r) for r in history.price_history(*tables).collect()} == {(url[p], *x) for p, *x in brute.versions(by)}
    assert {tuple(r) for r in snapdiff.snapshot_changes(*tables).collect()} == {(k, url[p], c) for k, p, c in brute.changes(by)}


def test_snapshots_of_odd_rows(spark):
    """Nulls, ties, repeats, a skipped week, an absence, a late row and clashing names."""
    cal = spark.sql("select k as load_no, timestamp'2025-01-06' + make_dt_interval(7 * (k - 1)) as week_start, timestamp'2025-01-06' + make_dt_interval(7 * k) as week_end from values (1), (2), (3), (4), (5) t(k)")
    u = "https://www.a.test/car/1"
    rows = [(1, u, 10, "2025-01-07"), (1, u, 10, "2025-01-07"), (1, u, 9, "2025-01-06"), (3, u + "/?ref=x#y", None, "2025-01-14"), (4, "http://a.test/car/1", 10, "2025-01-28"), (5, u, 12, "2025-02-03"), (5, u, 11, "2025-02-03"), (5, None, 5, "2025-02-03"), (2, "https://www.a.test/car/2", None, "2025-01-14"), (9, u, 7, "2026-01-01"), (9, u, 7, None)]
    snaps = spark.createDataFrame([(n, "s", x, p, t) for n, x, p, t in rows], "load_no int, source string, url string, price int, t string").selectExpr("*", "cast(t as timestamp) as last_seen", "1 as page", "2 as ord", "3 as chunk")
    listings = spark.createDataFrame([(u,)], "url string")
    # week 3 has no row of the source: the version of 10 runs across it
    assert {tuple(r) for r in history.price_history(snaps, cal, listings).collect()} == {(u, 10, 1, 4), (u, 12, 5, 5)}
    assert {tuple(r) for r in snapdiff.snapshot_changes(snaps, cal, listings).collect()} == {(2, "https://www.a.test/car/2", "added"), (2, u, "changed"), (4, "https://www.a.test/car/2", "removed"), (4, u, "changed"), (5, u, "changed")}
    assert history.price_history(snaps.limit(0), cal, listings).count() == 0 and snapdiff.snapshot_changes(snaps, cal.limit(0), listings).count() == 0


def test_altered_loads(spark):
    def rows(load, i):
        vin = f"7Z{i:015d}"
        price = 10_000 + 37 * i
        return (load, "s", vin[:9] if load == 4 else vin, price * (100 if load == 6 else 1) if not (load == 8 and i % 10) else None, f"https://x.test/{i % 5 if load == 2 else i}.jpg")

    df = spark.createDataFrame([rows(n, i) for n in range(1, 11) for i in range(200)] + [(1, None, None, None, None), (3, "s", "x" * 5000, -5, "")], "load_no int, source string, vin string, price int, image_url string").selectExpr("*", "1 as n", "2 as mask")
    out = profile.altered_loads(df, ["source"], "load_no", ["vin", "price", "image_url"]).where("altered and source is not null")
    assert {(r.load_no, r.column_name) for r in out.collect()} == {(4, "vin"), (6, "price"), (8, "price"), (2, "image_url")}
    whole = profile.profile(df.drop("n", "mask"), ["source"], "load_no", ["vin", "price", "image_url"])
    assert whole.where("source = 's' and load_no = 3 and column_name = 'vin'").first().n_violations == 1
    assert profile.altered_loads(df.limit(0), ["source"], "load_no", ["vin"]).count() == 0


@pytest.mark.parametrize("name", sorted({**reference.SQL, **pipelines.SQL, **training.SQL}))
def test_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    a = {**reference.QUERIES, **pipelines.QUERIES, **training.QUERIES}[name](spark, data).toPandas()
    b = con.execute({**reference.SQL, **pipelines.SQL, **training.SQL}[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list):
            return str([plain(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return ""
        try:
            return f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    cols = sorted(a.columns)
    assert sorted(tuple(map(plain, r)) for r in a[cols].itertuples(index=False)) == sorted(tuple(map(plain, r)) for r in b[cols].itertuples(index=False))


def test_ratios():
    assert ratio("", "") == 100 and ratio("a", "") == 0 and round(ratio("abcd", "abxd"), 2) == 75 and token_sort("civic honda", "honda civic") == 100
    assert token_set("se", "se sport utility") == 100 and token_set("lx", "touring") < 60 and token_set("", "a") == 0


def test_normalisers(spark):
    df = spark.createDataFrame([("HTTPS://WWW.Foo.com:80/A/?x", "ACME, L.L.C. of Texas LLC", "$1,299"), (None, None, None), ("", "", "abc"), ("nodot", "x", "")], "u string, n string, m string")
    got = [tuple(r) for r in df.select(N.canonical_website(F.col("u")), N.host(F.col("u"), True), N.normalize_name(F.col("n")), N.money_to_int(F.col("m")), N.blocked_host(N.host(F.col("u")))).collect()]
    assert got == [("https://foo.com", "foo.com:80", "acme l l c of texas", 1299, False), (None, "", "", None, False), (None, "", "", None, False), (None, "nodot", "x", None, False)]


def test_graph_and_linkage(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 8), (None, 1), (2, 1)], "a long, b long")
    assert {(r.id, r.root) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    rows = spark.createDataFrame([(1, "V1", "Honda", "Civic", "LX", 2019, 42000, 18995), (2, None, "honda", "civic", None, 2019, 42100, 18900), (3, "V2", "Honda", "Civic", "LX", 2019, 42200, 19000), (4, None, "Honda", "Civic", "LX", 2019, 90000, 18995), (5, None, "Honda", "Civic", "LX", 2019, 0, None)], "id long, vin string, make string, model string, trim string, year int, mileage int, price int")
    pairs = linkage.fuzzy_pairs(rows, ["year"])
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (2, 3)}
    assert {tuple(r) for r in linkage.guarded_groups(pairs, rows, ["year"]).collect()} == {(1, 1), (2, 1)}


def test_upserts_and_diff(spark):
    now = spark.createDataFrame([("a", 1, 2, "x"), ("b", 3, 4, "y")], "url string, price int, mileage int, make string")
    batch = spark.createDataFrame([("a", None, 9, 1), ("a", 7, None, 2), ("c", 5, None, 1), (None, 1, 1, 1)], "url string, price int, mileage int, pos int")
    out = upsert.upsert(now, upsert.collapsed(batch, "url", ["pos"], ["price", "mileage"]), "url", ["price", "mileage"])
    assert {tuple(r) for r in out.collect()} == {("a", 7, 9, "x", False), ("b", 3, 4, "y", False), ("c", 5, None, None, True)}
    old = spark.createDataFrame([(1, "v1", "u1"), (1, "v2", "u2"), (2, "v3", "u3"), (1, None, "u9")], "dealership_id long, vin string, url string")
    new = spark.createDataFrame([(1, "v1", "u7"), (1, "v4", "u4")], "dealership_id long, vin string, url string")
    assert {tuple(r) for r in inventory.inventory_diff(old, new).collect()} == {(1, "v1", "kept"), (1, "v2", "sold"), (1, "v4", "new")}
    assert [r.url for r in inventory.moved(old, new).collect()] == ["u1"]


def test_partitions_and_filters(spark, tmp_path):
    df = spark.createDataFrame([("TX", 1), ("FL", 2)], "state string, n int")
    upsert.replace_partitions(df, str(tmp_path / "p"), "state")
    upsert.replace_partitions(spark.createDataFrame([("TX", 9)], "state string, n int"), str(tmp_path / "p"), "state")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("state", "n").collect()} == {("TX", 9), ("FL", 2)}
    cars = spark.createDataFrame([("Automated Manual", 0), ("6-Speed Manual", 5), ("CVT", None), (None, 7)], "transmission string, price int")
    for want, n in (("manual", 1), ("automatic", 2), ("other", 4)):
        rows = cars
        for c in search.conditions({"transmission": want, "price_max": 0}):
            rows = rows.where(c)
        assert rows.count() == n


def test_readers(spark, tmp_path):
    (tmp_path / "US.txt").write_text("US\t78664\tRound Rock\tTexas\tTX\t\t\t\t\t30.5\t-97.6\t4\nUS\tbad\nUS\t78664\tRound Rock\tTexas\tTX\t\t\t\t\t30.6\t-97.7\t4\nUS\t1\tx\ty\tz\t\t\t\t\tq\t1\t4\n")
    assert [tuple(r) for r in captured.zip_centres(spark, str(tmp_path / "US.txt")).collect()] == [("78664", 30.6, -97.7, "Round Rock", "TX")]
    page = "<table><tr><th>x</th></tr></table><table><tr><th>Dealer Name</th><th>City</th></tr><tr><td>A &amp; B</td><td>Miami</td></tr><tr><td></td><td>Q</td></tr></table>"
    assert [tuple(r) for r in captured.table_rows(spark.createDataFrame([(1, page), (2, None), (3, "<table></table>")], "id int, p string"), "id", "p", "dealer name").collect()] == [(1, {"DEALER NAME": "A & B", "CITY": "Miami"})]
    sheet = spark.createDataFrame([("A", " 1 Main ", None, "Active"), ("B", "2 Main", "Ste 1", "Expired")], "n string, a1 string, a2 string, status string")
    assert [tuple(r) for r in captured.sheet_rows(sheet, {"name": ["n"], "address": ["a1", "a2"]}, {"status": ["Active"]}).collect()] == [("A", "1 Main")]
    xml = spark.createDataFrame([("<loc>https://a/used/1?x=1&amp;y=2</loc><loc>https://a/blog</loc><loc>https://a/used/1?x=1&amp;y=2</loc>",)], "x string")
    assert xml.select(captured.sitemap_urls(F.col("x"), "used", "blog").alias("u")).first().u == ["https://a/used/1?x=1&y=2"]
    site = spark.createDataFrame([(1, "<a href='/inventory'>a</a><a href='/used-cars'>b</a><a href='/about'>c</a>")], "id int, page string")
    assert [r.url for r in captured.inventory_links(site, "id", "page").orderBy("rank").collect()] == ["/used-cars", "/inventory"]
    assert site.select(captured.absolute(F.lit("https://a.test/x/"), F.lit("../y")).alias("u"), captured.unescaped(F.lit("a&amp;b")).alias("t")).first() == ("https://a.test/y", "a&b")


def test_pages(spark):
    v = "1HGCM82633A004352"
    bodies = [
        f"""<script id="__NEXT_DATA__" type="application/json">{{"props":{{"list":[{{"vin":"{v}","make":"Honda","model":"Civic","price":9000}},{{"vin":"{v}","make":"Honda"}}]}}}}</script>""",
        f"""<div onclick="vehicleDetails($event, {{&quot;vin&quot;:&quot;{v}&quot;,&quot;year&quot;:2019}})">""", f"""x = [{{"id":1,"vin":"{v}","odometer":5}}]""", f"""<script>DDC.WS.state['ws-inv-data'] = {{"inventory":[{{"vin":"{v}","trim":"LX"}}]}};</script>""", "<html>nothing</html>", None, '<script type="application/ld+json">{broken</script>',
    ]
    rows = pages.page_listings(spark.createDataFrame(list(enumerate(bodies)), "id int, page string"), "id", "page").collect()
    assert sorted((r.id, r.extractor) for r in rows) == [(0, "next_data"), (1, "handlers"), (2, "inline"), (3, "state")] and {r.vin for r in rows} == {v}
    base = spark.createDataFrame([("a", None, 0), ("b", "w", 5)], "url string, vin string, mileage int")
    cards = spark.createDataFrame([("a", "z", 7), ("b", "q", 9)], "url string, vin string, mileage int")
    assert {tuple(r) for r in pages.enriched(base, cards, ["url"], ["vin", "mileage"]).select("url", "vin", "mileage").collect()} == {("a", "z", 7), ("b", "w", 5)}


def test_streams(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    os.makedirs(tmp_path / "in")
    os.symlink(f"{data}/events.parquet", tmp_path / "in" / "events.parquet")
    q = event_windows(read_stream(spark, str(tmp_path / "in"), events)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in event_windows(events).collect()} != set()
    kept = {"df": spark.createDataFrame([(-1, 1.0)], "user_id long, value double")}
    stream = read_stream(spark, str(tmp_path / "in"), events).select("user_id", "value", "ts", "event_id")

    def store(df, n):
        df.write.mode("overwrite").parquet(str(tmp_path / f"t{n}"))
        kept["df"] = spark.read.parquet(str(tmp_path / f"t{n}"))

    apply_batches(stream, "user_id", ["ts", "event_id"], ["value"], lambda: kept["df"], store, str(tmp_path / "cp")).awaitTermination(120)
    assert kept["df"].count() == events.select("user_id").distinct().count() + 1
