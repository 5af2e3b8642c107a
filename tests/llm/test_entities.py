import itertools
import random

from pyspark.sql import functions as F

from quarrion.llm.entities import RADIUS, SURE, close_pairs, matched, name_parts, page_of, vector


def test_names_and_pages():
    assert name_parts("AUTO SALES OF SELVICK VALLEY INC", []) == name_parts("Selvick Valley Auto Sales - Harlholm", ["harlholm"])
    assert name_parts("Welcome to Halmock Pioneer | Used Cars in Dunton, TX", [])[0] == "halmock pioneer" and name_parts(None, []) == ("", "")
    assert page_of("HTTPS://WWW.a.test/x/?utm_source=dir", None) == "a.test/x" and page_of(None, "info@a.test") == "a.test" and page_of("none", "none") == ""


def test_search_is_exact(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        base = "".join(r.choice("abcdefgh") for _ in range(9))
        for j in range(3):
            name = base if j == 0 else "".join(c if r.random() > 0.12 else r.choice("xyz") for c in base)
            rows.append((f"k{i}_{j}", f"s{j}", ["p"], name, "", *vector(name), 0, 0, 0, 0, "", "", ""))
    df = spark.createDataFrame(rows, "key string, source string, places array<string>, core string, core2 string, n1 long, n2 long, m1 long, m2 long, a1 long, a2 long, number string, phone string, page string")
    got = {tuple(x) for x in close_pairs(df).collect()}
    m = (1 << 64) - 1
    bits = lambda a, b: bin((a[5] ^ b[5]) & m).count("1") + bin((a[6] ^ b[6]) & m).count("1")
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and bits(a, b) <= RADIUS}
    near = {k for k in got if k not in want}
    assert want <= got and want and all(bits(*(next(x for x in rows if x[0] == k) for k in p)) == RADIUS + 1 for p in near)


def tables(spark):
    zips = spark.createDataFrame([("70001", 30.0, -95.0, "Ivesholm", "TX"), ("70003", 31.0, -95.0, "Dunton", "TX")], "zip string, lat double, lng double, city string, state string")
    cols = "id long, name string, address string, city string, state string, zip string, phone string, website string"
    tx = spark.createDataFrame([(1, "Tarby Eastern Cars", "12 Oak St", "Ivesholm", "TX", "70001", "(292) 555-1234", "https://www.tarby.test/"), (1, "Tarby Eastern Cars", "12 Oak St", "Ivesholm", "TX", "70001", "(292) 555-1234", "https://www.tarby.test/"), (2, "Other Motors", "12 Oak St", "Ivesholm", "TX", "70001", None, None), (3, None, None, None, None, None, None, None)], cols)
    de = spark.createDataFrame([(5, "Cars at Tarby Eastern", "88 Elm Ave", "Ivesholm", "TX", "70001", "292.555.1234", "tarby.test"), (6, "Tarby Eastern Cars", "4 Fir Rd", "Dunton", "TX", "70003", "292 555 9999", "tarby.test/locations/dunton")], cols)
    st = spark.createDataFrame([(7, "QX HOLDINGS LLC", "", "12 Oak Street", "Ivesholm", "TX", "70001", "2925551234", "none")], "id long, name string, dba string, address string, city string, state string, zip string, phone string, email string")
    osm = spark.createDataFrame([(9, 30.01, -95.01, None, {"name": "tarby estern cars"}), (8, None, None, None, None)], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    return {"tx_directory": tx, "dealerships": de.withColumn("key", F.lit("x")), "state_registry": st}, osm, zips


def test_matched(spark):
    sources, osm, zips = tables(spark)
    got = {(r.key_a, r.key_b): r.confidence for r in matched(sources, osm, zips).where(F.col("confidence") >= SURE).collect()}
    assert {("dealerships:5", "tx_directory:1"), ("state_registry:7", "tx_directory:1"), ("osm_sample:9", "tx_directory:1")} <= set(got)
    assert not any("dealerships:6" in k or "tx_directory:2" in k for k in got) and all(0 <= c <= 1 for c in got.values())
    assert matched({k: v.limit(0) for k, v in sources.items()}, osm.limit(0), zips).count() == 0


def test_calibration(spark):
    """Confidences against built truth: what is called sure is right, what is called unlikely is not, and they rise with the share of true pairs."""
    r = random.Random(7)
    zips = spark.createDataFrame([(f"7{i:04d}", 30.0 + i, -95.0, f"Town{chr(97 + i)}ville", "TX") for i in range(6)], "zip string, lat double, lng double, city string, state string")
    first, last = "tarby halmock selvick pioneer quarnby ostler winfrey bramden".split(), "eastern crown valley summit harbor meridian".split()
    made = {n: [] for n in ("tx_directory", "dealerships")}
    for e in range(240):
        z = r.randrange(6)
        name, phone, street = f"{r.choice(first)} {r.choice(last)}", f"555{e:07d}", f"{100 + e} {r.choice(first)}stead St"
        for n in made:
            shown = name if r.random() > 0.2 else name.replace("e", "", 1)
            made[n].append((e, shown, street if r.random() > 0.3 else None, f"Town{chr(97 + z)}ville", "TX", f"7{z:04d}", phone if r.random() > 0.4 else (f"556{e:07d}" if r.random() > 0.8 else None), f"{name.replace(' ', '')}{e}.test" if r.random() > 0.5 else None))
    cols = "id long, name string, address string, city string, state string, zip string, phone string, website string"
    tables = {n: spark.createDataFrame(x, cols) for n, x in made.items()}
    osm = spark.createDataFrame([], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = [(x.confidence, x.key_a.split(":")[1] == x.key_b.split(":")[1]) for x in matched(tables, osm, zips).collect()]
    share = lambda low, high: (lambda x: sum(x) / len(x) if x else None)([t for c, t in got if low <= c < high])
    assert share(SURE, 1.1) >= 0.9 and share(0, 0.2) <= 0.1
    bins = [s for s in (share(k / 10, k / 10 + 0.1 + (k == 9)) for k in range(10)) if s is not None]
    assert bins[-1] >= 0.95 and bins[0] <= 0.1
