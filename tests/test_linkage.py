import itertools
import random

from quarrion.functions.similarity import token_set, token_sort
from quarrion.operators import dedup, linkage
from quarrion.plans import pipelines

SCHEMA = "id long, vin string, make string, model string, trim string, year int, mileage int, price int, is_active int"


def alike(a, b):
    """G2 for two rows as dicts."""
    va, vb = (a["vin"] or "").strip().upper(), (b["vin"] or "").strip().upper()
    if a["year"] != b["year"] or va and vb and va != vb:
        return False
    if any(token_sort(a[c].lower(), b[c].lower()) < 85 for c in ("make", "model")):
        return False
    if a["trim"] and b["trim"] and token_set(a["trim"].lower(), b["trim"].lower()) < 60:
        return False
    given = [c for c in ("mileage", "price") if a[c] and b[c]]
    return bool(given) and all(abs(a[c] - b[c]) <= 500 for c in given)


def listings(n):
    r = random.Random(7)
    near = lambda: r.choice([None, 0, *range(10_000, 12_500, 250), 10_501, 11_499])
    models = ["Mistral", "Mitsral", "Grand Cherokee", "Cherokee Grand", "Cherokee", "Stratham XL", "XL Stratham"]
    return [(i, r.choice([None, None, "", "V1", " v1", "V2"]), r.choice(["Honda", "HONDA", "Hondaa"]), r.choice(models), r.choice([None, "", "LX", "LX Sport", "Touring"]), r.choice([2019, 2020]), near(), near(), 1) for i in range(n)]


def test_registered_pairs_against_brute_force(spark, tmp_path):
    rows = listings(260)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "listings.parquet"))
    cars = [dict(zip(("id", "vin", "make", "model", "trim", "year", "mileage", "price"), x)) for x in rows]
    want = sorted((a["id"], b["id"]) for a, b in itertools.combinations(cars, 2) if alike(a, b))
    got = pipelines.QUERIES["g2_fuzzy_pairs"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 100
    grouped = {x.id for x in pipelines.QUERIES["g3_guarded_groups"](spark, str(tmp_path)).collect()}
    # rows that share a vin as written are grouped by it and not compared
    held = [c["vin"] for c in cars]
    alone = {c["id"] for c in cars if not c["vin"] or held.count(c["vin"]) == 1}
    assert grouped and grouped <= {i for a, b in want if {a, b} <= alone for i in (a, b)}


def in_order(pairs, vins):
    """Pairs joined one by one, unless that would put two vins into a group."""
    up = {i: i for p in pairs for i in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    held = {i: vins[i] for i in up}
    for a, b in sorted(pairs):
        x, y = sorted((top(a), top(b)))
        if x != y and not (held[x] and held[y] and held[x] != held[y]):
            up[y], held[x] = x, held[x] or held[y]
    groups = {i: top(i) for i in up}
    return {(i, g) for i, g in groups.items() if list(groups.values()).count(g) > 1}


def test_guarded_groups_in_one_piece_and_by_rounds(spark):
    """Both ways give what the order gives: chains, hubs, rings and random pairs, with none, one and several vins."""
    r = random.Random(11)
    pairs = {(i, i + 1) for i in range(12)} | {(20, i) for i in range(21, 30)} | {(40 + i, 40 + (i + 1) % 7) for i in range(7)} | {tuple(sorted(r.sample(range(60, 90), 2))) for _ in range(45)}
    pairs = {tuple(sorted(p)) for p in pairs}
    vins = {i: r.choice(["", "", "V1", "V2", "V3"]) if i < 20 or i >= 40 else r.choice(["", "V9"]) for p in pairs for i in p}
    a = spark.createDataFrame(sorted(pairs), "id_a long, id_b long")
    rows = spark.createDataFrame([(i, v or None) for i, v in vins.items()], "id long, vin string")
    for most in (linkage.MOST_PAIRS, 0, 20):
        assert {tuple(x) for x in linkage.guarded_groups(a, rows, [], most).select("id", "group_id").collect()} == in_order(pairs, vins), most


def test_deduplicated(spark):
    """Equal vins first, a shared middle row in one group only, a leaked payment never canonical, the nearer of equal prices first."""
    car = lambda i, vin, price, miles=42000, near=None: (i, vin, "Honda", "Civic", "LX", 2019, miles, price, near)
    rows = spark.createDataFrame([car(1, "V1", 650), car(2, "V1", 15000), car(3, "A", 18900, 1000), car(4, None, 18950, 1100), car(5, "B", 19000, 1200), car(6, "C", 30000, 70000, 20.0), car(7, None, 30000, 70000, 5.0), car(8, None, 30000, 90000)], "id long, vin string, make string, model string, trim string, year int, mileage int, price int, distance_mi double")
    got = {x.id: (x.group_id, x.match_method, x.is_duplicate) for x in dedup.deduplicated(rows.selectExpr("*", "7 as rank", "1 as is_duplicate"), ["year"]).collect()}
    assert got == {1: (1, "vin", 1), 2: (1, "vin", 0), 3: (3, "fuzzy", 0), 4: (3, "fuzzy", 1), 6: (6, "fuzzy", 1), 7: (6, "fuzzy", 0)}
    assert dedup.deduplicated(rows.limit(0), ["year"]).count() == 0
