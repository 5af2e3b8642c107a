import itertools

import pytest
from pyspark.sql import functions as F

from quarrion.llm.addresses import assigned, deletions, distance, parse, parts_agree, same_location

CASES = [
    ("6362 TX-1400 E", "6362 sh1400 numbered e "), ("ST HWY 1300 S, 8205", "8205 sh1300 numbered s "), ("7029, Granitestead Pky (#130)", "7029 granitestead parkway  130"), ("NO. ORCHARDCREST RD., 3267", "3267 orchardcrest road n "),
    ("# 100, 638 Kernelbury Boulevard So. Quillcroft", "638 kernelbury boulevard s 100"), ("Located  at 7268 No. Yarrowview Court", "7268 yarrowview court n "), ("1163 West Eldergate, Caldholm, TX 72021", "1163 eldergate  w "), ("5084 FarmtoMarketRoad2900", "5084 fm2900 numbered  "),
    ("Ste. 200, 3868 Hwy US 400 E.", "3868 us400 numbered e 200"), ("4501 N. Russet View Terrace", "4501 russetview terrace n "),
]


@pytest.mark.parametrize("text,want", CASES)
def test_parse(text, want):
    p = parse(text, ("Quillcroft", "Caldholm"))
    assert " ".join(p[k] for k in ("number", "street", "kind", "side", "unit")) == want


def test_parse_unusable():
    assert parse(None) is None and parse("") is None and parse("Call for address") is None and parse("12") is None and parse("9" * 5000) is None


def test_deletions(spark):
    got = spark.createDataFrame([("jackalewll",), ("jackalwell",), ("fm300",), ("ab",)], "w string").select(deletions(F.col("w")).alias("one"), deletions(F.col("w"), 2).alias("two")).collect()
    assert set(got[0].one) & set(got[1].one) and got[2].one == got[2].two == ["fm300"] and set(got[3].two) == {"ab", "a", "b", ""}


def test_assignment():
    assert assigned("mill oak", "mill oak") == 0 and assigned("mill oak", "mil oak") == 1 and assigned("aok mill", "mill oak") == 1 and assigned("oakmill", "mill oak") > 3
    a = parse("12 Mill Oak St")
    assert parts_agree(a, parse("12 Oak Mill St")) and parts_agree(a, parse("12 Oak Mil Street")) and not parts_agree(a, parse("12 Oak Hill Top St"))


def test_order_and_neighbours(spark):
    """Words in another order meet; a record whose postcode is the neighbouring place's is found where its city says; a far one is not."""
    zips = spark.createDataFrame([("70001", 30.0, -95.0, "Ivesholm", "TX"), ("70002", 30.2, -95.1, "Dunton", "TX"), ("70003", 35.0, -95.0, "Farley", "TX")], "zip string, lat double, lng double, city string, state string")
    rows = [(1, "12 Mill Oak St", "Ivesholm", "TX", "70001"), (2, "12 Oak Mill St", "Ivesholm", "TX", "70001"), (3, "12 Mil Oak St", "Ivesholm", "TX", "70002"), (4, "12 Oak Mill St", "Ivesholm", "TX", "70003"), (5, "12 Oak Mill St", "Dunton", "TX", None), (6, "44 Elm Ct", "Ivesholm", "TX", "70002"), (7, "44 Elm Ct", "Ivesholm", "TX", "70001"), (8, "45 Elm Ct", "Ivesholm", "TX", "70002"), (9, "45 Elm Ct", "Dunton", "TX", "70002")]
    df = spark.createDataFrame(rows, "id long, address string, city string, state string, zip string")
    got = {tuple(int(k.split(":")[1]) for k in r) for r in same_location({"t": df}, zips).collect()}
    assert got == {(1, 2), (3, 5), (6, 7), (8, 9)} or got == {(1, 2), (1, 3), (2, 3), (6, 7), (8, 9)}, got


def test_index_and_vetoes():
    assert distance("abcd", "acbd") == 1 and distance("", "ab") == 2
    a = parse("12 Oak Mill St #4")
    assert parts_agree(a, parse("12 Oakmil Street")) and not parts_agree(a, parse("12 Oakmill St #5")) and not parts_agree(a, parse("12 Oakmill Ave")) and not parts_agree(a, parse("13 Oakmill St"))


def test_same_location(spark):
    zips = spark.createDataFrame([("70001", 30.0, -95.0, "Ivesholm", "TX"), ("70002", 30.1, -95.0, "Ivesholm", "TX"), ("70003", 31.0, -95.0, "Dunton", "TX")], "zip string, lat double, lng double, city string, state string")
    rows = [
        (1, "12 N Jackalwell St", "Ivesholm", "TX", "70001"), (2, "12 north jackalewll street", "Ivesholm", "TX", "70002-1234"), (3, "Jackalwell, 12", "Iveshohm", "TX", None), (4, "12 Jackalwell St S", "Ivesholm", "TX", "70001"),
        (10, "5 Oak Ave #1", "Dunton", "TX", "70003"), (11, "5 Oak Avenue Ste 2", "Dunton", "TX", "70003"), (12, "5 Oak Ave", "Dunton", "TX", None), (13, "5 Oak Av Unit 1", None, "TX", "70003"),
        (20, "9 Elm Ct, Suite 7", "Dunton", "TX", "70003"), (21, "9 Elm Court", "Dunton", "TX", "70003"), (22, "9 Elm Dr", "Dunton", "TX", "70003"), (30, None, "Dunton", "TX", "70003"), (31, "", None, None, None), (32, "Call for address", "Dunton", "TX", "70003"),
    ]
    df = spark.createDataFrame(rows, "id long, address string, city string, state string, zip string").selectExpr("*", "'x' as key", "1 as number", "2 as place")
    half = {"dealerships": df.where("id % 2 = 0"), "tx_directory": df.where("id % 2 = 1").union(df.where("id = 1"))}
    got = {tuple(int(k.split(":")[1]) for k in r) for r in same_location(half, zips).collect()}
    groups = [{1, 2}, {10, 13}, {20, 21}]
    assert {tuple(sorted(p)) for p in got} == {p for g in groups for p in itertools.combinations(sorted(g), 2)}
    assert same_location({k: v.limit(0) for k, v in half.items()}, zips).count() == 0
