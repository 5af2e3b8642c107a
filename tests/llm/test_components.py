import random

import pytest

from quarrion.llm.components import connected_components, listing_groups


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    parts = {}
    for x in list(root):
        parts.setdefault(find(x), set()).add(x)
    return {frozenset(p) for p in parts.values()}


def shapes():
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(40)]
    ring = [(100 + i, 100 + (i + 1) % 13) for i in range(13)]
    hub = [(200, 201 + i) for i in range(30)]
    dense = [(300 + r.randrange(20), 300 + r.randrange(20)) for _ in range(80)]
    tree = [(400 + i, 400 + r.randrange(i)) for i in range(1, 60)]
    theta = [(500, 501), (501, 502), (500, 503), (503, 502), (500, 504), (504, 505), (505, 502)]
    mess = [(600 + r.randrange(90), 600 + r.randrange(90)) for _ in range(70)]
    return {"chain": chain, "ring": ring, "two": [(1, 2)], "all": chain + ring + hub + dense + tree + theta + mess + [(7, 7), (None, 3), (1, 0)]}


@pytest.mark.parametrize("name", ["two", "ring", "all"])
def test_components(spark, name):
    edges = shapes()[name]
    got = {}
    for x, root in connected_components(spark.createDataFrame(edges, "u long, v long")).collect():
        got.setdefault(root, set()).add(x)
    assert {frozenset(p) for p in got.values()} == brute(edges)


def test_listing_groups(spark):
    listings = spark.createDataFrame(
        [(1, None, "7Z-1234567890 12345"), (2, None, "7z123456789012345"), (3, 9, None), (4, 9, ""), (5, None, "SHORT"), (6, None, "SHORT"), (7, None, None), (8, None, None), (9, None, None)],
        "id long, duplicate_group_id long, vin string",
    ).selectExpr("*", "'x' as u", "'y' as key")
    pairs = spark.createDataFrame(
        [(1, 2, 3, 1, "2020-01-01"), (2, 3, 2, 0, "2020-02-01"), (3, 8, 7, 0, "2020-01-01"), (4, 7, 8, 1, "2020-03-01"), (5, 9, 9, 1, "2020-03-01"), (6, 9, None, 1, "2020-03-01")],
        "pair_id long, id_a long, id_b long, is_match int, decided_at string",
    )
    got = {r.id: r.group_id for r in listing_groups(listings, pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 7: 7, 8: 7}
    assert listing_groups(listings.limit(0), pairs.limit(0)).count() == 0
