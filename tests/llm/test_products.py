import math
import random

from quarrion.llm.products import name_pieces, near_names, offered_versions, wordings

ROWS = [
    (1, "Norvane", "Ultra 2", "SE", "AWD", "1.2 L", 95), (2, "Norvane", "Ultra 2", "SE", "RWD", "1.2 L", 95), (3, "Norvane", "Ultra 2", "Premium Plus", "AWD", "2.4 L", 201), (4, "Norvane", "Ultra 2", "Premium", "AWD", "2.4 L", 201),
    (5, "Granger Motor", "Lumen", "SX", "FWD", "5.0 L", 395), (6, "Granger Motor", "Lumen", "SX", "AWD", "1.6 L", 147), (7, "Tessimo", "Nectar", "S", "RWD", "3.5 L", 310), (8, "Tessimo", "Tracer GT", "Limited", "RWD", "3.5 L", 310),
]
NAMES = "version_id int, make string, model string, trim string, drivetrain string, engine string, power_hp int, body string"
CASES = [
    (("NORVANE", "Ultra 2", "SE all-wheel drive"), 1), (("Norvne", "Ultra2 Prem. Plus", "certified"), 3), (("Norvane", "Ultra 2", "SE"), None), ((None, "Norvane Ultra 2", "2WD SE premium sound"), 2), (("GMtr", "lumen", "SX 5,0 L limited offer"), 5), (("Grenger Motor", "LUMEN", "SX / 4x4"), 6),
    (("Tesimo", "Netcar", "S 3498 ccm"), 7), (("Tessimo", "Nectar", "Police Pkg"), None), (("Tessimo", "Nectar", "S 2.0 L"), None), (("Norvane", "Ultra 3", "SE AWD"), None), (("Fremd", "Nectar", "S"), None), (("Granger Motor", "Lumen", "147hp SX"), 6), (("Tessimo", "tracer gt", "LIMITED 228 kW"), None), (("Tessimo", "tracer gt", "LIMITED 231 kW"), 8), ((None, None, None), None),
]


def test_offered_versions(spark):
    versions = spark.createDataFrame([(*r, "Sedan") for r in ROWS] + [(9, None, None, None, None, None, None, None), (None, "Norvane", "Ultra 2", "SE", "AWD", "1.2 L", 95, None)], NAMES).selectExpr("*", "1 as name", "'x' as w")
    listings = spark.createDataFrame([(i, *w) for i, (w, _) in enumerate(CASES)] + [(0, *CASES[0][0]), (900, "x" * 50_000, "", " "), (None, *CASES[0][0])], "id long, make string, model string, trim string").selectExpr("*", "1 as version_id", "'y' as name")
    got = {tuple(r) for r in offered_versions(listings, versions).collect()}
    assert got == {(i, v) for i, (_, v) in enumerate(CASES) if v}
    assert offered_versions(listings.limit(0), versions).count() == 0 and offered_versions(listings, versions.limit(0)).count() == 0


def test_wordings(spark):
    df = spark.createDataFrame([("Norvane", "Ultra 2", "SE 4x4 150 PS 1,5 L Sedan limited offer"), (None, None, None), ("", "", "FWD RWD 1998ccm")], "make string, model string, trim string")
    got = {r.make: (r.words, r.drives, r.litres, round(r.power, 1) if r.power else None, r.says_make) for r in wordings(df).collect()}
    assert got == {"Norvane": (["norvane", "ultra", "2", "se"], 1, 1.5, 147.9, True), None: ([], None, None, None, False), "": ([], 0, 2.0, None, False)}


def _pieces(w):
    w = f"^{w}$"
    return {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}


def _edits(a, b):
    """Edits with neighbouring letters exchanged as one."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_near_names_against_all_pairs(spark):
    """The blocked search gives the cosines of all pairs, and every word with one edit of a name is found."""
    r = random.Random(4)
    names = sorted({"".join(r.choice("abcdeilnorst") for _ in range(r.randrange(4, 11))) + r.choice(["", "", "7"]) for _ in range(40)})
    words = set()
    for n in names:
        i = r.randrange(len(n) - 2)
        words |= {n[:i] + n[i + 1 :], n[:i] + "x" + n[i:], n[:i] + n[i + 1] + n[i] + n[i + 2 :], n[::-1]}
    words = sorted(words - set(names))
    got = {(x.w, x.name_): x.cosine for x in near_names(spark.createDataFrame([(w,) for w in words], "w string"), *name_pieces(spark.createDataFrame([(n, "model") for n in names], "name string, kind string")), "model").collect()}
    df = {}
    for n in names:
        for g in _pieces(n):
            df[g] = df.get(g, 0) + 1
    weight = lambda g: math.log(1 + len(names) / df[g]) if g in df else math.log(1 + len(names))
    norm = lambda x: math.sqrt(sum(weight(g) ** 2 for g in _pieces(x)))
    digits = lambda x: "".join(c for c in x if c.isdigit())
    want = {}
    for w in words:
        for n in names:
            c = sum(weight(g) ** 2 for g in _pieces(w) & _pieces(n)) / norm(w) / norm(n)
            if c >= 0.2 and digits(w) == digits(n) and _edits(w, n) <= 1 + (min(len(w), len(n)) >= 8) and abs(len(w) - len(n)) <= 2:
                want[w, n] = c
    lost = {k for k in want if k not in got}
    assert len(lost) <= 0.03 * len(want) and all(_edits(*k) == 2 for k in lost)  # an edit beside an exchange is three edits to Levenshtein
    assert all(abs(got[k] - want[k]) < 1e-9 for k in set(want) - lost) and len(set(got) - set(want)) <= 0.03 * len(want)
