import random

import numpy as np

from quarrion.llm.leaks import Index, coverage, leaked, spoken, window_hashes

WORDS = "harbor lantern census treaty glacier orchard pendulum sonata weavers magistrates canal winter copper brittle compass theorem isotope granary ferrymen archive".split()


def passage(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(n))


def srt(words):
    lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    return "".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i + 1:02d},000\n{x}\n\n" for i, x in enumerate(lines, 1))


def test_leaked(spark):
    r = random.Random(4)
    items = {i: passage(r, 40) for i in range(6)}
    whole, half, short, noisy = items[0].split(), items[1].split()[15:38], items[2].split()[:12], [w.replace("m", "rn").replace("l", "I") for w in items[3].split()]
    noisy[7], noisy[20] = "other", "thing"
    broken = items[4].split()[:20] + "[door creaks] Get your ticket at the kiosk".split() + items[4].split()[20:]
    texts = [whole, half, short, noisy, broken, passage(r, 60).split()]
    rows = [(i, srt(passage(r, 24).split() + t + passage(r, 24).split())) for i, t in enumerate(texts)] + [(10, None), (11, ""), (12, "x" * 200_000), (0, srt(whole))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as item_id")
    evals = spark.createDataFrame([(i, t) for i, t in items.items()] + [(90, None), (91, "")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    assert {tuple(x) for x in leaked(docs, evals).select("doc_id", "item_id").collect()} == {(0, 0), (1, 1), (3, 3), (4, 4)}
    assert leaked(docs.limit(0), evals).count() == 0 and leaked(docs, evals.limit(0)).count() == 0


def test_recall_against_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    evals = spark.read.parquet(f"{data}/eval_items.parquet")
    got = {(x.doc_id, x.item_id) for x in leaked(docs, evals).collect()}
    texts = {x.doc_id: spoken(x.text) for x in docs.collect() if x.text}
    items = {x.item_id: spoken(x.text) for x in evals.collect()}
    # a pair that shares under a fifth of an item's words cannot cover half of it
    pairs = [(d, i) for d, t in texts.items() for i, w in items.items() if len(set(w) & set(t)) > 0.2 * len(set(w))]
    want = {(d, i) for d, i in pairs if coverage(texts[d], items[i]) >= 0.55}
    assert want and len(got & want) >= 0.9 * len(want)


def test_close_windows_share_hashes():
    r = np.random.default_rng(1)
    index = Index()
    a = r.integers(1, 27, 40, dtype=np.uint8)
    b = np.concatenate([a[:30], a[31:], [np.uint8(3)]]).astype(np.uint8)
    pad = np.zeros(80, np.uint8)
    h = [window_hashes(np.concatenate([x, pad]), np.array([0]), index)[:, 0] for x in (a, b, r.integers(1, 27, 40, dtype=np.uint8))]
    assert (h[0] == h[1]).any() and not (h[0] == h[2]).any()
