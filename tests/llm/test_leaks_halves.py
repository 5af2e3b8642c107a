import random

import pytest

from quarrion.llm.leaks import leaked, spoken


@pytest.mark.parametrize("line", [0, 9])
def test_exact_halves(spark, data, line):
    """Each item quoted at exactly half of its words (rounded up) with 0, 1 and 2 altered words, also with a line put between.

    The truth is the construction and not the operator's own verifier.
    """
    evals = spark.read.parquet(f"{data}/eval_items.parquet")
    items = {x.item_id: spoken(x.text) for x in evals.collect()}
    r = random.Random(3)
    words = [w for t in items.values() for w in t]
    texts, want = {}, {0: set(), 1: set(), 2: set()}
    for altered in want:
        for i, w in items.items():
            n = (len(w) + 1) // 2
            a = r.randrange(len(w) - n + 1)
            half = w[a : a + n]
            for p in r.sample(range(1, n - 1), altered):
                half[p] = r.choice(words)
            half[n // 2 : n // 2] = [r.choice(words) for _ in range(line)]
            doc = 1000 * altered + i
            texts[doc] = " ".join(r.choices(words, k=60) + half + r.choices(words, k=60))
            want[altered].add((doc, i))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {tuple(x) for x in leaked(docs, evals).select("doc_id", "item_id").collect()}
    for altered, pairs in want.items():
        assert len(pairs & got) >= 0.95 * len(pairs), (altered, len(pairs & got), len(pairs))
    assert len(got - set().union(*want.values())) <= 0.02 * len(got)


def test_sentence_of_the_same_pattern(spark):
    """A sentence with every fifth word another is no quotation."""
    item = "a tall orchard weighs nine stone and the turbine twelve if the archivists of porthane strengthen both what is left of the lunar calendar today because nobody ever asked for anything else".split()
    other = [w if k % 5 else "weavers" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "\n".join(["well then"] * 9 + [" ".join(item)])), (2, " ".join(other))], "doc_id long, text string")
    assert {tuple(x) for x in leaked(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).select("doc_id", "item_id").collect()} == {(1, 5)}
