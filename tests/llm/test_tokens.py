import array
import json
import random

import pytest
from tokenizers import Tokenizer

from quarrion.llm.tokens import VOCABULARY, TextEncoder, decoded, round_trip, token_ids


@pytest.fixture(scope="module")
def known():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_random_texts(known):
    with open(VOCABULARY) as f:
        encoder = TextEncoder(json.load(f))
    r = random.Random(3)
    letters = "aabzsT 1२,.'\n\r\t\x1c\x85\xa0　é漢😀-<|endoftext|>  "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 50))) for _ in range(800)]
    for x in [*texts, "a" * 3000, " " * 99 + "x", "<|endoftext|>", "aaaaaaa", "00:01,5\n\n\n7 \n", "don't we'll"]:
        ids = array.array("i", encoder(x)).tolist()
        assert ids == known(x), repr(x)
        assert encoder.machine.decode(ids).decode() == x


def test_documents(spark, data, known):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.ids for r in token_ids(docs.selectExpr("*", "1 as ids")).collect()}
    assert got == {i: known(t) if t else [] for i, t in texts.items()}
    assert round_trip(docs).where("not same").count() == 0


def test_null_empty_repeats(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "hi"), (3, "hi")], "doc_id long, text string")
    ids = token_ids(docs)
    assert sorted((r.doc_id, r.ids) for r in ids.collect()) == [(1, []), (2, []), (3, [5303]), (3, [5303])]
    assert {r.doc_id: r.text for r in decoded(ids).collect()} == {1: "", 2: "", 3: "hi"}
    assert token_ids(docs.limit(0)).count() == 0
