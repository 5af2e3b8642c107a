from quarrion.llm.residue import residue


def test_message_among_many_cues_of_its_path(spark):
    """The verdict on a message does not change with the other cues that share its path."""
    bad = "We could not find the page you requested."
    others = [f"We could not {v} the {n} they {w}." for v, n, w in zip("see hear lift move hold cross open close reach leave paint build carry bury sell".split(), "boat door hill lamp rope barn gate road well mill kite sled drum harp loom".split(), "wanted praised hid left sold built burned loved feared lost drew broke found mended kept".split())]
    assert {len(c.split()) for c in [bad, *others]} == {8}
    docs = spark.createDataFrame([(i, c) for i, c in enumerate([bad, *others])], "doc_id long, text string")
    assert {tuple(r) for r in residue(docs).collect()} == {(0, "message")} == {tuple(r) for r in residue(docs.limit(1)).collect()}
