from quarrion.llm.cues import cues
from quarrion.llm.residue import residue

SRT = "1\n00:00:01,000 --> 00:00:02,000\n{}\n\n2\n00:00:03,000 --> 00:00:04,000\nRun!\n\n"


def test_cues():
    assert cues(SRT.format("<i>Hold this.\nDon't ask.</i>")) == ["Hold this. Don't ask.", "Run!"]
    assert cues("{1}{20}One|two\n{30}{40}{\\an8}Three\n") == ["One two", "Three"]
    assert cues('[{"start":1,"end":2,"text":"A\\nb"}]') == ["A b"]
    assert cues("WEBVTT\n\n00:01.000-->00:02.000\nHi\n") == ["WEBVTT", "Hi"]


def test_residue(spark):
    bad = ["Your text goes here", "{{ show }}: Hi", "Previously on %title%...", "undefined", "[TODO: translate cue 7]", "Lorem ipsum dolor sit amet,", "xxxx xxx xxxxxx", "&lt;speaker&gt;", "Escriba aquÃ\xad el subtÃ\xadtulo", "Texte à venir", "HTTP 503 Service Temporarily Unavailable"]
    good = ["They printed lorem ipsum\non every brochure!", "It’s undefined, professor.", "He left __ blank. Just a blank.", "{\\an8}Run!", "<i>Yeah.</i>", "$37.50 each", "You have to enable JavaScript first,\nmy nephew told me.", "Error 404 again.\nThe intern pulled the plug.", "[NAME REDACTED] was seen", "And the letter began 'insert name here'."]
    whole = ['{"status":429,"error":"internal","detail":"no subtitle for id 3"}', "<!DOCTYPE html>\n<html><head><title>404 Not Found</title></head>"]
    rows = [(i, SRT.format(t)) for i, t in enumerate(bad)] + [(50 + i, t) for i, t in enumerate(whole)] + [(100 + i, SRT.format(t)) for i, t in enumerate(good)] + [(200, None), (201, ""), (202, " \n"), (203, "word " * 30000), (0, SRT.format(bad[0]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "'x' as cue")
    assert {r.doc_id for r in residue(docs).collect()} == set(range(len(bad))) | {50, 51}
    assert residue(docs.limit(0)).count() == 0
