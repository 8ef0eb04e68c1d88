"""Wiki markup, nested, unclosed and odd."""

import time

import pytest
from pyspark.sql import functions as F

from lexiloom.sources import frequency_lists, wikitext

CASES = [
    ("plain", "plain"),
    ("", ""),
    ("== History ==\ntext", "History\ntext"),
    ("'''Bold''' and ''it''", "Bold and it"),
    ("[[Target|a link]] and [[Plain]].", "a link and Plain."),
    ("[[File:x.png|thumb|cap [[inner|shown]] end]]", "cap shown end"),
    ("a<ref name=\"x\">cite {{t|[[l]]}}</ref>b<ref name=y/>c", "abc"),
    ("{{A|{{B|c}}|d}}e{{F}}", "e"),
    ("{|\n| a {{b|}}\n{|\n| c\n|}\n|}\nafter", "after"),
    ("x<!-- gone [[ -->y", "xy"),
    ("[http://e.org site here] or [http://e.org].", "site here or ."),
    ("* one\n## two\n:: three", "one\ntwo\nthree"),
    ("a\n\n\n\nb<br/>", "a\n\nb"),
    ("{{never closed [[link|kept]]", "{{never closed kept"),
    ("closed }} never ]] opened\n|} ] {| |}", "closed }} never ]] opened\n|} ] {| |}"),
    ("[[a {{b]] c}}", "a {{b c}}"),
    ("<!-- open", "<!-- open"),
    ("<ref>open", "open"),
    ("2 < 3 and [x]", "2 < 3 and [x]"),
    ("=", "="),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_page(page, want):
    assert wikitext.plain_wikitext(page) == want


def test_long_and_deep_pages_take_linear_time():
    began = time.perf_counter()
    assert wikitext.plain_wikitext("{{" * 100_000 + "x" + "}}" * 100_000) == ""
    assert len(wikitext.plain_wikitext("{{" * 100_000 + "x")) == 200_001
    assert len(wikitext.plain_wikitext("[[a " * 100_000 + "x" + "]]" * 100_000)) == 200_001
    assert len(wikitext.plain_wikitext("<!--" * 100_000)) == 400_000
    assert wikitext.plain_wikitext("[[a|b]] " * 200_000) == ("b " * 200_000).strip()
    assert time.perf_counter() - began < 20


def test_column(spark):
    df = spark.createDataFrame([(1, "[[a]]"), (2, None), (3, "")], "id int, page string")
    assert {r["id"]: r["x"] for r in df.select("id", wikitext.strip_wikitext(F.col("page")).alias("x")).collect()} == {1: "a", 2: None, 3: ""}


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nTall\n\n old man \ntall\n")
    assert frequency_lists.read_word_list(spark, str(tmp_path / "w.txt")) == ["old man", "tall"]
