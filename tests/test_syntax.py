"""Grammar patterns on hand-parsed sentences, with heads looked up by join and brought along."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tokens import annotated
from lexiloom.operators import concordance, syntax

SCHEMA = "doc_id bigint, sentence_idx int, token_idx int, text string, lemma string, pos string, morph string, dep_head int, dep_rel string"
PARSED = [
    (1, 0, 0, "letters", "letter", "NOUN", None, 3, "nsubj:pass"),
    (1, 0, 1, "were", "be", "AUX", "Tense=Past", 3, "aux:pass"),
    (1, 0, 2, "sent", "send", "VERB", "Tense=Past|VerbForm=Part", 0, "root"),
    (1, 1, 0, "we", "we", "PRON", None, 4, "nsubj"),
    (1, 1, 1, "must", "must", "AUX", "Tense=Pres", 4, "aux"),
    (1, 1, 2, "not", "not", "PART", "Polarity=Neg", 4, "neg"),
    (1, 1, 3, "wait", "wait", "VERB", "Tense=Pres", 0, "root"),
    (2, 0, 0, "old", "old", "ADJ", None, 3, "amod"),
    (2, 0, 1, "stone", "stone", "NOUN", None, 3, "compound"),
    (2, 0, 2, "walls", "wall", "NOUN", None, 0, "root"),
    (3, 0, 0, "prices", "price", "NOUN", None, 2, "nsubj"),
    (3, 0, 1, "climbed", "climb", "VERB", "Tense=Past", 0, "root"),
    (3, 1, 0, "child", "child", "NOUN", None, 2, "nsubj"),
    (3, 1, 1, "climbed", "climb", "VERB", "Tense=Past", 0, "root"),
    (4, 0, 0, "people", "people", "NOUN", None, 0, "root"),
    (4, 0, 1, "who", "who", "PRON", None, 3, "nsubj"),
    (4, 0, 2, "leave", "leave", "VERB", "Tense=Pres", 1, "acl:relc"),
    (5, 0, 0, "lost", "lost", "ADJ", None, 9, "aux:pass"),
]
FOUND = {
    ("passive", "were", "sent", "1:0:1"),
    ("modal", "must", "wait", "1:1:1"),
    ("negation", "not", None, "1:1:2"),
    ("complex_np", "old stone", "walls", "2:0:2"),
    ("relative_clause", "leave", None, "4:0:2"),
    ("tense", "past", "were", "1:0:1"),
    ("tense", "past", "sent", "1:0:2"),
    ("tense", "present", "must", "1:1:1"),
    ("tense", "present", "wait", "1:1:3"),
    ("tense", "past", "climbed", "3:0:1"),
    ("tense", "past", "climbed", "3:1:1"),
    ("tense", "present", "leave", "4:0:2"),
}


@pytest.fixture(params=["joined", "brought along"])
def parsed(spark, request):
    t = annotated(spark.createDataFrame(PARSED, SCHEMA))
    return t if request.param == "joined" else syntax.looked_up(t).drop("head_idx")


def test_patterns(parsed):
    rows = syntax.grammar(parsed).select("pattern", "marker", "target", "evidence_id").collect()
    assert {tuple(r) for r in rows} == FOUND and len(rows) == len(FOUND)
    some = syntax.grammar(parsed, ["complex_np", "modal"]).collect()
    assert {r["pattern"] for r in some} == {"complex_np", "modal"}
    with pytest.raises(ValueError, match="unknown patterns"):
        syntax.grammar(parsed, ["tens"])
    assert syntax.grammar(parsed.where("false")).count() == 0


def test_counts_and_pairs(parsed):
    counts = {r["pattern"]: (r["freq"], r["examples"]) for r in syntax.grammar_counts(parsed, examples=2).collect()}
    assert counts["tense"] == (7, ["1:0:1", "1:0:2"]) and counts["passive"] == (1, ["1:0:1"])
    pairs = {tuple(r) for r in syntax.dependency_pairs(parsed).collect()}
    assert pairs == {("wait", "we", 1), ("climb", "price", 1), ("climb", "child", 1), ("leave", "who", 1)}
    shown = {(r["governor"], r["dependent"]): r["examples"] for r in syntax.dependency_pairs(parsed, "nsubj", None, examples=1).collect()}
    assert shown == {("wait", "we"): ["1:1:0"], ("climb", "price"): ["3:0:0"], ("climb", "child"): ["3:1:0"], ("leave", "who"): ["4:0:1"]}
    assert [tuple(r) for r in syntax.metaphor_candidates(parsed).collect()] == [(3, 0, 1, "climb", "price", "3:0:1")]
    shares = {r["pos"]: r["percent"] for r in syntax.pos_distribution(parsed).collect()}
    assert shares["NOUN"] == round(6 / 18 * 100, 4)
    assert {tuple(r) for r in syntax.pos_ngrams(parsed, 2, min_freq=2).collect()} == {("NOUN VERB", 2)}


def test_lemma_context(parsed):
    rows = concordance.annotated_concordance(parsed, "climb", "lemma", window=2).orderBy("doc_id", "sentence_idx").collect()
    assert [(r["left_context"], r["node"], r["right_context"]) for r in rows] == [("prices", "climbed", ""), ("child", "climbed", "")]
    assert concordance.annotated_concordance(parsed, "noun", "pos").where(F.col("node") == "walls").count() == 1
