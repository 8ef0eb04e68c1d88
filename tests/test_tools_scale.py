"""Calls that share what they are made of: one pass that annotates, one count of words, one count of n-grams; the same results as apart."""

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.tokens import sentences, tokens
from lexiloom.operators import annotation, concordance, frequency, language, syntax, tools

CALLS = {"frequency": {"min_freq": 2}, "grammar": {"patterns": ["modal", "complex_np", "tense"]}, "dependency_pairs": {"relation": "obj"}, "tags": {}, "languages": {"default": "en"}, "statistics": {}}


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(1001, None, "en"), (1002, "", None), (1003, " , .", "xx"), (None, "The walls were carried. He must see old big dogs", "en")], "doc_id bigint, text string, lang string")
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text", "lang").unionByName(odd)


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_shared_calls_equal_the_operators(docs):
    t = annotation.RuleAnnotator().annotate(docs)
    found = tools.call_all(docs, {name: (name, arguments) for name, arguments in CALLS.items()})
    assert same(found["frequency"], frequency.frequency(tokens(docs), "text_lc", min_freq=2, limit=None))
    assert same(found["grammar"], syntax.grammar(t, CALLS["grammar"]["patterns"]))
    assert same(found["dependency_pairs"], syntax.dependency_pairs(t, "obj", None))
    assert same(found["tags"], syntax.pos_distribution(t))
    assert same(found["languages"], language.detect_language(docs, language.fit_profiles(docs), default="en"))
    assert same(found["statistics"], frequency.corpus_statistics(docs))


@pytest.mark.parametrize("pattern", syntax.DETECTORS)
def test_tokens_that_may_show_a_pattern(docs, pattern):
    assert same(tools.call(docs, "grammar", {"patterns": [pattern]}), syntax.grammar(annotation.RuleAnnotator().annotate(docs), [pattern]))


def test_counts_of_calls_read_texts_once(spark):
    """Whatever columns are asked for, tags annotate once; shared results annotate no more at all."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def plan(df):
        return df.agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()

    assert plan(tools.call(docs, "tags")).count("MapInArrow") == 1
    found = tools.call_all(docs, {name: (name, CALLS[name]) for name in ("grammar", "dependency_pairs", "tags", "frequency")})
    assert not any("MapInArrow" in plan(x) or "regexp" in plan(x) or "split(" in plan(x) for x in found.values())


@pytest.mark.parametrize(("query", "case"), [("the", False), ("The", True), ("th*", False), ("ΟΔΟΣ", False), ("K", False), ("i̇", False), ("%", False), ("a b", False)])
def test_sentences_without_the_query_have_no_matches(spark, query, case):
    rows = [(1, "The other. the. THE end, then"), (2, "ΟΔΟΣ'Α οδος. οδοσ"), (3, "5 K and k. İ i"), (4, None), (5, "100% a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = concordance.hits(sentences(docs), query, case).select("doc_id", "sentence_idx", "token_idx")
    assert same(concordance.search_concordance(docs, query, case, limit=None).select("doc_id", "sentence_idx", "token_idx"), want)
