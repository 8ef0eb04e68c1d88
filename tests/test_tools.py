"""Tools by name: every one runs over documents, results equal the operators', bad calls are refused."""

import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import concordance, tools

ARGUMENTS = {"concordance": {"query": "the", "limit": 3}, "collocations": {"query": "of"}, "keyness": {"source": "src1", "limit": 5}, "dispersion": {"query": "the"}, "grammar": {"patterns": ["modal", "complex_np"]}, "clean": {"lowercase": True}, "subcorpus": {"genre": "src1"}, "sentiment": {"positive": ["the"], "negative": ["of"]}}


@pytest.fixture(scope="module")
def docs(spark):
    x = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    return x.withColumn("meta", F.create_map(F.lit("genre"), F.col("source")))


@pytest.mark.parametrize("name", sorted(tools.TOOLS))
def test_every_tool_runs(docs, name):
    df = tools.call(docs, name, json.dumps(ARGUMENTS.get(name, {})))
    assert df.columns and (df.count() > 0 or name in ("roots",))
    assert tools.call(docs.where("false"), name, ARGUMENTS.get(name)).columns == df.columns


def test_results_are_the_operators(docs):
    a = tools.call(docs, "concordance", {"query": "th?n*", "window": 2})
    assert a.exceptAll(concordance.search_concordance(docs, "th?n*", window=2, limit=None)).count() == 0
    tools.register_views(docs, {"lines": ("concordance", {"query": "the"}), "shares": ("tags", {})})
    assert docs.sparkSession.sql("select count(*) from lines").first()[0] > 0
    assert docs.sparkSession.sql("select round(sum(percent)) from shares").first()[0] == 100


BAD = [("nothing", {}, "unknown tool"), ("concordance", {}, "query is missing"), ("concordance", {"query": ""}, "between"), ("concordance", {"query": 3}, "type str"), ("concordance", {"query": "a", "window": 0}, "between"), ("concordance", {"query": "a", "window": True}, "type int"), ("concordance", {"query": "a", "widow": 1}, "unknown arguments widow"), ("concordance", "{", "no JSON"), ("concordance", "[1]", "object"), ("frequency", {"level": "word"}, "one of"), ("ngrams", {"n": 9}, "between"), ("sentiment", {"positive": [1]}, "list of texts"), ("grammar", {"patterns": ["tens"]}, "unknown patterns"), ("grammar", {"patterns": []}, "between")]


@pytest.mark.parametrize(("name", "arguments", "why"), BAD)
def test_bad_calls_are_refused(docs, name, arguments, why):
    with pytest.raises(tools.ToolError, match=why):
        tools.call(docs, name, arguments)


def test_schemas():
    found = {s["name"]: s["parameters"] for s in tools.schemas()}
    assert len(found) == len(tools.TOOLS) >= 14 and json.dumps(tools.schemas())
    assert found["concordance"]["required"] == ["query"] and found["concordance"]["properties"]["window"] == {"type": "integer", "description": "Words on either side.", "minimum": 1, "maximum": 50, "default": 5}
    assert found["frequency"]["properties"]["level"]["enum"] == ["text", "lemma", "pos"]
