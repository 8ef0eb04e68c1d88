"""Plans that must not grow again: shuffles and joins that a query does without, and the same results as the plainer way."""

from pyspark.sql import functions as F

from lexiloom.operators import arabic, frequency, versions
from lexiloom.functions.tokens import tokens
from lexiloom.sources import wikitext


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_not_grouped_by_document(spark):
    docs = spark.createDataFrame([(1, "a b c a b. a b"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    out = frequency.ngrams(docs, 2, min_freq=1, limit=None)
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in out.collect()} == {("a b", 4, 2), ("b c", 1, 1), ("c a", 1, 1)}


def test_segments_equal_grouped_tokens(spark):
    docs = spark.createDataFrame([(1, "والكتاب كتب كتب", "ar"), (2, "والكتاب مكتوبة في", None)], "doc_id bigint, text string, lang string")
    kind = ["prefix", "suffix", "pos", "number", "gender", "broken_plural"]
    want = arabic.annotate_tokens(docs).groupBy(*kind).agg(F.count("*"), F.countDistinct("stem"))
    assert {tuple(r) for r in arabic.segment_counts(docs).collect()} == {tuple(r) for r in want.collect()}


def test_whole_versions_need_no_join(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/v")
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    store.commit(docs, tokens, "x")
    assert "Join" not in plan(store.rows()) and store.rows().count() == 3
    store.commit(docs.where("doc_id = 1"), tokens, "x")
    assert "Join" in plan(store.rows()) and store.rows().count() == 2


def test_pages_come_in_pieces():
    import pyarrow as pa

    out = list(wikitext._plain(iter([pa.array(["'''x'''", None] * wikitext.PIECE)])))
    assert [len(x) for x in out] == [wikitext.PIECE] * 2 and out[0][0].as_py() == "x" and out[0][1].as_py() is None
