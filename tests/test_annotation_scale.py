"""Annotation in tasks: tokens from marked texts, all words of a piece at once, and the same results as the plainer way."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexiloom.functions import tokens
from lexiloom.operators import annotation, perceptron

ODD = [None, "", " ", ".", " . !? ", ",", "\t", "a\tb", "\r\n", "a.b", "A b, c.  d-e!\n\n f", "é ß. ǆ’x", "漢字。仮名", "x\u0000y", "\U0001d400\U0001f600b", "ё́ 1.5 ٣٤", "  lead", "end,", "é ,. ,"]


def test_marked_texts_have_the_same_sentences(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    want = {(r.doc_id, r.sentence_idx, tuple(r.toks)) for r in tokens.sentences(docs).select("doc_id", "sentence_idx", "toks").collect()}
    assert not any(r.sentence.strip(" ") == "" for r in tokens.sentences(docs).collect())
    t = docs.select("doc_id", tokens.marked(F.col("text")).alias("x")).toArrow().combine_chunks().to_batches()[0]
    for a in (0, 7):  # also of a slice of an array
        part = t.slice(a)
        of, place, toks = tokens.marked_sentences(part.column("x"))
        ids = part.column("doc_id").take(pa.array(of)).to_pylist()
        got = {(i, p, tuple(x)) for i, p, x in zip(ids, place.tolist(), toks.to_pylist(), strict=True)}
        assert got == {x for x in want if x[0] in set(part.column("doc_id").to_pylist())}


def words():
    known = [w for classes in annotation.CLOSED.values() for ws in classes.values() for w in ws.split()]
    ends = [stem + e[0] for es in annotation.ENDINGS.values() for e in es for stem in ("", "x", "b", "wal", "élan")]
    return sorted({*known, *ends, "12", "٣٤", "1a", "²", "", "漢字", "bete", "beed", "café"})


def test_lexemes_of_all_words_at_once():
    langs = ["de", "en", "es", "fr", "tlh"]
    pairs = [(w, i) for i in range(len(langs)) for w in words()]
    ws, lang = pa.array([w for w, _ in pairs], pa.string()), np.array([i for _, i in pairs])
    for tag in (None, *range(len(annotation.TAGS))):
        found = annotation.lexemes(ws, lang, langs, None if tag is None else np.full(len(pairs), tag))
        got = list(zip(found.lemma.to_pylist(), (annotation.TAGS[t] for t in found.tag), found.morph.to_pylist(), strict=True))
        assert got == [annotation.lexeme(w, langs[i], None if tag is None else annotation.TAGS[tag]) for w, i in pairs]


def test_hashes_of_all_words_at_once():
    b = annotation.Batch(pa.array([words(), [], ["the"]], pa.list_(pa.string())), ["de", None, "en"])
    assert perceptron._hashes(b, b.lower).tolist() == [zlib.crc32(f"{lang} {w}".encode()) for lang, w in b.words]
    own, before, after = perceptron.word_features(b)
    assert own.shape == (len(b.words) + 1, 6) and len(before) == len(after) == len(b.words) + 1


def test_long_sentences_do_not_hold_up_short_ones():
    sizes = [3, annotation.LONG + 1, 5, 0, annotation.LONG, 900]
    batch = pa.RecordBatch.from_pydict({"sentence_idx": list(range(6)), "toks": pa.array([["x"] * n for n in sizes])})
    out = list(annotation.sorted_pieces(iter([batch, batch])))
    longest = [max(len(x) for x in p.column("toks").to_pylist()) for p in out]
    assert longest == [annotation.LONG, annotation.LONG, 900] and sum(p.num_rows for p in out) == 12


def test_tasks_get_whole_texts(spark):
    """Sentences and tokens are no rows or arrays of Spark's before an annotator has them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = annotation.RuleAnnotator().annotate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp_extract_all" not in plan


def test_only_chosen_texts_are_moved(spark):
    docs = spark.createDataFrame([(i, "the old walls were carried", "en") for i in range(9)] + [(3, "the cat", "en"), (None, "no id", "en")], "doc_id bigint, text string, lang string")
    some = perceptron.training_sentences(docs, annotation.RuleAnnotator(), most=4).select("doc_id").collect()
    want = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4).select("doc_id").collect()
    assert sorted({str(r[0]) for r in some}) == sorted({str(r[0]) for r in want})
