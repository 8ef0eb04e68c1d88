"""Language profiles and detection: accuracy on unseen texts, brute force, odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import language

DIR = "/root/testdata/sf0.01"


def test_unseen_texts_are_told_apart(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    profiles = language.fit_profiles(docs.where("doc_id % 2 = 0"))
    unseen = docs.where("doc_id % 2 = 1 and n_chars > 100")
    found = language.detect_language(unseen, profiles).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("detected") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 400 and right >= 0.98


def test_grams_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(language, "PIECE", 7)
    for n in (0, 1, 2, 3, 8, 50):
        text = "".join(rng.choice("ab é字😀") for _ in range(n))
        want = Counter(text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1))
        del want[" "]
        codes, counts = language.gram_counts(text)
        assert {language.gram_text(c): k for c, k in zip(codes.tolist(), counts.tolist())} == want
        assert [language.gram_text(c) for c in language.first_grams(text, 5).tolist()] == sorted(want, key=lambda g: (-want[g], g))[:5]
        assert all(language.gram_code(language.gram_text(c)) == c for c in codes.tolist())


def test_odd_rows(spark):
    schema = "doc_id string, text string, lang string, x string, n int"
    profiles = language.fit_profiles(spark.createDataFrame([("1", "the cat and the hat", "en", "", 1), ("2", "der Hut und die Katze", "de", "", 1), ("3", None, "fr", "", 1), ("4", "x", None, "", 1)], schema))
    assert {r["lang"] for r in profiles.select("lang").distinct().collect()} == {"en", "de"}
    rows = [(None, "the hat " * 20, "", "", 1), ("b", None, "", "", 1), ("c", "", "", "", 1), ("d", "1234 " * 50, "", "", 1), ("e", "Katze und Hut " * 300_000, "", "", 1), ("f", "short", "", "", 1), ("f", "die Katze " * 20, "", "", 1)]
    got = [tuple(r)[:2] for r in language.detect_language(spark.createDataFrame(rows, schema), profiles, default="?").collect()]
    assert sorted(got, key=str) == sorted([(None, "en"), ("b", "?"), ("c", "?"), ("d", "?"), ("e", "de"), ("f", "?"), ("f", "de")], key=str)
    empty = spark.createDataFrame([], schema)
    assert language.fit_profiles(empty).count() == 0 and language.detect_language(empty, profiles).count() == 0
    assert language.detect_language(spark.createDataFrame(rows[:1], schema), language.fit_profiles(empty), default="en").first()["detected"] == "en"


def test_corpora_of_two_languages_are_not_compared(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "de"), (4, None)], "doc_id int, lang string")
    language.require_same_language(docs.where("doc_id <> 3"), docs)
    language.require_same_language(docs.where("doc_id = 4"), docs)
    with pytest.raises(ValueError, match="'en'"):
        language.require_same_language(docs.where("lang = 'en'"), docs.where("lang = 'de'"))


def test_counted_letters_equal_sorted_codes(monkeypatch):
    import random

    import numpy as np

    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab é", "abc ß日\0", "".join(map(chr, range(97, 190))) + " ") for n in (0, 1, 2, 3, 50, 3000)]
    counted = [language.gram_counts(t) for t in texts]
    monkeypatch.setattr(language, "MOST_LETTERS", 0)
    assert all(np.array_equal(a, b) for x, y in zip(counted, map(language.gram_counts, texts), strict=True) for a, b in zip(x, y, strict=True))
