"""Arabic words taken apart: known words, brute force over all splits, odd rows."""

import random

import pytest

from lexiloom.operators import arabic

KNOWN = [
    ("كتاب", "", "كتاب", "", "كتب", "فعال", "noun", "s", "m"),
    ("والكتاب", "و+ال", "كتاب", "", "كتب", "فعال", "noun", "s", "m"),
    ("مكتوب", "", "مكتوب", "", "كتب", "مفعول", "noun", "s", "m"),
    ("للكاتب", "ل+ال", "كاتب", "", "كتب", "فاعل", "noun", "s", "m"),
    ("كاتبات", "", "كاتب", "ات", "كتب", "فاعل", "noun", "p", "f"),
    ("كتابهم", "", "كتاب", "هم", "كتب", "فعال", "noun", "s", "m"),
    ("سيكتبون", "س+ي", "كتب", "ون", "كتب", "فعل", "verb", "p", "m"),
    ("مدرسة", "", "مدرس", "ة", "درس", "مفعل", "noun", "s", "f"),
    ("مدارس", "", "مدارس", "", "درس", "مفاعل", "noun", "p", "m"),
    ("استخراج", "", "استخراج", "", "خرج", "استفعال", "noun", "s", "m"),
    ("كُتُب", "", "كتب", "", "كتب", "فعل", "noun", "s", "m"),
    ("في", "", "في", "", "", "", "part", "", ""),
    ("أو", "", "او", "", "", "", "part", "", ""),
    ("غغغغغغغ", "", "غغغغغغغ", "", "", "", "x", "", ""),
]


def words(spark, rows):
    return spark.createDataFrame([(w,) for w in rows], "word string")


def test_known_words(spark):
    got = {r["word"]: tuple(r)[1:9] for r in arabic.analyse_words(words(spark, [k[0] for k in KNOWN])).collect()}
    assert {k: got[k] for k, *_ in KNOWN} == {k: tuple(v) for k, *v in KNOWN}
    broken = {r["word"] for r in arabic.analyse_words(words(spark, ["مدارس", "مدرسات", "اقلام", "قلم"])).where("broken_plural").collect()}
    assert broken == {"مدارس", "اقلام"}


def brute(word):
    """Root, stem and affix length of the best reading, by trying every prefix, suffix and template."""
    best = None
    for p, pk, _ in arabic.prefixes():
        for s, sk, _ in arabic.suffixes():
            if sk not in arabic.TOGETHER[pk] or len(p) + len(s) + 3 > len(word) or not (word.startswith(p) and word.endswith(s)):
                continue
            stem = word[len(p) : len(word) - len(s)]
            for i, (t, tag, _) in enumerate(arabic.TEMPLATES):
                root = dict(zip(t, stem, strict=False))
                if len(t) != len(stem) or any(a != b for a, b in zip(t, stem, strict=True) if a not in "فعل"):
                    continue
                if "verb" in pk + sk and tag not in ("verb", "any"):
                    continue
                if "verb" not in pk + sk and (pk in ("noun", "article") or sk.startswith("noun")) and tag == "verb":
                    continue
                root = "".join(root[x] for x in "فعل")
                key = (-len({x for x in root if x not in "اويىءئؤ"}), len(p) + len(s), -len(t), i, pk, sk)
                best = min(best or (key, root, stem), (key, root, stem))
    return best[1:] if best else ("", word)


def test_all_readings_equal_brute_force(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("كتبدرسخجالويمنس") for _ in range(rng.randrange(3, 7))) for _ in range(60)]
    some = {rng.choice(arabic.prefixes())[0] + x + rng.choice(arabic.suffixes())[0] for x in stems for _ in range(3)} - set(arabic.PARTICLES)
    got = {r["word"]: (r["root"], r["stem"]) for r in arabic.analyse_words(words(spark, sorted(some))).collect()}
    assert got == {w: brute(w) for w in some}


def test_odd_rows(spark):
    rows = [None, "", "word", "12", "كتاب", "كتاب", "ك", "كت", "ـــ", "x" + "كتاب", "ب" * 30_000]
    got = {r["word"]: r["pos"] for r in arabic.analyse_words(words(spark, rows)).collect()}
    assert got == {"كتاب": "noun", "ك": "x", "كت": "x", "xكتاب": "x", "ب" * 30_000: "x"}
    assert arabic.analyse_words(words(spark, [])).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "والكتاب في المدرسة. كتاب!", "ar", "x", 1), (2, None, "ar", "x", 1), (3, "no Arabic", "en", "x", 1)], "doc_id int, text string, lang string, word string, freq int")
    rows = {r["word"]: r for r in arabic.word_analysis(docs).collect()}
    assert rows["والكتاب"]["segments"] == "و+ال+كتاب" and rows["المدرسة"]["segments"] == "ال+مدرس+ة" and rows["كتاب"]["buckwalter"] == "ktAb"
    assert {tuple(r) for r in arabic.root_frequency(arabic.word_analysis(docs)).collect()} == {("كتب", 2, 2), ("درس", 1, 1)}
    t = arabic.annotate_tokens(docs, ("lang",))
    assert t.count() == 4 and {r["root"] for r in t.collect()} == {"كتب", "درس", ""}


@pytest.mark.parametrize("table", [arabic.prefixes(), arabic.suffixes()])
def test_tables_name_a_form_and_kind_once(table):
    assert len({x[:2] for x in table}) == len(table) and all(x[2].replace("+", "") in (x[0], x[0].replace("لل", "لال")) for x in table)
