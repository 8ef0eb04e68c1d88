"""Arabic words taken apart: prefixes, stem, suffixes, root and template, without a lexicon.

A word is split at every place where what stands before is a known run of prefixes and what
follows a known run of suffixes (the affix lattice).  Kinds of prefix and suffix must go
together, and the stem must fit a template whose three open places give the root.  All of a
word's readings compete: roots of different strong letters first, then short affixes, then long templates.

The work is done once for each distinct word: candidates come from equi-joins with small fixed
tables, and the best reading from an aggregation by word, which is partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import buckwalter, dediacritise
from ..functions.tokens import tokens
from ..sources.storage import stored

SCRIPT = "[ء-غف-ي]"
#: Runs of prefixes by kind: conjunction, preposition, article; or conjunction, future sign, person of the verb.
CONJUNCTIONS, PREPOSITIONS, FUTURE, PERSONS = ["", "و", "ف"], ["", "ب", "ل", "ك"], ["", "س"], ["ي", "ت", "ن", "ا"]
#: Endings of nouns and verbs, and pronouns behind them.
NOUN_ENDINGS, VERB_ENDINGS, PRONOUNS = ["ة", "ات", "ون", "ين", "ان"], ["وا", "ون", "ين", "ت", "تم"], ["ه", "ها", "هم", "هن", "ك", "كم", "نا", "ي"]
#: Templates over the root letters ف ع ل: (template, tag, is it a broken plural).
TEMPLATES = [
    ("فعل", "any", False), ("فاعل", "noun", False), ("فعال", "noun", False), ("فعيل", "adj", False), ("فعول", "noun", False), ("مفعل", "noun", False), ("افعل", "adj", False), ("تفعل", "verb", False),
    ("مفعول", "noun", False), ("تفعيل", "noun", False), ("تفاعل", "verb", False), ("مفاعل", "noun", True), ("افعال", "noun", True), ("فواعل", "noun", True), ("فعلان", "noun", False), ("انفعل", "verb", False), ("افتعل", "verb", False), ("مفعال", "noun", False), ("فعائل", "noun", True),
    ("مفاعيل", "noun", True), ("انفعال", "noun", False), ("افتعال", "noun", False), ("استفعل", "verb", False), ("متفاعل", "noun", False), ("مستفعل", "noun", False), ("استفعال", "noun", False),
]
PARTICLES = ["في", "من", "على", "الى", "عن", "ان", "لا", "ما", "هل", "قد", "لم", "لن", "ثم", "او", "بل"]
#: Kinds of suffix that may follow a kind of prefix.
TOGETHER = {"none": ("none", "noun", "noun+pronoun", "verb", "verb+pronoun"), "noun": ("none", "noun", "noun+pronoun"), "article": ("none", "noun"), "verb": ("none", "verb", "verb+pronoun")}


def prefixes() -> list[tuple[str, str, str]]:
    """(form, kind, parts joined by +); a form may be of several kinds."""
    out = [("", "none", "")]
    for c in CONJUNCTIONS:
        for p in PREPOSITIONS:
            if c or p:
                out.append((c + p, "noun", "+".join(x for x in (c, p) if x)))
            out.append((c + ("لل" if p == "ل" else p + "ال"), "article", "+".join(x for x in (c, p, "ال") if x)))
        for f in FUTURE:
            out += [(c + f + p, "verb", "+".join(x for x in (c, f, p) if x)) for p in PERSONS]
    return out


def suffixes() -> list[tuple[str, str, str]]:
    """(form, kind, parts joined by +): the feminine ending before a pronoun is written with an open t."""
    out = [("", "none", "")] + [(e, "noun", e) for e in NOUN_ENDINGS] + [(e, "verb", e) for e in VERB_ENDINGS]
    out += [(e + p, "noun+pronoun", f"{e}+{p}" if e else p) for e in ("", "ت", "ات") for p in PRONOUNS]
    return out + [(p, "verb+pronoun", p) for p in ("ه", "ها", "هم", "ني", "نا", "كم", "ك")]


def fitted(word: Column) -> Column:
    """A word as the tables write it: without diacritics and lengthening, alef in one form."""
    return F.translate(F.regexp_replace(dediacritise(word), "ـ", ""), "أإآٱ", "اااا")


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = [(form, kind, parts, other) for form, kind, parts in prefixes() for other in TOGETHER[kind]]
    before = spark.createDataFrame(pairs, "prefix string, prefix_kind string, prefix_parts string, suffix_kind string")
    after = spark.createDataFrame(suffixes(), "suffix string, suffix_kind string, suffix_parts string")
    rows = []
    for i, (template, tag, broken) in enumerate(TEMPLATES):
        places = [template.index(x) + 1 for x in "فعل"]
        rows.append((i, template, tag, broken, len(template), *places))
    templates = spark.createDataFrame(rows, "number int, template string, tag string, broken boolean, length int, first int, second int, third int")
    return before, after, templates


def analyse_words(words: DataFrame, word_col: str = "word") -> DataFrame:
    """(word, prefix, stem, suffix, root, template, pos, number, gender, broken_plural) of each distinct word.

    Words without a reading keep their whole form as stem and have the tag ``x``; particles are never taken
    apart.  Null words and words without Arabic letters are left out; repeated words give one row.
    """
    before, after, templates = _tables(words.sparkSession)
    distinct = words.select(F.col(word_col).alias("word")).where(F.col("word").rlike(SCRIPT)).distinct().withColumn("w", fitted(F.col("word")))
    n = F.length("w")
    longest = [max(len(x[0]) for x in table) for table in (prefixes(), suffixes())]
    split = distinct.where(~F.col("w").isin(PARTICLES) & (n >= 3))
    split = split.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest[0]), n - 3)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest[1]), n - 3 - F.col("i")))))
    split = split.select("word", F.substring("w", F.lit(1), F.col("i")).alias("prefix"), F.substring("w", F.col("i") + 1, n - F.col("i") - F.col("j")).alias("stem"), F.substring("w", n - F.col("j") + 1, F.col("j")).alias("suffix"), (F.col("i") + F.col("j")).alias("affixes"))
    split = split.where(F.length("stem") <= max(len(t) for t, _, _ in TEMPLATES))
    found = split.join(F.broadcast(before), "prefix").join(F.broadcast(after), ["suffix", "suffix_kind"])
    # A stem fits if it becomes the template when its root letters give way to the open places.
    opened = F.col("stem")
    for place, letter in zip(("first", "second", "third"), "فعل", strict=True):
        opened = F.overlay(opened, F.lit(letter), F.col(place))
    found = found.join(F.broadcast(templates), (F.length("stem") == F.col("length")) & (opened == F.col("template")))
    verbal = F.col("prefix_kind").startswith("verb") | F.col("suffix_kind").startswith("verb")
    nominal = F.col("prefix_kind").isin("noun", "article") | F.col("suffix_kind").startswith("noun")
    found = found.where(F.when(verbal, F.col("tag").isin("verb", "any")).when(nominal, F.col("tag") != "verb").otherwise(True))
    root = F.concat(*(F.substring("stem", F.col(c), F.lit(1)) for c in ("first", "second", "third")))
    pos = F.when(F.col("tag") != "any", F.col("tag")).when(verbal, "verb").otherwise("noun")
    number = F.when(F.col("broken") | F.col("suffix_parts").rlike("^(ات|ون|ين|وا|تم)"), "p").when(F.col("suffix_parts") == "ان", "d").otherwise("s")
    gender = F.when(F.col("suffix_parts").rlike("^(ة|ات|ت)"), "f").otherwise("m")
    # Roots of three different strong letters are the rule; weak and repeated letters are more often part of an affix.
    strong = F.array_distinct(F.filter(F.split(F.regexp_replace(root, "[اويىءئؤ]", ""), ""), lambda x: x != ""))
    order = [-F.size(strong), F.col("affixes"), -F.col("length"), F.col("number"), F.col("prefix_kind"), F.col("suffix_kind"), F.col("prefix_parts")]
    reading = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.col("prefix_parts").alias("prefix"), "stem", F.col("suffix_parts").alias("suffix"), root.alias("root"), "template", pos.alias("pos"), number.alias("count"), gender.alias("gender"), F.col("broken").alias("broken_plural"))
    best = found.groupBy("word").agg(F.min(reading).alias("r"))
    other = F.when(F.col("w").isin(PARTICLES), "part").otherwise("x")
    empty = F.lit("")
    taken = F.col("r").isNotNull()

    def field(name: str, otherwise: Column) -> Column:
        return F.when(taken, F.col(f"r.{name}")).otherwise(otherwise)

    out = distinct.join(best, "word", "left")
    return out.select("word", field("prefix", empty).alias("prefix"), field("stem", F.col("w")).alias("stem"), field("suffix", empty).alias("suffix"), field("root", empty).alias("root"), field("template", empty).alias("template"), field("pos", other).alias("pos"), field("count", empty).alias("number"), field("gender", empty).alias("gender"), field("broken_plural", F.lit(False)).alias("broken_plural"))


def segments() -> Column:
    """Prefixes, stem and suffixes of an analysed word, joined by +."""
    return F.array_join(F.filter(F.array("prefix", "stem", "suffix"), lambda x: x != ""), "+")


def word_analysis(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every distinct Arabic word of a corpus with its frequency, reading, segments and Buckwalter form."""
    words = tokens(docs, text_col=text_col).where(F.col("text").rlike(SCRIPT)).groupBy(F.col("text").alias("word")).agg(F.count("*").alias("freq"))
    words = stored(words, "arabic-words")  # three branches read it, and texts are cut into words once
    return analyse_words(words).join(words, "word").select("*", segments().alias("segments"), buckwalter(F.col("word")).alias("buckwalter"))


def root_frequency(analysed: DataFrame) -> DataFrame:
    """(root, freq, words): how often words of each root occur, and how many there are."""
    return analysed.where("root <> ''").groupBy("root").agg(F.sum("freq").alias("freq"), F.count("*").alias("words"))


def annotate_tokens(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The Arabic tokens of documents with their words' readings; a token without a reading is its own stem."""
    t = tokens(docs, keep).where(F.col("text").rlike(SCRIPT))
    return t.join(analyse_words(t, "text"), t["text"] == F.col("word")).drop("word")


def segment_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(kept columns, prefix, suffix, pos, number, gender, broken_plural, freq, stems): how often words are built so, and from how many stems.

    The same as grouping ``annotate_tokens``, but readings meet counts of words and not tokens.
    """
    words = tokens(docs, keep).where(F.col("text").rlike(SCRIPT)).groupBy(*keep, F.col("text").alias("word")).agg(F.count("*").alias("freq"))
    words = stored(words, "arabic-words")
    kind = (*keep, "prefix", "suffix", "pos", "number", "gender", "broken_plural")
    by_stem = words.join(analyse_words(words), "word").groupBy(*kind, "stem").agg(F.sum("freq").alias("freq"))
    return by_stem.groupBy(*kind).agg(F.sum("freq").alias("freq"), F.count("stem").alias("stems"))
