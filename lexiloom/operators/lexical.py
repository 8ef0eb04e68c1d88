"""Lexicon-driven operators.  Every word list is a parameter of bounded size and is inlined as a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions import measures as m
from ..functions.tokens import sentences, tokens


def hits(words: list[str]) -> Column:
    """How many of a row's tokens are in a list; ``isin`` becomes a hash set."""
    return F.size(F.filter("toks", lambda t: F.lower(t).isin(words))) if words else F.lit(0)


def cues(taxonomy: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    """(category, lower-case cue, is phrase); a cue with a space or full stop is a phrase."""
    return [(k, w.lower(), " " in w or "." in w) for k, words in taxonomy.items() for w in words]


def metadiscourse(docs: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """category, freq, per_million: single-word cues count each token, phrases once a sentence that holds them as words."""
    found = cues(taxonomy or lexicons.METADISCOURSE)
    sents = sentences(docs).select(F.transform("toks", lambda t: F.lower(t)).alias("toks"))
    line = F.concat(F.lit(" "), F.array_join("toks", " "), F.lit(" "))
    per_category = {}
    for category in dict.fromkeys(k for k, _, _ in found):
        count = hits([w for k, w, phrase in found if k == category and not phrase])
        for _, phrase, _ in (c for c in found if c[0] == category and c[2]):
            plain = " ".join(phrase.replace(".", " ").split())
            count = count + F.contains(line, F.lit(f" {plain} ")).cast("int")
        per_category[category] = F.coalesce(F.sum(count.cast("long")), F.lit(0))
    # One pass: a row with all sums, then one row for each category.
    totals = sents.agg(F.coalesce(F.sum(F.size("toks").cast("long")), F.lit(0)).alias("n"), *(v.alias(k) for k, v in per_category.items()))
    stacked = totals.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.col(k).alias("freq")) for k in per_category))).alias("x"))
    return stacked.select("x.category", "x.freq", F.round(m.per_million(F.col("x.freq"), F.col("n")), 2).alias("per_million"))


def vocabulary_bands(docs: DataFrame, basic: list[str], academic: list[str] | None = None) -> DataFrame:
    """band, freq, types, percent: basic words before academic ones before all others, by lower-cased form."""
    counts = tokens(docs).groupBy("text_lc").agg(F.count("*").alias("freq"))
    w = F.col("text_lc")
    band = F.when(w.isin(basic), "K1").when(w.isin(academic or lexicons.ACADEMIC), "AWL").otherwise("Off-list")
    bands = counts.groupBy(band.alias("band")).agg(F.sum("freq").alias("freq"), F.count("*").alias("types"))
    total = bands.agg(F.sum("freq").alias("n"))
    return bands.crossJoin(F.broadcast(total)).select("band", "freq", "types", F.round(F.col("freq") / F.col("n") * 100, 4).alias("percent"))


def rare_words(docs: DataFrame, threshold: int = 1, limit: int = 100) -> DataFrame:
    counts = tokens(docs).groupBy("text_lc").agg(F.count("*").alias("freq"))
    return counts.where(F.col("freq") <= threshold).orderBy("text_lc").limit(limit)


def sentiment(docs: DataFrame, positive: list[str] | None = None, negative: list[str] | None = None) -> DataFrame:
    """doc_id, sentence_idx, pos_hits, neg_hits, score, label for each sentence: the timeline."""
    p, n = positive or lexicons.POSITIVE, negative or lexicons.NEGATIVE
    rows = sentences(docs).select("doc_id", "sentence_idx", hits(p).alias("pos_hits"), hits(n).alias("neg_hits"))
    score = m.sentiment_score(F.col("pos_hits"), F.col("neg_hits"))
    return rows.select("doc_id", "sentence_idx", "pos_hits", "neg_hits", F.round(score, 6).alias("score"), m.sentiment_label(score).alias("label"))


def sentiment_summary(timeline: DataFrame) -> DataFrame:
    return timeline.agg(
        F.count("*").alias("sentences"),
        *(F.count_if(F.col("label") == k).alias(k) for k in ("positive", "negative", "neutral")),
        F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 3).alias("avg_score"),
    )


def markers_found(text: Column, words: list[str]) -> Column:
    """How many of the markers occur anywhere in the lower-cased text."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def claims(docs: DataFrame, rows: list[tuple[str, Column, Column]], id_col: str = "doc_id") -> DataFrame:
    """(id, category, confidence) for each rule (category, condition, confidence) that holds."""
    parts = [F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(c).alias("category"), F.round(v.cast("double"), 6).alias("confidence"))) for c, ok, v in rows]
    return docs.select(id_col, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).select(id_col, "x.category", "x.confidence")


def with_markers(docs: DataFrame, lists: dict[str, list[str]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text, one count for each list): the text is lowered once and each list counted once."""
    low = docs.select(id_col, F.lower(F.col(text_col)).alias("text"))
    return low.select(id_col, "text", *(markers_found(F.col("text"), w).alias(k) for k, w in lists.items()))


def persuasion(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Appeals by their markers, a third of confidence each, and argument structure by causal connectors."""
    found = with_markers(docs, lexicons.PERSUASION | {"argument_structure": lexicons.TOULMIN}, text_col)
    rules = [(k, F.col(k) > 0, F.least(F.lit(1.0), F.col(k) / 3)) for k in lexicons.PERSUASION]
    return claims(found, [*rules, ("argument_structure", F.col("argument_structure") > 0, F.lit(0.6))])


def framing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return claims(with_markers(docs, lexicons.FRAMING, text_col), [(k, F.col(k) > 0, F.lit(0.6)) for k in lexicons.FRAMING])


def narrative(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Narrative stages; the abstract is looked for in the text before its first non-empty full-stop part ends."""
    found = with_markers(docs, lexicons.NARRATIVE, text_col)
    parts = F.filter(F.split("text", r"\."), lambda s: F.trim(s) != "")
    opening = F.try_element_at(parts, F.lit(1))
    found = found.withColumn("opening_", opening).withColumn("abstract", markers_found(F.col("opening_"), lexicons.NARRATIVE_OPENING))
    return claims(found, [(k, F.col(k) > 0, F.lit(0.5)) for k in ["abstract", *lexicons.NARRATIVE]])


def cultural(docs: DataFrame, text_col: str = "text", lists: dict[str, list[str]] | None = None) -> DataFrame:
    lists = lists or lexicons.CULTURAL
    return claims(with_markers(docs, lists, text_col), [(k, F.col(k) > 0, F.lit(0.5)) for k in lists])


def keyword_pattern(words: list[str]) -> str:
    """One of the words between what is no letter, digit or underscore of any script."""
    import re

    return r"(?i)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?:$|[^\p{L}\p{N}_])"


def redact_sentences(docs: DataFrame, words: list[str] | None = None, mark: str = lexicons.REDACTION_MARK, gate_open: bool = False) -> DataFrame:
    """doc_id, text, was_filtered: sentences with a listed word give way to a mark, unless the gate is open."""
    if gate_open:
        return docs.select("doc_id", "text", F.lit(False).alias("was_filtered"))
    pattern = keyword_pattern(words or lexicons.PERSON_WORDS)
    parts = F.split(F.col("text"), r"(?<=[.!?])\s+")
    shown = F.array_join(F.transform(parts, lambda s: F.when(s.rlike(pattern), mark).otherwise(s)), " ")
    some = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    return docs.select("doc_id", F.when(some, shown).otherwise(F.col("text")).alias("text"), some.alias("was_filtered"))


def word_agreement(a: Column, b: Column) -> Column:
    """Share of a's distinct words that b has; null where a has none."""
    x, y = F.array_distinct(F.split(F.lower(F.trim(a)), r"\s+")), F.array_distinct(F.split(F.lower(F.trim(b)), r"\s+"))
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))
