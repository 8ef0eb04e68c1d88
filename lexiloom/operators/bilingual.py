"""Sentence alignment, parallel concordance, Arabic heuristics, dictionary lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions import measures as m
from ..functions.tokens import sentences
from .concordance import at_matches, context
from .lexical import markers_found


def align(source: DataFrame, target: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Pair the n-th sentences of document pairs: doc_id, sentence_idx, source, target, confidence.

    ``pairs`` maps doc_id to target_id; without it documents pair with their own id.
    Sentences are keyed by document and position, so documents never mix.
    """
    a = sentences(source).select("doc_id", "sentence_idx", F.col("sentence").alias("source"))
    b = sentences(target).select(F.col("doc_id").alias("target_id"), "sentence_idx", F.col("sentence").alias("target"))
    a = a.join(pairs, "doc_id") if pairs is not None else a.withColumn("target_id", F.col("doc_id"))
    both = a.join(b, ["target_id", "sentence_idx"])
    return both.select("doc_id", "target_id", "sentence_idx", "source", "target", F.round(m.length_ratio_confidence(F.length("source"), F.length("target")), 6).alias("confidence"))


def parallel_concordance(source: DataFrame, target: DataFrame, query: str, pairs: DataFrame | None = None, window: int = 5, substring: bool = False, limit: int | None = 100) -> DataFrame:
    """Matches in the source with context over white-space tokens, and the aligned target sentence (null without one).

    Only sentences with a match are looked up in the target.
    """
    q = query.lower()
    words = F.filter(F.split("sentence", r"\s+"), lambda t: t != "")
    rows = sentences(source).where(F.contains(F.lower("sentence"), F.lit(q))).select("doc_id", "sentence_idx", words.alias("toks"))
    at = at_matches(rows, lambda t: F.contains(F.lower(t), F.lit(q)) if substring else F.lower(t) == q)
    left, right = context(F.col("toks"), F.col("token_idx"), window)
    lines = at.select("doc_id", "sentence_idx", "token_idx", left.alias("left_context"), "node", right.alias("right_context"))
    lines = lines.join(pairs, "doc_id", "left") if pairs is not None else lines.withColumn("target_id", F.col("doc_id"))
    other = sentences(target).select(F.col("doc_id").alias("target_id"), "sentence_idx", F.col("sentence").alias("target"))
    out = lines.join(other, ["target_id", "sentence_idx"], "left").select("doc_id", "sentence_idx", "token_idx", "left_context", "node", "right_context", "target")
    return out if limit is None else out.orderBy("doc_id", "sentence_idx", "token_idx").limit(limit)


def dialect(text: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """Struct of four dialect probabilities by the first list with a marker in the text."""
    lists = markers or lexicons.DIALECT_MARKERS

    def weights(best: str | None) -> Column:
        out = []
        for k in ("msa", "egy", "glf", "lev"):
            v = (0.85 if k == "msa" else 0.05) if best is None else 0.6 if k == best else 0.3 if k == "msa" else 0.05
            out.append(F.lit(v).alias(k))
        return F.struct(*out)

    picked = None
    for k in ("egy", "glf", "lev"):
        hit = markers_found(text, lists[k]) > 0
        picked = F.when(hit, weights(k)) if picked is None else picked.when(hit, weights(k))
    return picked.otherwise(weights(None))


def register(text: Column, classical: list[str] | None = None, dialectal: list[str] | None = None) -> Column:
    """Struct of classical, msa and dialectal shares by marker words (white-space tokens)."""
    words = F.array_distinct(F.split(text, r"\s+"))
    c, d = (F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in (classical or lexicons.CLASSICAL_MARKERS, dialectal or lexicons.DIALECTAL_MARKERS))
    total = (c + d + 1).cast("double")
    return F.struct(F.round(c / total, 3).alias("classical"), F.round(1 / total, 3).alias("msa"), F.round(d / total, 3).alias("dialectal"))


def translate_words(words: DataFrame, dictionary: DataFrame, reverse: bool = False) -> DataFrame:
    """Look words up in a (source, targets array) dictionary; reverse looks targets up."""
    table = dictionary.select("source", F.explode("targets").alias("target")) if reverse else dictionary
    key = "target" if reverse else "source"
    return words.join(table, F.lower(words["word"]) == F.lower(table[key]), "left").select("word", *(c for c in table.columns))
