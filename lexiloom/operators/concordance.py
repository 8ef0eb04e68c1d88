"""Keyword in context.

Sentences stay one row each, so context is a slice of the row's token array: a
concordance is a scan, a filter and a top-k, without shuffle or window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import sentences


def like_pattern(query: str) -> str | None:
    """SQL LIKE form of a query with * and ?, other LIKE signs escaped; None without them."""
    if "*" not in query and "?" not in query:
        return None
    escaped = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def matches(token: Column, query: str, case_sensitive: bool = False) -> Column:
    pattern = like_pattern(query)
    if pattern is not None:
        return token.like(pattern) if case_sensitive else F.lower(token).like(pattern.lower())
    return token == query if case_sensitive else F.lower(token) == query.lower()


def folded_matches(token: Column, query: str) -> Column:
    """Equality without regard to case and accents."""
    return F.collate(token, "UNICODE_CI_AI") == F.collate(F.lit(query), "UNICODE_CI_AI")


def context(toks: Column, at: Column, window: int) -> tuple[Column, Column]:
    """Texts of up to ``window`` tokens left and right of a 0-based position."""
    start = F.greatest(at - window, F.lit(0))
    return F.array_join(F.slice(toks, start + 1, at - start), " "), F.array_join(F.slice(toks, at + 2, F.lit(window)), " ")


def with_query(sents: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """Sentences whose text has a query without wildcards in it: others have no match and need not be cut into tokens.

    A sigma's small letter depends on what follows, so such queries leave all sentences.
    """
    if like_pattern(query) is not None or (not case_sensitive and any(c in "Σσς" for c in query)):
        return sents
    return sents.where(F.col("sentence").contains(query) if case_sensitive else F.lower("sentence").contains(query.lower()))


def hits(sents: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """One row for each match in sentence rows: their columns, token_idx and node."""
    return at_matches(sents, lambda t: matches(t, query, case_sensitive))


def at_matches(sents: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Sentence rows once for each matching token, with token_idx and node; only positions are exploded."""
    found = F.filter(F.transform("toks", lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
    at = sents.select("*", F.explode(found).alias("token_idx"))
    return at.withColumn("node", F.get("toks", F.col("token_idx")))


def search_concordance(docs: DataFrame, query: str, case_sensitive: bool = False, window: int = 5, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """doc_id, sentence_idx, token_idx, left, node, right, evidence_id in text order.

    ``limit`` None returns every match, unordered.
    """
    found = hits(with_query(sentences(docs), query, case_sensitive), query, case_sensitive)
    left, right = context(F.col("toks"), F.col("token_idx"), window)
    evidence = F.concat_ws(":", "doc_id", "sentence_idx", "token_idx")
    lines = found.select("doc_id", "sentence_idx", "token_idx", left.alias("left_context"), "node", right.alias("right_context"), evidence.alias("evidence_id"))
    if limit is None:
        return lines
    return lines.orderBy("doc_id", "sentence_idx", "token_idx").offset(offset).limit(limit)


def count_matches(docs: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    return hits(with_query(sentences(docs), query, case_sensitive), query, case_sensitive).agg(F.count("*").alias("total"))


def compare_concordance(target: DataFrame, reference: DataFrame, query: str, limit: int = 20, **options) -> DataFrame:
    """The first lines of two corpora, marked by side."""
    a = search_concordance(target, query, limit=limit, **options).withColumn("side", F.lit("target"))
    b = search_concordance(reference, query, limit=limit, **options).withColumn("side", F.lit("reference"))
    return a.unionByName(b)


def annotated_concordance(tokens_df: DataFrame, query: str, level: str = "lemma", case_sensitive: bool = False, window: int = 5) -> DataFrame:
    """Matches at the level of text, lemma or pos of an annotated token table; context keeps punctuation, nodes do not.

    A table with each sentence's ``toks`` needs no grouping by sentence, and may have only the tokens that match.
    """
    if "toks" in tokens_df.columns:
        found = tokens_df.where(matches(F.col(level), query, case_sensitive) & ~F.col("is_punct") & (F.col("pos") != "SPACE"))
        left, right = context(F.col("toks"), F.col("token_idx"), window)
        return found.select("doc_id", "sentence_idx", "token_idx", left.alias("left_context"), F.col("text").alias("node"), right.alias("right_context"))
    rows = tokens_df.groupBy("doc_id", "sentence_idx").agg(F.array_sort(F.collect_list(F.struct("token_idx", "text", F.col(level).alias("level"), "is_punct", "pos"))).alias("rows"))
    every = rows.select("doc_id", "sentence_idx", F.transform("rows", lambda r: r["text"]).alias("toks"), F.posexplode("rows").alias("at", "row"))
    found = every.where(matches(F.col("row.level"), query, case_sensitive) & ~F.col("row.is_punct") & (F.col("row.pos") != "SPACE"))
    left, right = context(F.col("toks"), F.col("at"), window)
    return found.select("doc_id", "sentence_idx", F.col("row.token_idx").alias("token_idx"), left.alias("left_context"), F.col("row.text").alias("node"), right.alias("right_context"))
