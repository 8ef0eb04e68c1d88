"""Frequency lists, corpus statistics, type-token ratios, dispersion, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.tokens import NO_TOKEN, positions, sentences, split_sentences, split_tokens, tokens


def count_items(tokens_df: DataFrame, item: str = "text") -> DataFrame:
    return tokens_df.groupBy(F.col(item).alias("item")).agg(F.count("*").alias("freq"))


def frequency(tokens_df: DataFrame, item: str = "text", min_freq: int = 1, limit: int | None = 1000) -> DataFrame:
    """item, freq, per_million, percent; totals are over all tokens, before any limit."""
    return shares(count_items(tokens_df, item), min_freq, limit)


def words(docs: DataFrame) -> DataFrame:
    """The lower-case words of texts (text_lc), without their places: no token goes over a sentence's end, so texts need not be cut into sentences."""
    found = docs.select(F.explode(F.split(F.col("text"), NO_TOKEN)).alias("text"))
    return found.where("text <> ''").select(F.lower("text").alias("text_lc"))


def shares(counts: DataFrame, min_freq: int = 1, limit: int | None = 1000) -> DataFrame:
    """``frequency`` of items that are counted already."""
    # One row: total and number of types.
    total = counts.agg(F.sum("freq").alias("total_tokens"), F.count("*").alias("total_types"))
    out = counts.where(F.col("freq") >= min_freq).crossJoin(F.broadcast(total))
    out = out.select("item", "freq", F.round(m.per_million(F.col("freq"), F.col("total_tokens")), 2).alias("per_million"), F.round(m.per_million(F.col("freq"), F.col("total_tokens")) / 10_000, 4).alias("percent"), "total_tokens", "total_types")
    return out if limit is None else out.orderBy(F.desc("freq"), "item").limit(limit)


def corpus_statistics(docs: DataFrame, by: tuple[str, ...] = (), known: DataFrame | None = None) -> DataFrame:
    """Documents, sentences, tokens and true distinct types, for the whole table or by columns; ``known`` are the words' counts, if there are any."""
    sized = docs.select(*by, F.size(split_sentences(F.col("text"))).alias("n"))
    counts = sized.groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.greatest("n", F.lit(0))).alias("sentences"))
    # Each word once: its count gives the tokens, its row the type.
    if known is None:
        known = tokens(docs, by).groupBy(*by, "text_lc").agg(F.count("*").alias("freq"))
    types = known.groupBy(*by).agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens"), F.count("*").alias("types"))
    if not by:
        return counts.crossJoin(F.broadcast(types)).select("documents", "sentences", "tokens", "types")
    same = counts[by[0]].eqNullSafe(types[by[0]])
    for c in by[1:]:
        same &= counts[c].eqNullSafe(types[c])
    return counts.join(types, same, "left").select(*(counts[c] for c in by), "documents", "sentences", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("types", F.lit(0)).alias("types"))


def standardised_ttr(docs: DataFrame, chunk: int = 1000) -> DataFrame:
    """Mean type-token ratio of full chunks of the corpus in document order; the plain ratio if there is one chunk at most.

    Positions come from per-document counts and running sums over them, never from
    an ordering of all tokens.
    """
    rows = docs.select("doc_id", F.flatten(F.transform(split_sentences(F.col("text")), split_tokens)).alias("toks"))
    per_doc = rows.select("doc_id", F.greatest(F.size("toks"), F.lit(0)).alias("n"))
    placed = rows.join(positions(per_doc), "doc_id").select("offset", F.posexplode("toks").alias("at", "text"))
    chunks = placed.groupBy(F.floor((F.col("offset") + F.col("at")) / chunk).alias("chunk"), "text").agg(F.count("*").alias("c"))
    by_chunk = chunks.groupBy("chunk").agg(F.sum("c").alias("n"), F.count("*").alias("types"))
    full = F.col("n") == chunk
    ratios = by_chunk.agg(F.avg(F.when(full, F.col("types") / F.col("n"))).alias("mean"), F.count_if(full).alias("chunks"))
    whole = chunks.groupBy("text").agg(F.sum("c").alias("c")).agg(m.type_token_ratio(F.count("*"), F.sum("c")).alias("ttr"))
    return ratios.crossJoin(F.broadcast(whole)).select(F.round(F.when(F.col("chunks") > 1, F.col("mean")).otherwise(F.col("ttr")), 6).alias("sttr"), "chunks")


def dispersion_table(parts: DataFrame, freq: str = "freq") -> DataFrame:
    """Juilland's D and Gries' DP over one row for each part, zeros included."""
    total = parts.agg(F.sum(freq).alias("total"), F.count("*").alias("parts"), F.avg(freq).alias("mean"), F.stddev_pop(freq).alias("sd"))
    share = F.when(F.col("total") > 0, F.abs(F.col(freq) / F.when(F.col("total") > 0, F.col("total")) - 1 / F.col("parts")))
    out = parts.crossJoin(F.broadcast(total)).agg(F.first("total").alias("total"), F.first("parts").alias("parts"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.sum(share).alias("difference"))
    return out.select(F.col("total").alias("frequency"), "parts", F.round(m.juilland_d(F.col("mean"), F.col("sd"), F.col("parts")), 6).alias("juilland_d"), F.round(F.coalesce(m.deviation_of_proportions(F.col("difference")), F.lit(0.0)), 6).alias("gries_dp"))


def part_frequencies(docs: DataFrame, term: str, part: str = "doc_id") -> DataFrame:
    """part, freq, tokens: how often a term stands in each part, and the part's size; parts without it have zero."""
    toks = F.flatten(F.transform(split_sentences(F.col("text")), split_tokens))
    rows = docs.select(part, toks.alias("toks"))
    hits = F.size(F.filter("toks", lambda t: F.lower(t) == term.lower()))
    return rows.groupBy(part).agg(F.sum(F.greatest(hits, F.lit(0)).cast("long")).alias("freq"), F.sum(F.greatest(F.size("toks"), F.lit(0)).cast("long")).alias("tokens"))


def dispersion(docs: DataFrame, term: str, part: str = "doc_id") -> DataFrame:
    """How evenly a term is spread over the parts of a corpus; parts without it count as zero."""
    return dispersion_table(part_frequencies(docs, term, part))


def weighted_dispersion(parts: DataFrame) -> DataFrame:
    """Gries' DP of ``part_frequencies`` with each part expected to hold its share of the tokens; 0 without matches."""
    total = parts.agg(F.sum("freq").alias("frequency"), F.sum("tokens").alias("size"), F.count("*").alias("parts"))
    observed = F.col("freq") / F.nullif(F.col("frequency"), F.lit(0))
    expected = F.col("tokens") / F.nullif(F.col("size"), F.lit(0))
    out = parts.crossJoin(F.broadcast(total)).agg(F.max("frequency").alias("frequency"), F.max("parts").alias("parts"), F.sum(F.abs(observed - expected)).alias("x"))
    return out.select(F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("parts", F.lit(0)).alias("parts"), F.round(F.coalesce(F.col("x") / 2, F.lit(0.0)), 6).alias("weighted_dp"))


def slide(toks: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    last = F.size(toks) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def ngrams(docs: DataFrame, n: int = 2, min_freq: int = 5, min_range: int = 1, stop_words: list[str] | None = None, limit: int | None = 200) -> DataFrame:
    """ngram, freq and range (documents) of word n-grams within sentences.

    Stop words, if given, are taken out before the n-grams are formed.
    """
    if not 2 <= n <= 10:
        raise ValueError("n must be between 2 and 10")
    toks = F.transform(split_sentences(F.col("text")), split_tokens)
    if stop_words:
        toks = F.transform(toks, lambda x: F.filter(x, lambda t: ~F.lower(t).isin(stop_words)))
    # A document's n-grams stand in one row, sorted: the first of each counts for the range, so nothing is grouped by document.
    own = docs.select(F.sort_array(F.flatten(F.transform(toks, lambda x: slide(x, n)))).alias("grams")).where(F.size("grams") > 0)
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("grams", 1, F.size("grams") - 1))
    grams = own.select(F.inline(F.arrays_zip(F.col("grams").alias("ngram"), before.alias("before"))))
    first = F.count_if(F.col("before").isNull() | (F.col("before") != F.col("ngram")))
    out = grams.groupBy("ngram").agg(F.count("*").alias("freq"), first.alias("range")).where((F.col("freq") >= min_freq) & (F.col("range") >= min_range))
    return out if limit is None else out.orderBy(F.desc("freq"), "ngram").limit(limit)


def word_frequency_top(docs: DataFrame, limit: int = 50, min_length: int = 2) -> DataFrame:
    """Most frequent lower-cased words by white space, of two letters or more."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text")), r"\s+")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "word").limit(limit)
