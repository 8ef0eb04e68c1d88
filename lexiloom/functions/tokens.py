"""From documents to sentences and tokens, with built-in functions only.

Operators that need context work on one row for each sentence with its tokens
as an array: windows, spans and n-grams are then array slices within a row and
need no shuffle and no join.  A token table (one row for each token) is the
exploded form, and the form of annotated input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?\n]+"
TOKEN = r"[\p{L}\p{M}\p{N}]+"
NO_TOKEN = r"[^\p{L}\p{M}\p{N}]+"
#: Signs that neither belong to tokens nor end sentences, spaces aside.
OTHER = r"[^\p{L}\p{M}\p{N}.!?\n ]+"


def split_sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: s != "")


def split_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def marked(text: Column) -> Column:
    """The text with each run of other signs as one comma and a line end behind it, from which ``marked_sentences`` reads tokens byte by byte."""
    return F.concat(F.regexp_replace(text, OTHER, ","), F.lit("\n"))


#: Kinds of bytes in marked texts: of a token, a space, of other signs, a sentence's end.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[ord(c) for c in " ,.!?\n"]] = (1, 2, 3, 3, 3, 3)


def marked_sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """The sentences of ``marked`` texts: each one's text (its number in the array), its place in it and its tokens; null texts have none.

    The same as ``sentences`` gives, for tasks that would only take its arrays apart again.
    """
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends[1:] - ends[0]
    kind = _KIND[data]
    of_token = kind == 0
    stops = np.flatnonzero(kind == 3)
    edges = np.flatnonzero(np.diff(of_token, prepend=False))  # every text ends with a stop, so tokens have both edges
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    stretch = np.searchsorted(stops, starts)  # the stretch between two stops
    shown = np.zeros(len(stops), dtype=bool)  # what has other signs alone is a sentence without tokens, what has spaces alone is none
    shown[stretch] = True
    shown[np.searchsorted(stops, np.flatnonzero(kind == 2))] = True
    own = np.flatnonzero(shown)
    text = np.searchsorted(ends, stops[own], side="right")
    place = np.arange(len(own)) - np.searchsorted(text, text)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    tokens_ = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[of_token]))
    bounds = np.append(0, np.cumsum(np.bincount(stretch, minlength=len(stops))[own])).astype(np.int32)
    return text, place.astype(np.int32), pa.ListArray.from_arrays(pa.array(bounds), tokens_)


def sentences(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept columns, sentence_idx, sentence, toks) for each sentence; a null text has none."""
    base = docs.select(id_col, *keep, F.posexplode(split_sentences(F.col(text_col))).alias("sentence_idx", "sentence"))
    return base.withColumn("toks", split_tokens(F.col("sentence")))


def tokens(docs: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each token: id, kept columns, sentence_idx, token_idx, text, text_lc."""
    base = sentences(docs, keep, id_col, text_col)
    out = base.select(id_col, *keep, "sentence_idx", F.posexplode("toks").alias("token_idx", "text"))
    return out.withColumn("text_lc", F.lower("text"))


def annotated(tokens_df: DataFrame) -> DataFrame:
    """Token rows completed to the full schema: missing lemma, tag and relation get their defaults."""
    have = set(tokens_df.columns)

    def col(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in have else default).alias(name)

    return tokens_df.select(
        *(c for c in tokens_df.columns if c not in ("lemma", "pos", "pos_fine", "morph", "dep_head", "dep_rel", "is_punct", "is_stop")),
        *([F.lower("text").alias("text_lc")] if "text_lc" not in have else []),
        col("lemma", F.col("text")),
        col("pos", F.lit("X")),
        col("pos_fine", F.lit("")),
        col("morph", F.lit("")),
        col("dep_head", F.lit(0)),
        col("dep_rel", F.lit("dep")),
        col("is_punct", F.lit(False)),
        col("is_stop", F.lit(False)),
    )


def real(tokens_df: DataFrame) -> DataFrame:
    """Tokens that count: neither punctuation nor space."""
    return tokens_df.where(~F.col("is_punct") & (F.col("pos") != "SPACE"))


def sentence_rows(tokens_df: DataFrame, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """Annotated tokens gathered to one row for each sentence, in token order."""
    toks = F.array_sort(F.collect_list(F.struct("token_idx", *fields)))
    return tokens_df.groupBy(id_col, "sentence_idx").agg(toks.alias("toks"))


def latest_version(versions: DataFrame, key: str = "corpus", version: str = "version_id", created: str = "created_at") -> DataFrame:
    """The newest version of each corpus."""
    return versions.groupBy(key).agg(F.max_by(version, created).alias(version))


def positions(docs_counts: DataFrame, id_col: str = "doc_id", n_col: str = "n", block: int = 1 << 16) -> DataFrame:
    """Adds ``offset``: how many tokens all documents of smaller id have.

    Ids are cut into blocks of ``block`` consecutive values.  Running sums are taken
    within blocks and, on one row a block, over blocks, so that no window has to
    order all documents in one task.
    """
    from pyspark.sql import Window

    counts = docs_counts.withColumn("block_", F.floor(F.col(id_col) / block))
    before = Window.partitionBy("block_").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block_").agg(F.sum(n_col).alias("in_block_"))
    blocks = blocks.select("block_", F.coalesce(F.sum("in_block_").over(all_before), F.lit(0)).alias("before_"))
    own = counts.withColumn("within_", F.coalesce(F.sum(n_col).over(before), F.lit(0)))
    return own.join(blocks, "block_").withColumn("offset", F.col("within_") + F.col("before_")).drop("block_", "within_", "before_")
