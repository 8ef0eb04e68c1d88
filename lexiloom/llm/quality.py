"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Training text is what labels call trusted.  N-grams are of characters (order 5),
separate for each language; a symbol takes 12 bits, so an n-gram is one integer.
Counts of the trusted sample are aggregated in shards by n-gram; continuation
counts, discounts, context weights and interpolated probabilities follow from
joins of the sharded count tables, order by order; n-grams that begin with the start
symbol keep their counts, as nothing but it can precede them.  Scoring joins the
distinct n-grams of each slice of documents with the finished tables, backing off where
an n-gram was never seen.  These are cut into shards of about SHARD_GRAMS n-grams, by
hash; a worker holds CACHED shards at most and reads the others in turn for each slice,
so its memory is bounded whatever the size of the model.

The model is fitted on half of the trusted documents, everything else covers all
rows.  A document's score is its mean negative log-likelihood, shrunk towards its
language's centre as if ``prior`` more characters had been read, as short texts
vary more.  A language's threshold is the ``trusted_quantile`` of the scores of
trusted documents that the model has not seen (its rank is exact to 1 in 100,000 of
them); no share of the other documents moves it.  A language with too few of those for that quantile also gets the room
above its centre that they have over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IntMap, claim, shared_dir, slices, write_read

ORDER, BITS = 5, 12
DIRECT, START = 1280, 4095
OPEN = "\U0010ffff" * (ORDER - 1)
VOCABULARY = 1 << BITS
#: N-grams of a shard of the model, and shards that a worker holds.
SHARD_GRAMS, CACHED = 2_000_000, 3
#: Most ids that are sent to all tasks.
SENT_IDS = 1 << 20


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each character, and each text's number of them.

    Code points below DIRECT are symbols of their own, others share the rest by remainder;
    U+10FFFF, which stands for the start of a text, counts as U+10FFFE within one.
    """
    points = np.frombuffer("".join(OPEN + t.replace("\U0010ffff", "\U0010fffe") for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    symbols = np.where(points < DIRECT, points, DIRECT + points % (START - DIRECT))
    symbols[points == 0x10FFFF] = START
    codes = np.zeros(max(0, len(symbols) - ORDER + 1), dtype=np.int64)
    for i in range(ORDER):
        codes = (codes << BITS) | symbols[i : len(symbols) - ORDER + 1 + i]
    own = symbols[ORDER - 1 :] != START
    ends = np.cumsum([len(t) + ORDER - 1 for t in texts]) - (ORDER - 1)
    upto = np.concatenate(([0], np.cumsum(own)))
    counts = np.diff(np.concatenate(([0], upto[np.clip(ends, 0, len(own))])))
    return codes[own], counts


def by_language(languages: list, texts: list[str], most: int = 1 << 20) -> Iterator[tuple[str, list[int]]]:
    """Row numbers of each language, cut into slices of bounded text."""
    rows: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        rows.setdefault(lang or "", []).append(i)
    for lang, own in rows.items():
        for a, b in slices([len(texts[i]) for i in own], most):
            yield lang, own[a:b]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, g, c): counts of all n-grams, summed in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality-counts")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lang, rows in by_language(batch.column("lang").to_pylist(), texts):
                g, c = np.unique(gram_codes([texts[i] for i in rows])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c.astype(np.int64))], names=["lang", "g", "c"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, g bigint, c bigint").groupBy("lang", "g").agg(F.sum("c").alias("c"))


class Model(NamedTuple):
    """Where a fitted model's tables (shard, lang, order, kind, key, value) are, and their number of shards."""

    folder: str
    shards: int


def fit(docs: DataFrame, shard_grams: int = SHARD_GRAMS) -> Model:
    """Fit the model on (lang, text) rows."""
    spark = docs.sparkSession
    counts = {ORDER: write_read(count_grams(docs), f"counts-{ORDER}")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer n-grams with this ending
        ending = F.col("g").bitwiseAND((1 << BITS * k) - 1).alias("g")
        both = counts[k + 1].groupBy("lang", ending).agg(F.count("*").alias("n"), F.sum("c").alias("all"))
        begins = F.shiftright("g", BITS * (k - 1)) == START
        counts[k] = write_read(both.select("lang", "g", F.when(begins, F.col("all")).otherwise(F.col("n")).alias("c")), f"counts-{k}")
    written = shared_dir(spark, "kneser-ney")
    lower = None
    for k in range(1, ORDER + 1):
        n1, n2, n3, n4 = (F.greatest(F.count_if(F.col("c") == i), F.lit(1)).cast("double") for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)

        def clipped(d, most: int):
            return F.least(F.greatest(d, F.lit(0.05)), F.lit(most - 0.05))

        discounts = counts[k].groupBy("lang").agg(clipped(1 - 2 * y * n2 / n1, 1).alias("d1"), clipped(2 - 3 * y * n3 / n2, 2).alias("d2"), clipped(3 - 4 * y * n4 / n3, 3).alias("d3"))
        c = F.col("c")
        discount = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        own = counts[k].join(discounts, "lang").select("lang", "g", F.shiftright("g", BITS).alias("context"), c, discount.alias("d"))
        contexts = own.groupBy("lang", "context").agg(F.sum("c").cast("double").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        joined = own.join(contexts, ["lang", "context"])
        if lower is None:
            below = F.lit(1.0 / VOCABULARY)
        else:
            joined = joined.withColumn("ending", F.col("g").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(lower.select("lang", F.col("g").alias("ending"), F.col("p").alias("below")), ["lang", "ending"])
            below = F.col("below")
        lower = write_read(joined.select("lang", "g", ((c - F.col("d")) / F.col("total") + F.col("weight") * below).alias("p")), f"probabilities-{k}")
        tables = lower.select("lang", F.lit(k).alias("order"), F.lit(0).alias("kind"), F.col("g").alias("key"), F.ln("p").cast("float").alias("value"))
        tables = tables.unionByName(contexts.select("lang", F.lit(k).alias("order"), F.lit(1).alias("kind"), F.col("context").alias("key"), F.ln("weight").cast("float").alias("value")))
        tables.write.mode("append").parquet(written)
    tables = spark.read.schema("lang string, order int, kind int, key bigint, value float").parquet(written)
    shards = max(1, -(-tables.count() // shard_grams))
    folder = shared_dir(spark, "kneser-ney-shards")
    shard = F.pmod(F.col("key").bitwiseXOR(F.shiftright("key", 17)), F.lit(shards))
    tables.withColumn("shard", shard).repartition(shards, "shard").write.partitionBy("shard").parquet(folder)
    return Model(folder, shards)


@lru_cache(maxsize=CACHED)
def load(folder: str, shard: int) -> dict[tuple[str, int, int], IntMap]:
    """One shard's tables by (language, order, kind)."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{folder}/shard={shard}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    table = ds.dataset(path, filesystem=store, format="parquet").to_table(["lang", "order", "kind", "key", "value"])
    if not len(table):
        return {}
    lang = table["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    group = lang.indices.to_numpy().astype(np.int64) * 64 + table["order"].to_numpy() * 2 + table["kind"].to_numpy()
    key, value = table["key"].to_numpy(), table["value"].to_numpy()
    order = np.argsort(group, kind="stable")
    shards = {}
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        if len(own):
            g = int(group[own[0]])
            shards[names[g // 64], g % 64 // 2, g % 2] = IntMap(key[own], value[own], np.float32(np.nan))
    return shards


def log_probabilities(model: Model, lang: str, codes: np.ndarray) -> np.ndarray:
    """Interpolated log-probability of each n-gram's last character; nan for a language without model."""
    grams, back = np.unique(codes, return_inverse=True)
    known, weights = (np.full((ORDER + 1, len(grams)), np.nan, dtype=np.float32) for _ in range(2))
    for shard in range(model.shards):
        tables = load(model.folder, shard)
        for k in range(1, ORDER + 1):
            ending = grams & ((1 << BITS * k) - 1)
            for kind, values, key in ((0, known, ending), (1, weights, ending >> BITS)):
                table = tables.get((lang, k, kind))
                if table is not None:
                    own = np.flatnonzero((key ^ (key >> 17)) % model.shards == shard)
                    values[k, own] = table.get(key[own])
    if np.isnan(weights[1]).all():
        return np.full(len(codes), np.nan)
    out, still = np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
    for k in range(ORDER, 0, -1):
        seen = still & ~np.isnan(known[k])
        out[seen] += known[k][seen]
        still &= ~seen
        out[still] += np.nan_to_num(weights[k][still])
    out[still] += np.log(1.0 / VOCABULARY)
    return out[back]


def score(df: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The given columns with n_chars_ and nll_: characters and mean negative log-likelihood (null if none)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
    asked = list(dict.fromkeys([*columns, "lang", "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", load.cache_clear)
        most = min(8, max(1, model.shards // CACHED)) << 20  # shards that are not held are read once a slice
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            nll = np.full(len(texts), np.nan)
            for lang, rows in by_language(batch.column("lang").to_pylist(), texts, most):
                codes, counts = gram_codes([texts[i] for i in rows])
                sums = np.concatenate(([0.0], np.cumsum(log_probabilities(model, lang, codes))))
                ends = np.cumsum(counts)
                some = counts > 0
                nll[np.array(rows)[some]] = -(sums[ends] - sums[ends - counts])[some] / counts[some]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([len(t) for t in texts], pa.int64()), pa.array(nll, mask=np.isnan(nll))], names=[*columns, "n_chars_", "nll_"])

    return df.select(*asked).mapInArrow(run, f"{kinds}, n_chars_ bigint, nll_ double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that all their labels call good and none toxic, with a hash that deals them out."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    kept = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good.cast("int"), F.lit(0))).alias("good")).where("good = 1")
    return kept.select("doc_id", F.xxhash64("doc_id").alias("h"))


def dealt(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang_, fits): trusted documents, half to fit the model and half to set thresholds.

    If the hash puts all of a language's documents into one half, those of its least
    hash set the threshold and the others fit.  A language's only one fits.
    """
    ids = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang_")).distinct().join(trusted_ids(labels), "doc_id")
    ids = write_read(ids.withColumn("odd_", F.pmod("h", F.lit(2)) == 1), "trusted")
    halves = ids.groupBy("lang_").agg(F.min("odd_").alias("low_"), F.max("odd_").alias("high_"), F.min("h").alias("first_"), F.max("h").alias("last_"))
    one_half = F.col("low_") == F.col("high_")
    fits = F.when(~one_half, ~F.col("odd_")).otherwise((F.col("h") != F.col("first_")) | (F.col("first_") == F.col("last_")))
    return write_read(ids.join(F.broadcast(halves), "lang_").select("doc_id", "lang_", fits.alias("fits")), "dealt")


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], prior: int = 300, trusted_quantile: float = 0.995) -> DataFrame:
    """The given columns with perplexity_, score_, threshold_ and kept_ for every document.

    Documents have (doc_id, text, lang), labels (doc_id, quality, toxic).  Half of the
    trusted ids fit the model, the others set thresholds.  Null or empty texts
    have no perplexity and are kept; so are languages with less than two trusted
    documents.  Null languages are one language.  Repeated rows are scored alike.
    """
    aside = {c: f"{c}input" for c in columns if c in ("lang_", "n_chars_", "nll_", "centre_", "bar_", "held_", "room_", "limit_")}
    if aside:  # names of this function's own columns step aside
        renamed = classify(docs.withColumnsRenamed(aside), labels, [aside.get(c, c) for c in columns], prior, trusted_quantile)
        return renamed.withColumnsRenamed({v: k for k, v in aside.items()})
    trusted = dealt(docs, labels)
    lang = F.coalesce("lang", F.lit(""))
    sample = trusted.where("fits").select("doc_id", "lang_")
    if sample.count() <= SENT_IDS:  # else the texts are shuffled once to meet their ids
        sample = F.broadcast(sample)
    model = fit(docs.select("doc_id", "lang", "text", lang.alias("lang_")).join(sample, ["doc_id", "lang_"]))
    asked = list(dict.fromkeys([*columns, "doc_id", "lang"]))
    scored = write_read(score(docs, model, asked), "scored")
    held_out = scored.select("doc_id", lang.alias("lang_"), "n_chars_", "nll_").where("nll_ is not null").join(trusted.where("not fits").select("doc_id", "lang_"), ["doc_id", "lang_"])
    # These tables have a row for each language with trusted documents and are broadcast:
    # a join by language would meet most rows in one task.
    centre = F.broadcast(write_read(held_out.groupBy("lang_").agg(F.percentile_approx("nll_", 0.5, 10_000).alias("centre_")), "centres"))
    shrunk = (F.col("nll_") * F.col("n_chars_") + prior * F.col("centre_")) / (F.col("n_chars_") + prior)
    placed = held_out.join(centre, "lang_")
    bar = placed.groupBy("lang_").agg(F.percentile_approx(shrunk, trusted_quantile, 100_000).alias("bar_"), F.count("*").alias("held_"))
    room = placed.agg(F.percentile_approx(shrunk - F.col("centre_"), trusted_quantile, 100_000).alias("room_"))
    # Below this count the quantile is no more than the highest score seen.
    few = F.col("held_") * (1 - trusted_quantile) < 1
    limit = F.when(few, F.greatest("bar_", F.col("centre_") + F.col("room_"))).otherwise(F.col("bar_"))
    limits = write_read(centre.join(bar, "lang_").crossJoin(F.broadcast(room)).select("lang_", "centre_", limit.alias("limit_")), "limits")
    out = scored.withColumn("lang_", lang).join(F.broadcast(limits), "lang_", "left")
    return out.select(*columns, F.exp("nll_").alias("perplexity_"), F.exp(shrunk).alias("score_"), F.exp("limit_").alias("threshold_"), F.coalesce(shrunk <= F.col("limit_"), F.lit(True)).alias("kept_"))
