"""Queries of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, write_read


#: The key of the queries; a deployment passes its own.
SURROGATE_KEY = "example-key"


def tokenizer_file(name: str) -> str:
    """Default place of the public vocabulary files; every operator takes a path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(documents(spark, sf_dir), labels, ["doc_id", "lang"])
    return out.select("doc_id", "lang", *(F.col(f"{c}_").alias(c) for c in ("perplexity", "score", "threshold", "kept")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gif import digest_media, store_texts

    return digest_media(write_read(store_texts(documents(spark, sf_dir)), "media"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .unigram import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities

    kinds = F.array_sort(F.array_distinct(F.transform("entities_", lambda e: e["kind"])))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY).select("doc_id", F.size("entities_").cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"), "text")


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_and_read

    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordermin import fingerprint_edits

    return fingerprint_edits(documents(spark, sf_dir))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_documents

    places = F.col("base_places")
    return scan_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.array_join("expressions", ";").alias("expressions"),
    )


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_duplicates

    return simhash_duplicates(documents(spark, sf_dir), words=4, differ=4)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectorcodes import compress_vectors

    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hardneg import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS d, a AS r FROM e UNION SELECT reach.d, e.b FROM reach JOIN e ON e.a = reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) ON d = doc_id
"""
OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT h, max(page_id) AS original FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id < original THEN original END AS refers_to
FROM p LEFT JOIN o ON o.h = p.h
"""

FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes_sql(rounds: int = 4) -> str:
    """Codebooks round by round; distances from inner products, which are exact for whole numbers below 2^53."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, part, min(((qq - 2 * list_dot_product(q, c) + list_dot_product(c, c)) * 256)::BIGINT + entry) AS k FROM p JOIN b{r} USING (part) GROUP BY ALL)"""
    means = """m{r} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM (SELECT part, k % 256 AS entry, i, floor(sum(q[i]) / count(*)) AS x FROM p JOIN a{r} USING (vec_id, part), range(1, 17) t(i) GROUP BY ALL) GROUP BY ALL),
b{s} AS MATERIALIZED (SELECT part, b{r}.entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))"""
    steps = ",\n".join(f"{nearest.format(r=r)},\n{means.format(r=r, s=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE {FINITE}),
p AS MATERIALIZED (SELECT vec_id, label, part, q, list_dot_product(q, q) AS qq FROM (SELECT vec_id, label, part, x[16 * part + 1 : 16 * part + 16] AS q FROM v, range(4) t(part))),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS c FROM p QUALIFY entry < 256),
{steps},
{nearest.format(r=rounds)},
e AS (SELECT vec_id, label, string_agg(printf('%02x', k % 256), '' ORDER BY part) AS code, sum(k // 256)::BIGINT AS error FROM a{rounds} JOIN p USING (vec_id, part) GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM e
"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against brute force."""
    return {"op2_near_duplicates": OP2_SQL, "op6_warc_index": OP6_SQL, "op12_vector_codes": vector_codes_sql(), "op13_hard_negatives": OP13_SQL}
