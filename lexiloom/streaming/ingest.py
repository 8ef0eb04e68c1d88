"""Incremental ingest: new document files become rows of the token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import tokens


def token_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of documents (doc_id, text, lang, source) as they arrive in a folder."""
    docs = spark.readStream.schema("doc_id bigint, text string, lang string, source string").parquet(path)
    return tokens(docs, ("lang", "source"))


def start_ingest(spark: SparkSession, path: str, out: str, checkpoint: str, version: str = "v1"):
    """Append tokens to a Parquet table by corpus and version; each file is taken once."""
    rows = token_stream(spark, path).withColumnRenamed("source", "corpus").withColumn("version_id", F.lit(version))
    return rows.writeStream.format("parquet").partitionBy("corpus", "version_id").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and type of a stream with ``ts`` and ``event_type``; later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
