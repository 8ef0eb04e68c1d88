"""Frequency lists as (word, freq): TSV, CSV, JSON, and the exchange format with comment lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _summed(rows: DataFrame) -> DataFrame:
    """Case-folded words with positive counts, duplicates summed."""
    word = F.lower(F.trim("word"))
    return rows.select(word.alias("word"), F.expr("try_cast(trim(freq) as bigint)").alias("freq")).where((F.col("word") != "") & (F.col("freq") > 0)).groupBy("word").agg(F.sum("freq").alias("freq"))


def _cells(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = F.split("value", sep)
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("word"), parts[1].alias("freq"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _summed(_cells(spark, path, "\t"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return _summed(_cells(spark, path, ","))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("word string, freq string").option("multiLine", "true").json(path)
    return _summed(rows.where("word is not null and freq is not null"))


def read_lst(spark: SparkSession, path: str) -> DataFrame:
    """Imported lists keep case and duplicates; rows whose count is no integer, the header too, are skipped."""
    rows = _cells(spark, path, "\t")
    return rows.select("word", F.expr("try_cast(freq as bigint)").alias("freq")).where("freq is not null")


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased words of a list's first column."""
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.lower(F.split("value", "\t")[0]).alias("word")).distinct()


READERS = {"tsv": read_tsv, "csv": read_csv, "json": read_json, "lst": read_lst}


#: Words that a list may have, as lists become part of a query's plan.
MOST_WORDS = 100_000


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """The words or phrases of a text file, one a line, lower-case, sorted, once each; lines with # in front are notes."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where((F.col("w") != "") & ~F.col("w").startswith("#")).distinct()
    rows = words.orderBy("w").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in {path}")
    return [r["w"] for r in rows]
