"""From raw documents to packed training sequences, stage by stage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on all rows that its
predecessor kept; ``run`` writes every stage's result as Parquet below the shared
folder and reads it back, so a lost executor repeats a part of one stage only.  Tables with
texts as they were before ``privacy`` are deleted when ``run`` returns, also after a failure.
An empty table gives an empty result; null and empty texts are packed as empty ones; of rows with one id
one stays (see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import entry
from lexiloom.llm.common import Recorded, documents, write_read
from lexiloom.llm.neardup import drop_near_duplicates
from lexiloom.llm.packing import pack_documents
from lexiloom.llm.pii import replace_entities
from lexiloom.llm.quality import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model trained on trusted text does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, docs.columns).where("kept_").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8."""
    return drop_near_duplicates(docs, words=5, percent=80)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed surrogates."""
    return replace_entities(docs, entry.SURROGATE_KEY).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences of 4096 tokens."""
    return pack_documents(docs, entry.tokenizer_file("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("privacy", privacy), ("packing", packing)]

#: A language model, near-duplicate components, keyed hashes and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Recorded(spark) as originals:
        for name, stage in STAGES:
            if stage is privacy:
                originals.stop()
            docs = write_read(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
