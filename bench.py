"""Headline queries, timed: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.  The tables are copied into
several files first, as one file of one row group would occupy one core.  Each query is
warmed up once and then run BENCH_REPEATS times into a ``noop`` sink; the median
counts, the spread is the difference of the slowest and the fastest run.  Tokenising
alone is reported beside the queries, each of which includes its own.
"""

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["freq_word", "corpus_stats", "sttr_en", "kwic_the", "colloc_of_textbook", "keyness_quality_labels", "dispersion_the", "bigrams", "trigrams_bundles", "sentiment_summary", "discourse_categories", "vocab_bands", "clean_stopwords", "html_text", "persuasion_markers", "parallel_kwic"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from lexiloom.plans.registry import QUERIES

    from lexiloom.functions.tokens import tokens

    split = tempfile.mkdtemp(prefix="bench-")
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2 * int(cpus)).write.parquet(f"{split}/{name}.parquet")

    def timed(make) -> list[float]:
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return times[1:]

    tokenising = timed(lambda: tokens(spark.read.parquet(f"{split}/documents.parquet")))
    took = {name: timed(lambda name=name: QUERIES[name](spark, split)) for name in HEADLINE}
    medians = {name: round(statistics.median(t), 3) for name, t in took.items()}
    spread = {name: round(max(t) - min(t), 3) for name, t in took.items()}
    out = {"metric": "sum of median query times", "value": round(sum(medians.values()), 3), "unit": "sec", "queries": medians, "spread": spread, "tokenising": round(statistics.median(tokenising), 3)}
    print(json.dumps(out | {"sf": os.path.basename(os.path.normpath(sf_dir)), "cpus": int(cpus), "driver_memory": "8g", "repeats": repeats}))
    spark.stop()
    shutil.rmtree(split)


if __name__ == "__main__":
    main()
