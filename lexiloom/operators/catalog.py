"""Corpus catalogue: metadata filters, reproducibility checks, disclosure, small mutable tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Conflict, Log


def subcorpus(docs: DataFrame, meta: str = "meta", year_min: str | None = None, year_max: str | None = None, **equal: str) -> DataFrame:
    """Documents whose metadata map satisfies all criteria; years are compared as text."""
    out = docs
    if year_min is not None:
        out = out.where(F.col(meta)["year"] >= str(year_min))
    if year_max is not None:
        out = out.where(F.col(meta)["year"] <= str(year_max))
    for key, value in equal.items():
        out = out.where(F.col(meta)[key] == value)
    return out


def merge_metadata(docs: DataFrame, patch: dict[str, str], meta: str = "meta") -> DataFrame:
    """Keys of the patch replace or join those of each row's map."""
    pairs = F.create_map(*[F.lit(x) for kv in patch.items() for x in kv])
    kept = F.map_filter(F.coalesce(F.col(meta), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(patch)))
    return docs.withColumn(meta, F.map_concat(kept, pairs))


def precheck(corpora: DataFrame) -> DataFrame:
    """(corpus, check, status) and the overall verdict, of rows with token_count, ai_turns, backend, model_name, model_version, document_count."""

    def passed(ok: Column, otherwise: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise(otherwise)

    filled = F.lit(True)
    for c in ("backend", "model_name", "model_version"):
        filled &= F.coalesce(F.col(c), F.lit("")) != ""
    checks = {
        "annotation_version": passed(F.col("token_count") > 0, "fail"),
        "ai_nondeterminism": passed(F.coalesce("ai_turns", F.lit(0)) == 0, "warn"),
        "pipeline_recipe": passed(filled, "fail"),
        "documents": passed(F.col("document_count") > 0, "fail"),
    }
    status = F.array(*checks.values())
    overall = F.when(F.array_contains(status, "fail"), "fail").when(F.array_contains(status, "warn"), "warn").otherwise("pass")
    return corpora.select("corpus", overall.alias("overall"), F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in checks.items()))).alias("x")).select("corpus", "overall", "x.check", "x.status")


def ai_disclosure(turns: DataFrame, group: str | None = None) -> DataFrame:
    """Turns, answers and their conversations, for each group or over all."""
    keys = [group] if group else []
    return turns.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.countDistinct("conv_id").alias("conversations"),
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"),
    )


def delete_document(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All rows but those whose id the table ``gone`` has; statistics are recomputed from what is left."""
    return docs.join(gone.select(id_col), id_col, "left_anti")


def merge_by_id(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """Union of result lists; of rows with one id, that of the first list stays."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_", F.lit(i))
        out = p if out is None else out.unionByName(p)
    columns = [c for c in out.columns if c not in (id_col, "source_")]
    best = out.groupBy(id_col).agg(F.min(F.struct("source_", *columns)).alias("x"))
    return best.select(id_col, *(F.col(f"x.{c}").alias(c) for c in columns))


class Table:
    """A Parquet table with append and rewrite, for saved searches, bookmarks and the like.

    Rows are in folders that are never changed; the newest entry of a log names those that count.  A
    change writes its folder first and its entry last, so a reader finds the table before or after
    it, and of two changes at once the second is made again on top of the first.
    """

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.log = Log(spark, f"{path}/log")

    def _folders(self) -> tuple[int, list[str]]:
        numbers = self.log.numbers()
        return (numbers[-1], self.log.read(numbers[-1]).split()) if numbers else (0, [])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def rows(self) -> DataFrame:
        return self._read(self._folders()[1])

    def _change(self, make) -> None:
        """``make(folders)`` gives the new rows and the folders that stay; made again if another change came first."""
        while True:
            number, folders = self._folders()
            rows, stay = make(folders)
            name = f"rows-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{name}")
            try:
                self.log.put(number + 1, "\n".join([*stay, name]))
                return
            except Conflict:
                Log(self.spark, self.path).delete(name)

    def add(self, rows: list[tuple]) -> None:
        self._change(lambda folders: (self.spark.createDataFrame(rows, self.schema), folders))

    def remove(self, condition: Column) -> None:
        """Rewrite without the rows for which the condition holds."""
        self._change(lambda folders: (self._read(folders).where(~F.coalesce(condition, F.lit(False))), []))
