"""A store of rows by document in versions: ingest, clean or annotate again, go back.

A version is a table of (doc_id, digest, part): which documents it has, what they were made
from, and which folder of rows holds them.  A new version makes rows only for documents whose digest is
new, writes them to a folder of their own, then its table, and last an entry in the log that makes it
the active one.  A job that dies on the way leaves the active version as it was; ``vacuum``
deletes what no entry names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Log


class Versions:
    """Versions of one corpus below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def history(self) -> list[dict]:
        """Entries of the log, oldest first: number, version, label, parts, and the recipe that the label stands for."""
        return [json.loads(self.log.read(n)) | {"number": n} for n in self.log.numbers()]

    def active(self) -> dict | None:
        numbers = self.log.numbers()
        return json.loads(self.log.read(numbers[-1])) | {"number": numbers[-1]} if numbers else None

    def _of(self, version: str | None) -> dict:
        found = self.active() if version is None else next((e for e in reversed(self.history()) if e["version"] == version), None)
        if found is None:
            raise ValueError(f"no version {version or 'yet'}")
        return found

    def documents(self, version: str | None = None) -> DataFrame:
        """(doc_id, digest, part) of a version, the active one by default."""
        return self.spark.read.parquet(f"{self.path}/versions/{self._of(version)['version']}")

    def rows(self, version: str | None = None) -> DataFrame:
        """The rows of a version's documents; only folders that it names are read, and those whose documents it all has without a join."""
        entry = self._of(version)
        if entry.get("whole"):
            return self.spark.read.parquet(*(f"{self.path}/rows/{p}" for p in entry["parts"]))
        parts = [self.spark.read.parquet(f"{self.path}/rows/{p}").withColumn("part_", F.lit(p)) for p in entry["parts"]]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        named = self.documents(entry["version"]).select("doc_id", F.col("part").alias("part_"))
        return every.join(named.hint("merge"), ["doc_id", "part_"], "left_semi").drop("part_")

    def commit(self, docs: DataFrame, make: Callable[[DataFrame], DataFrame], label: str, recipe: dict | None = None, text_col: str = "text") -> dict:
        """A version of ``docs`` (doc_id and ``text_col``, ids once each) with the rows that ``make`` gives for new or changed ones.

        Documents with the digest of text, label and recipe that they had in the active version keep their rows;
        documents that are not in ``docs`` are not in the version.  ``Conflict`` if another version became active meanwhile.
        """
        last = self.active()
        recipe_text = json.dumps([label, recipe], sort_keys=True)
        digest = F.sha2(F.concat_ws("\x00", F.lit(recipe_text), F.when(F.col(text_col).isNull(), "null").otherwise("text"), F.coalesce(text_col, F.lit(""))), 256)
        now = docs.select("doc_id", digest.alias("digest"))
        part, version = uuid.uuid4().hex, uuid.uuid4().hex
        old = self.documents(last["version"]) if last else self.spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, part string")
        kept = now.join(old.hint("merge"), ["doc_id", "digest"], "left").select("doc_id", "digest", F.coalesce("part", F.lit(part)).alias("part"))
        kept.write.parquet(f"{self.path}/versions/{version}")
        placed = self.spark.read.parquet(f"{self.path}/versions/{version}")
        new = placed.where(F.col("part") == part).select("doc_id")
        found = placed.groupBy("part").agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).collect()
        counts = {r["part"]: r["n"] for r in found}
        # If all documents are new, texts need no join with their ids, nor rows later on.
        whole = set(counts) <= {part} and all(r["n"] == r["ids"] for r in found)
        make(docs if whole else docs.join(new.hint("merge"), "doc_id", "left_semi")).write.parquet(f"{self.path}/rows/{part}")
        entry = {"version": version, "label": label, "recipe": recipe, "parts": sorted({*counts, part}), "documents": sum(counts.values()), "made": counts.get(part, 0), "whole": whole}
        self.log.put((last["number"] if last else 0) + 1, json.dumps(entry))
        return entry

    def activate(self, version: str) -> dict:
        """Make an earlier version the active one again."""
        last, entry = self.active(), self._of(version)
        self.log.put(last["number"] + 1, json.dumps({k: v for k, v in entry.items() if k != "number"}))
        return self.active()

    def vacuum(self) -> list[str]:
        """Delete versions and folders of rows that no entry names; nothing may be committed meanwhile."""
        named = {e["version"] for e in self.history()} | {p for e in self.history() for p in e["parts"]}
        gone = []
        for kind in ("versions", "rows"):
            beside = Log(self.spark, f"{self.path}/{kind}")
            files = beside._files()
            if files.exists(beside._at()):
                for name in [s.getPath().getName() for s in files.listStatus(beside._at())]:
                    if name not in named:
                        beside.delete(name)
                        gone.append(name)
        return gone
