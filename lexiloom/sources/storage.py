"""Folders that all executors share, and a log whose entries appear whole or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a local one if that is unset on a local master (tests)."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/lexiloom/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once into a shared folder and read back, for what several branches of a plan need."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(Exception):
    """Another writer has taken the number of an entry."""


class Log:
    """Numbered text entries in a folder.

    An entry is written under a name of its own and then renamed to its number, which fails
    if the number is taken: a reader never sees half an entry, and of two writers that build on
    the same entry one is told so.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        files = self._files()
        if not files.exists(self._at()):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(self._at()) if s.getPath().getName().isdecimal())

    def read(self, number: int) -> str:
        stream = self._files().open(self._at(f"{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, number: int, text: str) -> None:
        files, beside = self._files(), self._at(f"_{uuid.uuid4().hex}")
        stream = files.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._at().toUri(), self.spark._jsc.hadoopConfiguration())
        qualified = [files.makeQualified(p) for p in (beside, self._at(f"{number:012d}"))]
        options = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(*qualified, options)
        except Exception as e:
            files.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"entry {number} of {self.path} is taken") from None
            raise

    def delete(self, name: str) -> None:
        """Delete a folder or file beside the entries, if it is there."""
        self._files().delete(self._at(name), True)
