"""Helpers shared by the training-data operators.

* ``shared_dir`` gives a fresh folder below ``spark.checkpoint.dir``, the one
  place that the driver and all executors can see.
* ``write_read`` cuts lineage through a Parquet table in that folder, so a lost
  executor never makes a long plan run again from its start.
* ``Scratch`` does the same with tables that are deleted when the operation ends;
  ``Recorded`` deletes those of all operations in a block.
* ``spread_join`` joins on keys of which one may hold any share of the rows.
* ``map_batches`` runs a Python function over Arrow batches of some columns.
* ``slices`` cuts a batch into runs of bounded text size, so that the working
  arrays of one step stay small whatever the lengths of the documents.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_recorded: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one if unset on a local master (tests)."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared root; nothing is made yet."""
    path = f"{shared_root(spark)}/lexiloom/{purpose}-{uuid.uuid4().hex}"
    for paths in _recorded:
        paths.append(path)
    return path


def write_read(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared root, by the file system that its URI names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Tables of one operation, deleted when its ``with`` block ends, also after a failure."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        """Write ``df`` and read it back, as ``write_read`` does."""
        self.paths.append(shared_dir(self.spark, purpose))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


class Recorded(Scratch):
    """All tables below the shared root that are begun between the ``with`` and ``stop``; deleted at the block's end."""

    def __enter__(self) -> Recorded:
        _recorded.append(self.paths)
        return self

    def stop(self) -> None:
        _recorded[:] = [p for p in _recorded if p is not self.paths]

    def __exit__(self, *error) -> None:
        self.stop()
        super().__exit__(*error)


#: Rows of one key that may meet in a task, and, at most, keys that are spread out.
KEY_ROWS, HOT_KEYS = 1000, 10_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner", counts: DataFrame | None = None, store: Callable[[DataFrame, str], DataFrame] = write_read) -> DataFrame:
    """``left`` joined with ``right`` on columns of which one value may hold any share of ``left``.

    A key with over ``total / HOT_KEYS`` rows of ``left`` (and over KEY_ROWS) is hot, so
    there are HOT_KEYS of them at most, and their list is broadcast.  Rows of a hot key
    are dealt by a hash of ``by`` to as many parts as keep each small, and the rows of
    ``right`` are repeated for each part.  ``counts`` (keys and ``n_``) are left's rows by
    key, if known; else ``left`` is read once more and should be stored.  ``store`` keeps the hot
    keys; where keys must not stay on disk, it is that of a ``Scratch``.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("n_")) if counts is None else counts
    each = max(KEY_ROWS, -(-(counts.agg(F.sum("n_")).first()[0] or 0) // HOT_KEYS))
    hot = store(counts.where(F.col("n_") > each).select(*on, F.ceil(F.col("n_") / each).cast("bigint").alias("parts_")), "hot-keys")
    if hot.isEmpty():
        return left.join(right.hint("merge"), on, how)
    parts = F.coalesce("parts_", F.lit(1).cast("bigint"))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("part_", F.pmod(F.xxhash64(by), parts)).drop("parts_")
    again = right.join(F.broadcast(hot), on, "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts_")
    return dealt.join(again.hint("merge"), [*on, "part_"], how).drop("part_")


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches of ``columns``; other columns are never read."""
    return df.select(*columns).mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def slices(sizes: list[int], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive rows whose sizes sum to ``most`` at most (one row may exceed it)."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[int, int, list[str]]]:
    """Runs [a, b) of rows of bounded text size and their texts; only one run's texts are Python strings at a time."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
    for a, b in slices(sizes, most):
        yield a, b, [x or "" for x in values[a:b].to_pylist()]


_memory: list = [None, None]


def claim(owner: str, clear: Callable[[], object] = lambda: None) -> None:
    """Say whose tables and caches a Python worker holds from now on.

    Workers live on between stages.  When another operator begins in one, the last
    one's caches are cleared, so that a worker never holds those of two operators.
    """
    if _memory[0] not in (None, owner):
        _memory[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:  # what was freed goes back to the system
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass
    _memory[:] = owner, clear


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class IntMap:
    """Vectorised open-addressing map from non-negative int64 keys to values.

    The table has at least two slots a key, so that most lookups end at their
    first probe; its size is fixed by the number of keys given at the start.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, missing, dtype=values.dtype)
        keys = np.asarray(keys, dtype=np.int64)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # one of those that share a slot stays
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; ``missing`` for those not in the map."""
        slot = self._home(keys)
        found = self.keys[slot]
        out = self.values[slot]
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot[left] = at = (slot[left] + 1) & self.mask
            out[left] = self.values[at]
            left = left[(self.keys[at] != keys[left]) & (self.keys[at] != -1)]
        return out
