"""Product quantisation with exact integers: codebooks by rounds of nearest entries and floored means.

Each vector is cut into equal consecutive parts, one codebook a part.  Each round
broadcasts a kd-tree of every codebook (its size is fixed by the number of entries
and the width, whatever the number of rows); tasks find nearest entries by branch and bound and
sum the parts of each entry, and Spark adds the sums.  Only these sums, one row an
entry, reach the driver.  A node is visited if its bound equals the best distance, too,
so that of entries at equal distance the one of lowest index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, spread_join, write_read
from .vectors import integer_vectors, matrix

#: Entries of a leaf; queries searched together.
LEAF, BATCH = 8, 4096


class KdTree:
    """A kd-tree over integer points; splits are at the median of the widest dimension."""

    def __init__(self, points: np.ndarray, ids: np.ndarray | None = None):
        self.ids = np.arange(len(points)) if ids is None else ids
        self.low, self.high = points.min(axis=0), points.max(axis=0)
        wide = int(np.argmax(self.high - self.low))
        self.sides: tuple[KdTree, ...] = ()
        self.points = points
        if len(points) > LEAF and self.high[wide] > self.low[wide]:
            order = np.argsort(points[:, wide], kind="stable")
            # Points stay in the order of their indices, so that a leaf's first minimum has its lowest index.
            self.sides = tuple(KdTree(points[at], self.ids[at]) for at in (np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])))

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """Least squared distance that a point of this node can have to each query."""
        out = np.maximum(np.maximum(self.low - queries, queries - self.high), 0)
        return (out * out).sum(axis=1)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest point; ties to the lower index."""
        best = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), np.iinfo(np.int64).max)
        for a in range(0, len(queries), BATCH):
            part = slice(a, a + BATCH)
            self._visit(queries[part], np.arange(len(queries[part])), best[0][part], best[1][part])
        return best

    def _visit(self, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, far: np.ndarray) -> None:
        if not len(rows):
            return
        own = queries[rows]
        if not self.sides:
            d = own[:, None, :] - self.points
            d = (d * d).sum(axis=2)
            at = d.argmin(axis=1)
            d, i = d[np.arange(len(rows)), at], self.ids[at]
            better = (d < far[rows]) | ((d == far[rows]) & (i < index[rows]))
            far[rows[better]], index[rows[better]] = d[better], i[better]
            return
        left, right = self.sides
        low, high = left.bound(own), right.bound(own)
        first = low <= high
        for side, mine, bound in ((left, first, low), (right, ~first, high), (right, first, high), (left, ~first, low)):
            side._visit(queries, rows[mine & (bound <= far[rows])], index, far)


def _parts(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(vectors, parts, axis=1)


def _sums(vectors: DataFrame, trees, parts: int) -> DataFrame:
    """(part, entry, n, sums): each task's parts by nearest entry, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vector codes")
        counts = sums = None
        for batch in batches:
            for p, (x, tree) in enumerate(zip(_parts(matrix(batch.column("vector_")), parts), trees.value, strict=True)):
                if counts is None:
                    counts = np.zeros((parts, len(tree.points)), dtype=np.int64)
                    sums = np.zeros((parts, *tree.points.shape), dtype=np.int64)
                at, _ = tree.nearest(x)
                counts[p] += np.bincount(at, minlength=len(tree.points))
                np.add.at(sums[p], at, x)
        if counts is not None:
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return vectors.select("vector_").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")


def _assigned(vectors: DataFrame, trees, parts: int, label_col: str) -> DataFrame:
    kind = vectors.schema[label_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("vector codes")
        for batch in batches:
            error, codes = np.zeros(batch.num_rows, dtype=np.int64), [""] * batch.num_rows
            for x, tree in zip(_parts(matrix(batch.column("vector_")), parts), trees.value, strict=True):
                digits = (len(f"{len(tree.points) - 1:x}") + 1) // 2 * 2
                at, far = tree.nearest(x)
                error += far
                codes = [c + format(i, f"0{digits}x") for c, i in zip(codes, at.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id_"), batch.column(label_col), pa.array(codes, pa.string()), pa.array(error)], names=["id_", label_col, "code", "error"])

    return vectors.select("id_", label_col, "vector_").mapInArrow(run, f"id_ bigint, {label_col} {kind}, code string, error bigint")


def codebooks(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook for each part: the first vectors' parts, then floored means of the parts nearest to each entry."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.asc_nulls_last("id_"), "vector_").limit(entries).select("vector_").collect()
    books = _parts(np.array([r[0] for r in first], dtype=np.int64), parts)
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        columns = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(books[0].shape[1])]
        rows = _sums(vectors, trees, parts).groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect()
        for part, entry, n, *sums in rows:
            books[part][entry] = [int(s) // n for s in sums]
        trees.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) for every row with a whole vector.

    ``code`` has two hex digits for each part (more if there are over 256 entries).  Rows that are dropped: see
    ``integer_vectors``; also all, if the width is no multiple of ``parts``.  Repeated rows are rows
    like any other; of equal ids the lesser vector comes first.  Rows without an id come last.  Null labels are one
    label.  With fewer rows than ``entries`` the codebooks are smaller; without rows the result is empty.
    """
    fits = F.size("vector_") % parts == 0
    vectors = write_read(integer_vectors(df, scale, id_col, vector_col, (label_col,)).where(fits), "integer-vectors")
    if vectors.isEmpty():
        empty = F.lit(None)
        return vectors.select(F.col("id_").alias(id_col), empty.cast("string").alias("code"), empty.cast("bigint").alias("error"), empty.cast("bigint").alias("label_error"), empty.cast("string").alias("codebooks_sha256"))
    books = codebooks(vectors, parts, entries, rounds)
    trees = df.sparkSession.sparkContext.broadcast([KdTree(b) for b in books])
    coded = _assigned(vectors, trees, parts, label_col)
    named = coded.select("id_", "code", "error", F.coalesce(F.col(label_col).cast("string"), F.lit("")).alias("label_"), F.col(label_col).isNull().alias("none_"))
    named = write_read(named, "vector-codes")
    labels = write_read(named.groupBy("label_", "none_").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_")), "label-errors")
    out = spread_join(named, labels.drop("n_"), ["label_", "none_"], F.struct("id_", "code"), counts=labels.drop("label_error"))
    return out.select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
