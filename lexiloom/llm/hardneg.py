"""Hard negatives by a full sort of each anchor's scores.

Anchors are a stated query set: rows whose id is divisible by ``every``.  Anchors and rows
are dealt into blocks, and each pair of blocks is a task's work: its anchors are held, its rows pass by in runs.
A first pass gives each anchor its positives.  The second sorts the anchor's scores with
all rows of other labels by score and id, searches each positive's upper limit by bisection and
reads the entries from there while they are above the lower limit.  Each block keeps
the first few entries of a positive, and the blocks' lists are merged by rank, so no
anchor's scores are ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, write_read
from .vectors import integer_vectors, matrix

#: Anchors held by a task, rows scored at once, and anchors scored at once.
ANCHORS, ROWS, SLAB = 16_384, 8192, 512
#: Rows of a block: at least, and at most.
BLOCK_LEAST, BLOCK_MOST = 8192, 1 << 22
NONE_SCORE, NONE_ID = -(1 << 62), (1 << 63) - 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point if all partial sums are whole numbers below 2^53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k along the last axis, higher scores and then smaller ids first."""
    order = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


class Positives:
    """The first other rows of each anchor's label."""

    def __init__(self, anchors: dict[str, np.ndarray], k: int):
        self.k, self.a = k, anchors
        n = len(anchors["id_"])
        self.score, self.ids = np.full((n, k), NONE_SCORE), np.full((n, k), NONE_ID)

    def add(self, rows: dict[str, np.ndarray]) -> None:
        for label in np.unique(self.a["label_"]):
            mine, own = np.flatnonzero(self.a["label_"] == label), rows["label_"] == label
            ids, vectors = rows["id_"][own], rows["vector_"][own]
            for s in range(0, len(mine), SLAB):
                at = mine[s : s + SLAB]
                score = scores(self.a["vector_"][at], vectors)
                every = np.broadcast_to(ids, score.shape)
                itself = every == self.a["id_"][at, None]
                score, every = np.where(itself, NONE_SCORE, score), np.where(itself, NONE_ID, every)
                score, every = np.concatenate((self.score[at], score), axis=1), np.concatenate((self.ids[at], every), axis=1)
                self.score[at], self.ids[at] = first_of(score, every, self.k)

    def result(self) -> pa.RecordBatch:
        i, k = np.nonzero(self.ids != NONE_ID)
        return pa.RecordBatch.from_arrays([pa.array(self.a["id_"][i]), pa.array(self.ids[i, k]), pa.array(self.score[i, k])], names=["anchor_id", "positive_id", "positive_score"])


class Negatives:
    """For each anchor and positive, the first rows of other labels whose scores are within the limits."""

    def __init__(self, anchors: dict[str, np.ndarray], k: int, limits: tuple[int, int]):
        self.k, self.a = k, anchors
        # The least and the largest whole score within the limits; hundreds apart, so that no product overflows.
        hundreds, rest = np.divmod(anchors["positive_score"], 100)
        self.low, self.high = limits[0] * hundreds - (-limits[0] * rest) // 100, limits[1] * hundreds + limits[1] * rest // 100
        shape = (*anchors["positive_score"].shape, k)
        self.score, self.ids = np.full(shape, NONE_SCORE), np.full(shape, NONE_ID)

    def add(self, rows: dict[str, np.ndarray]) -> None:
        in_order = np.argsort(rows["id_"], kind="stable")
        for label in np.unique(self.a["label_"]):
            mine, own = np.flatnonzero(self.a["label_"] == label), in_order[rows["label_"][in_order] != label]
            ids, vectors = rows["id_"][own], rows["vector_"][own]
            for s in range(0, len(mine), SLAB):
                at = mine[s : s + SLAB]
                down = -scores(self.a["vector_"][at], vectors)
                order = np.argsort(down, axis=1, kind="stable")  # ids ascend already
                down = np.take_along_axis(down, order, 1)
                score, found = np.full((len(at), *self.score.shape[1:]), NONE_SCORE), np.full((len(at), *self.ids.shape[1:]), NONE_ID)
                for x, i in enumerate(at.tolist()):
                    begin = np.searchsorted(down[x], -self.high[i], side="left")
                    for p, b in enumerate(begin.tolist()):
                        got = -down[x, b : b + self.k]
                        got = got[got >= self.low[i, p]]
                        score[x, p, : len(got)], found[x, p, : len(got)] = got, ids[order[x, b : b + len(got)]]
                score, found = np.concatenate((self.score[at], score), axis=2), np.concatenate((self.ids[at], found), axis=2)
                self.score[at], self.ids[at] = first_of(score, found, self.k)

    def result(self) -> pa.RecordBatch:
        i, p, k = np.nonzero((self.ids != NONE_ID) & (self.a["positive_id"] != NONE_ID)[:, :, None])
        columns = [self.a["id_"][i], self.a["positive_id"][i, p], self.a["positive_score"][i, p], self.ids[i, p, k], self.score[i, p, k]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def _arrays(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy() for c in ("id_", "label_", "turn")} | {"vector_": matrix(batch.column("vector_"))}
    out |= {"cell": np.stack([batch.column("anchor_block").to_numpy(), batch.column("row_block").to_numpy()], axis=1)}
    for c, none in (("positive_id", NONE_ID), ("positive_score", 0)):
        if c in batch.schema.names:
            # Lists of k at most, null for rows that are no anchors.
            filled = np.full((batch.num_rows, k), none)
            lists = batch.column(c)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            filled[np.arange(k) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            out[c] = filled
    return out


def by_cell(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], make: Callable, k: int, schema: str) -> DataFrame:
    """``make(anchors)`` of every pair of an anchor block and a row block, fed with the block's rows and asked for its result."""
    extra = [c for c in anchors.columns if c not in ("id_", "label_", "vector_")]
    number = lambda n: F.pmod(F.xxhash64("id_"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = anchors.select("id_", "label_", "vector_", *extra, number(blocks[0]).alias("anchor_block"), every(blocks[1]).alias("row_block"), F.lit(0).alias("turn"))
    past = rows.select("id_", "label_", "vector_", *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra), every(blocks[0]).alias("anchor_block"), number(blocks[1]).alias("row_block"), F.lit(1).alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hard negatives")
        cell, state = None, None
        held: list[list[dict[str, np.ndarray]]] = [[], []]

        def joined(turn: int) -> dict[str, np.ndarray]:
            out = {c: np.concatenate([x[c] for x in held[turn]]) for c in held[turn][0]}
            held[turn].clear()
            return out

        def flush():
            nonlocal state
            if held[0]:
                state = make(joined(0))
            if held[1]:
                rows = joined(1)
                if state is not None:
                    state.add(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _arrays(batch, k)
            key = np.column_stack((x["cell"], x["turn"]))
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = tuple(key[a, :2])
                if own != cell:
                    flush()
                    if state is not None:
                        yield state.result()
                    cell, state = own, None
                turn = int(key[a, 2])
                held[turn].append({c: v[a:b] for c, v in x.items()})
                if turn and sum(len(y["id_"]) for y in held[1]) >= ROWS:
                    flush()
        flush()
        if state is not None:
            yield state.result()

    columns = ["id_", "label_", "vector_", *extra, "anchor_block", "row_block", "turn"]
    cells = held.select(columns).unionByName(past.select(columns)).repartition("anchor_block", "row_block")
    return cells.sortWithinPartitions("anchor_block", "row_block", "turn").mapInArrow(run, schema)


def single_ids(rows: DataFrame) -> DataFrame:
    """One row for each id: of several the one of least label and vector."""
    again = rows.groupBy("id_").count().where("count > 1").select("id_")
    if again.isEmpty():
        return rows
    few = rows.join(again, "id_", "left_semi").groupBy("id_").agg(F.min(F.struct("label_", "vector_")).alias("m")).select("id_", "m.label_", "m.vector_")
    return rows.join(again, "id_", "left_anti").unionByName(few)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, limits: tuple[int, int] = (30, 90), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: F.Column | None = None, anchors_held: int = ANCHORS, block_least: int = BLOCK_LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    Scores are inner products of the integers floor(scale * x).  An anchor's positives are its first other rows
    of the same label; its negatives are the first rows of other labels whose score is within ``limits`` per cent of the
    positive's.  Higher scores come first, of equal ones smaller ids.  Rows without an id, label or whole vector
    (see ``integer_vectors``) take no part.  Rows of one id count as one, that of least label and vector.  Without
    anchors, positives or rows within the limits the result is empty.
    """
    label = F.col("label") if label is None else label
    plain = df.select(F.col(id_col).alias("id_"), F.col(vector_col).alias("x_"), label.cast("long").alias("label_"))
    rows = integer_vectors(plain.where("id_ is not null and label_ is not null"), scale, "id_", "x_", ("label_",))
    rows = write_read(single_ids(write_read(rows, "integer-vectors")), "vectors")
    anchors = rows.where(F.col("id_") % every == 0)
    n, n_anchors = rows.agg(F.count("*"), F.count_if(F.col("id_") % every == 0)).first()
    anchor_blocks = max(1, -(-n_anchors // anchors_held))
    wanted = 4 * df.sparkSession.sparkContext.defaultParallelism
    # As many blocks as keep all cores busy, but of few rows only where the table is small: each block gives a list to merge.
    row_blocks = max(1, -(-n // BLOCK_MOST), min(-(-n // block_least), -(-wanted // anchor_blocks)))
    blocks = anchor_blocks, row_blocks
    found = by_cell(anchors, rows, blocks, lambda a: Positives(a, positives), positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = found.withColumn("n_", F.row_number().over(ranked)).where(F.col("n_") <= positives).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("n_", "positive_id", "positive_score"))).alias("p"))
    pairs = write_read(pairs.select(F.col("anchor_id").alias("id_"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score")), "positives")
    near = by_cell(anchors.join(pairs.hint("merge"), "id_"), rows, blocks, lambda a: Negatives(a, negatives, limits), positives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
