"""Near-duplicate documents by fast similarity sketching, banding and exact links.

Sketch: each round hashes every shingle to one of t bins and keeps the least
value of a bin; values of earlier rounds win.  After t random rounds, t further
ones fill one given bin each, so every coordinate is filled; two sets agree in a
coordinate with probability equal to their Jaccard similarity, with strong
concentration.  Rounds stop as soon as a document's bins are full.

Bands of coordinates give candidate links.  Their number is chosen so that a
pair at the threshold is missed with probability below ``MISS``.  Candidates are
confirmed on the full shingle sets.  Documents with equal sets are one class
from the start; links are sought between classes only.

All pairs of a bucket are never listed.  Buckets give star edges, whose
components hold every candidate pair.  Within such a block, a breadth-first
search compares each reached class with those not yet reached, until none is
left: a large group of near copies costs about one pass over it.  Blocks that would be
too much work for a task are cut into parts: their least class is compared with all
parts first, and what that leaves with every part.  Hot buckets, blocks and classes
are spread over tasks.  Sets are compared by 64-bit hashes of their shingles, and equal
ones told by 128 bits and the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, map_batches, spread_join, text_slices, write_read
from .graphs import components
from .hashing import U, constants, mix, powers, shingle_sets

ROWS = 5
MISS = 1e-6
#: Shingles of one block that a task holds, and shingles times classes that it may compare.
BLOCK_SHINGLES, BLOCK_WORK = 400_000, 100_000_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` coordinates that miss a pair at the threshold with probability ``miss`` at most."""
    bands = 1
    while (1 - threshold**rows) ** bands > miss:
        bands += 1
    return bands


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """One row of t coordinates for each set; rows of empty sets are undefined."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=U)
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    of = np.repeat(np.arange(len(sets)), n)
    seeds = constants(2 * t, 23)
    for i in range(2 * t):
        h = mix(items ^ seeds[i])
        value = (U(i) << U(40)) | (h >> U(24))
        if i < t:
            place = ((h & U(0xFFFFFF)) * U(t)) >> U(24)
        else:
            place = np.full(len(items), i - t, dtype=U)
        np.minimum.at(out, of * t + place.astype(np.int64), value)
        open_rows = (out.reshape(len(sets), t) == np.iinfo(np.uint64).max).any(axis=1)
        keep = open_rows[of]
        items, of = items[keep], of[keep]
        if not len(items):
            break
    return out.reshape(len(sets), t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Keys of all bands, different for each band's number."""
    n, t = sketch.shape
    keys = constants(rows, 31) | U(1)
    parts = (mix(sketch).reshape(n, t // rows, rows) * keys).sum(axis=2, dtype=U)
    return mix(parts + constants(t // rows, 37)).astype(np.int64)


def sketch_documents(df: DataFrame, words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set1, set2, bands): size and 128-bit digest of the set, and its band keys."""
    kind = df.schema[id_col].dataType.simpleString()
    bands = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-duplicates", powers.cache_clear)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col, 1 << 21):
                sets = shingle_sets(texts, words)
                sizes = [len(s) for s in sets]
                first = np.array([mix(s + U(3)).sum(dtype=U) for s in sets], dtype=U).astype(np.int64)
                second = np.array([np.bitwise_xor.reduce(mix(s + U(5))) for s in sets], dtype=U).astype(np.int64)
                keys = band_keys(sketches(sets, bands * ROWS), ROWS)
                offsets = np.arange(0, bands * (b - a) + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[a:b], pa.array(sizes, pa.int64()), pa.array(first), pa.array(second), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=[id_col, "n_shingles", "set1", "set2", "bands"])

    return map_batches(df, [id_col, text_col], run, f"{id_col} {kind}, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>")


def sets_of(df: DataFrame, words: int, id_col: str, text_col: str, extra: list[str]) -> DataFrame:
    """(id, extra columns, shingles) with the full sets as bytes."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [id_col, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near-duplicates", powers.cache_clear)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col, 1 << 21):
                sets = [s.tobytes() for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in [id_col, *extra]), pa.array(sets, pa.binary())], names=[id_col, *extra, "shingles"])

    return map_batches(df, [id_col, *extra, text_col], run, f"{kinds}, shingles binary")


class Gathered:
    """Sets laid out by size, to be compared with one set at a time."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        self.ids, self.sizes = np.array(ids, dtype=np.int64)[order], sizes[order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate([sets[i] for i in order.tolist()])

    def near(self, a: np.ndarray, percent: int) -> np.ndarray:
        """Ids of the sets that are similar enough to the set ``a``."""
        lo = int(np.searchsorted(self.sizes, -(-percent * len(a) // 100)))
        hi = int(np.searchsorted(self.sizes, 100 * len(a) // percent, side="right"))
        if lo >= hi:
            return self.ids[:0]
        n, begin = self.sizes[lo:hi], self.starts[lo]
        items = self.flat[begin : self.starts[hi - 1] + n[-1]]
        at = np.searchsorted(a, items)
        at[at == len(a)] = 0
        common = np.add.reduceat((a[at] == items).astype(np.int64), self.starts[lo:hi] - begin)
        return self.ids[lo:hi][100 * common >= percent * (n + len(a) - common)]


def search_block(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """Component (least id) of each class of a block, by search among those not yet reached.

    Classes are ordered by size, so those of similar size are a slice; arrays are
    cut down whenever half of their classes have been reached.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, items = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [items[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    marked = np.zeros(len(items) + 1, dtype=np.uint8)
    group = np.full(len(ids), -1, dtype=np.int64)
    left = np.argsort(sizes, kind="stable")

    def lay_out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = sizes[left]
        return n, np.cumsum(n) - n, np.concatenate([own[i] for i in left])

    n, starts, flat = lay_out()
    while True:
        still = np.flatnonzero(group[left] < 0)
        if not len(still):
            break
        root = int(left[still[0]])
        group[root] = root
        queue, rest = [root], len(still) - 1
        while queue and rest:
            i = queue.pop()
            if 2 * rest < len(left):
                left = left[group[left] < 0]
                n, starts, flat = lay_out()
            lo = int(np.searchsorted(n, -(-percent * sizes[i] // 100)))
            hi = int(np.searchsorted(n, 100 * sizes[i] // percent, side="right"))
            if lo >= hi:
                continue
            marked[own[i]] = 1
            common = np.add.reduceat(marked[flat[starts[lo] : starts[hi - 1] + n[hi - 1]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            marked[own[i]] = 0
            near = 100 * common >= percent * (n[lo:hi] + sizes[i] - common)
            got = left[lo:hi][near]
            got = got[group[got] < 0]
            group[got] = root
            rest -= len(got)
            queue += got.tolist()
    least: dict[int, int] = {}
    for i, g in zip(ids, group.tolist(), strict=True):
        least[g] = min(i, least.get(g, i))
    return [least[g] for g in group.tolist()]


def search_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(node, component) for blocks that fit a task; members are (block, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            seen = dict(zip(nodes, sets, strict=True))  # a node once
            ids = list(seen)
            found = search_block(ids, [seen[i] for i in ids], percent)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["node", "component"])

        for batch in batches:
            for b, i, s in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "shingles")), strict=True):
                if b != block:
                    if nodes:
                        yield done()
                    block, nodes, sets = b, [], []
                nodes.append(i)
                sets.append(np.frombuffer(s, dtype=U))
        if nodes:
            yield done()

    return members.select("block", "node", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(run, "node bigint, component bigint")


def compare(gathered: DataFrame, others: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b) links between the two tables' rows (keys, node, shingles) with equal keys; the first are held, the others pass by."""
    rows = gathered.select(*keys, "node", "shingles", F.lit(0).alias("turn")).unionByName(others.select(*keys, "node", "shingles", F.lit(1).alias("turn")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, held = None, [], [], None
        for batch in batches:
            a, b = [], []
            for *own, node, s, turn in zip(*(batch.column(c).to_pylist() for c in [*keys, "node", "shingles", "turn"]), strict=True):
                if own != key:
                    key, ids, sets, held = own, [], [], None
                s = np.frombuffer(s, dtype=U)
                if turn == 0:
                    ids.append(node)
                    sets.append(s)
                elif ids:
                    held = held or Gathered(ids, sets)
                    near = held.near(s, percent).tolist()
                    a += near
                    b += [node] * len(near)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "turn").mapInArrow(run, "a bigint, b bigint")


def search_large_blocks(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b) links that connect what is linked in blocks of several parts.

    ``members`` is a stored table (block, node, parts, shingles).  One pass compares each
    block's least class with all others; what is linked to it is connected, so no pair
    among those needs a look.  Each of the others is then compared with every class of
    its block: the others are dealt into chunks, and each pair of chunk and part is a
    group of its own.  A block of near copies leaves few others.
    """
    part = F.pmod(F.xxhash64("node"), F.col("parts")).alias("part")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part")
    dealt = members.select("block", part, "node", "shingles")
    # A block's name is its least class.
    pivots = members.where("node = block").select("block", every, "node", "shingles")
    found = write_read(compare(pivots, dealt, ["block", "part"], percent), "pivot-links")
    others = write_read(members.join(found.select(F.col("b").alias("node")).hint("merge"), "node", "left_anti"), "others")
    chunks = others.groupBy("block").agg(F.ceil(F.sum(F.length("shingles") / 8) / most).alias("chunks"), F.count("*").alias("n_"))
    chunks = write_read(chunks, "chunks")
    counts = chunks.select("block", "n_")
    number = F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")
    left = spread_join(others, chunks.drop("n_"), ["block"], F.col("node"), counts=counts).select("block", number, "parts", "node", "shingles")
    left = left.select("block", "chunk", every, "node", "shingles")
    again = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk")
    right = spread_join(dealt, chunks.drop("n_"), ["block"], F.col("node")).select("block", again, "part", "node", "shingles")
    return compare(left, right, ["block", "chunk", "part"], percent).unionByName(found)


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_shingles: int = BLOCK_SHINGLES, block_work: int = BLOCK_WORK) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Links join documents with 100 * |A & B| >= percent * |A | B| over distinct
    shingles of ``words`` words.  ``component_id`` is the least id reachable and
    ``kept`` is true for it.  Texts that are null, empty or without words have no
    shingles and stand alone.  Rows with one id are one document of that id.  Rows
    without an id are linked with nothing: component null, kept true.
    """
    threshold = percent / 100
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = write_read(sketch_documents(base, words, threshold, "doc_id", "text"), "sketches")
    has_words = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    same = ["set1", "set2", "n_shingles"]
    classes = write_read(sketched.where(has_words).groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("n_")), "classes")
    # Buckets: pairs are edges at once; larger ones give a star around their least member.
    banded = classes.select("node", F.explode("bands").alias("key"))
    buckets = write_read(banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n_")).where("n_ > 1"), "buckets")
    large = buckets.where("n_ > 2")
    stars = spread_join(banded, large.select("key", "a"), ["key"], F.col("node"), counts=large.select("key", "n_")).select("a", F.col("node").alias("b"))
    coarse = components(buckets.where("n_ = 2").select("a", "b").unionByName(stars).where("a != b").distinct())
    coarse = write_read(coarse.select("node", F.col("component").alias("block")).join(classes.select("node", "n_shingles").hint("merge"), "node"), "blocks")
    # A block's parts: what a task may hold and compare.
    weights = write_read(coarse.groupBy("block").agg(F.sum("n_shingles").cast("double").alias("all_"), F.count("*").alias("n_")), "weights")
    parts = F.ceil(F.greatest(F.lit(1.0), F.col("all_") / block_shingles, F.sqrt(F.col("all_") * F.col("n_") / block_work))).cast("int").alias("parts")
    placed = spread_join(coarse.select("node", "block"), weights.select("block", parts), ["block"], F.col("node"), counts=weights.select("block", "n_"))
    # Full sets of the members only.  The list of members grows with the corpus, so it is never broadcast.
    texts = base.join(write_read(placed, "placed").hint("merge"), base["doc_id"] == F.col("node")).select("node", "block", "parts", "text")
    members = write_read(sets_of(texts, words, "node", "text", ["block", "parts"]), "members")
    found = search_blocks(members.where("parts = 1"), percent).select(F.col("node").alias("a"), F.col("component").alias("b"))
    several = members.where("parts > 1")
    if not several.isEmpty():
        found = found.unionByName(components(search_large_blocks(several, percent, block_shingles)).select(F.col("node").alias("a"), F.col("component").alias("b")))
    final = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    named = classes.select(*same, "node").join(final.hint("merge"), "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    named = write_read(named, "named-classes")
    out = spread_join(sketched.where(has_words).drop("bands"), named, same, F.col("doc_id"), counts=classes.select(*same, "n_"))
    alone = sketched.where(~has_words).drop("bands").withColumn("component", F.lit(None).cast("bigint"))
    out = out.select(*alone.columns).unionByName(alone)
    component = F.coalesce("component", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that repeat another: one stays of each component.

    Only ids travel to find what goes; texts are shuffled once, in the final anti-join.
    Of rows with one id, the one of least text stays; rows without an id all stay.
    """
    found = write_read(near_duplicates(docs, words, percent, id_col, text_col), "near-duplicates")
    out = docs.join(found.where("not kept").select(id_col).distinct().hint("merge"), id_col, "left_anti").select(*docs.columns)
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    if again.isEmpty():
        return out
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    few = out.join(again, id_col, "left_semi").withColumn("row_", F.row_number().over(first)).where("row_ = 1").select(*docs.columns)
    return out.join(again, id_col, "left_anti").select(*docs.columns).unionByName(few)
