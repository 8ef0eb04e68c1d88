"""Near-duplicate documents by SimHash and a hierarchical index in Gray order.

A fingerprint has the bits that over half of a text's shingle hashes have.  Two
fingerprints that differ in ``differ`` bits at most agree in one of ``differ + 1``
segments, so every fingerprint stands in that many blocks, one for each segment's value:
the block's shared bits are the root pattern of its index.  Within a block,
fingerprints are sorted by their rank in the reflected Gray code, in which neighbours
differ in few bits, and consecutive ones form groups.  A group's node holds the bits
that all its members share (pattern and mask); pairs of groups whose shared bits differ
too much are dropped before any member is shuffled.  Within a task the groups' inner nodes
are built the same way, of ``FAN`` children each, and a pair of nodes is followed
downwards with the differences counted so far: a child adds only the bits that its
parents did not share yet, and the pair is dropped when the sum exceeds ``differ``.
Pairs of nodes whose members are all connected already are dropped too, so a
group of near copies costs about one pass.  Tasks give spanning edges, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, map_batches, spread_join, write_read
from .graphs import components

SEED = 42
#: Children of a node; pairs of nodes expanded at a time; codes searched at a time.
FAN, CHUNK, RUN = 8, 4096, 1 << 16
#: Bytes of a text cut into words at a time, and shingles counted at a time.
PIECE, STEP = 1 << 20, 1 << 15
#: Members of a group: at least, at most, and times the mean size of a block.
GROUP_LEAST, GROUP_MOST, GROUP_MEAN = 2048, 1 << 18, 4

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles of ``words`` words, repeats included, a bounded part at a time.

    A text of fewer words gives its whole sequence; one without words gives nothing.
    """
    held, any_, begin = [], False, 0
    while begin < len(text):
        cut = SPACE.search(text, min(len(text), begin + PIECE))
        end = cut.start() if cut else len(text)
        held += text[begin:end].translate(LOWER).split()
        begin = end
        for a in range(0, max(0, len(held) - words + 1), STEP):
            run = held[a : a + STEP + words - 1]
            joined = b" ".join(run)
            ends = [e - 1 for e in accumulate(len(w) + 1 for w in run)]
            starts = [0, *(e + 1 for e in ends)]
            yield np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)), dtype=U)
            any_ = True
        held = held[max(0, len(held) - words + 1) :]
    if held and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=U)


def fingerprint(text: bytes, words: int) -> int:
    """The 64 majority bits of the text's shingle hashes; zero without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def fingerprints(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, code): each row's fingerprint as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            codes = np.array([fingerprint(t.as_py() or b"", words) for t in texts], dtype=U)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(codes.view(np.int64))], names=[id_col, "code"])

    return map_batches(df, [id_col, text_col], run, f"{id_col} {kind}, code bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Places of the codes in the reflected Gray code: every bit becomes the parity of those from the top to it."""
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> U(s))
    return codes


def segments(differ: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of ``differ + 1`` runs of the 64 bits, as even as can be."""
    edges = [64 * i // (differ + 1) for i in range(differ + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def dealt(classes: DataFrame, differ: int) -> DataFrame:
    """(block, rank, node): each code once for every segment, turned so that the segment comes first.

    ``rank`` is the Gray rank of the turned code with its top bit flipped, so that signed order is Gray order.
    """
    cuts = segments(differ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_numpy().view(U)
            for i, (first, width) in enumerate(cuts):
                turned = (codes << U(first)) | (codes >> U(64 - first)) if first else codes
                block = (turned >> U(64 - width)).astype(np.int64) + (i << 32)
                rank = gray_rank(turned) ^ U(1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(rank.view(np.int64)), batch.column("node")], names=["block", "rank", "node"])

    return map_batches(classes, ["code", "node"], run, "block bigint, rank bigint, node bigint")


def grouped(rows: DataFrame, most: int) -> DataFrame:
    """(block, rank, node, group, turned): consecutive rows of a block in Gray order, ``most`` to a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = TaskContext.get().partitionId() << 33
        last, n, base = None, 0, begun
        for batch in batches:
            block = batch.column("block").to_numpy()
            names = np.empty(len(block), dtype=np.int64)
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if block[a] != last:
                    last, n, base = block[a], 0, begun
                names[a:b] = base + (n + np.arange(b - a)) // most
                n, begun = n + int(b - a), int(names[b - 1]) + 1
            rank = batch.column("rank").to_numpy().view(U) ^ U(1 << 63)
            turned = rank ^ (rank >> U(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "rank", "node")), pa.array(names), pa.array(turned.view(np.int64))], names=["block", "rank", "node", "group", "turned"])

    in_order = rows.repartitionByRange("block", "rank").sortWithinPartitions("block", "rank")
    return map_batches(in_order, ["block", "rank", "node"], run, "block bigint, rank bigint, node bigint, group bigint, turned bigint")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; every member's label becomes its component's least place."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


class Forest:
    """Trees of shared bit patterns over codes in Gray order; ``tree`` numbers the codes' trees from 0, ascending."""

    def __init__(self, codes: np.ndarray, tree: np.ndarray):
        self.label = np.arange(len(codes))
        self.patterns, self.masks, self.edges = [codes], [np.full(len(codes), FULL)], [np.arange(len(codes) + 1)]
        low = high = codes
        trees = int(tree[-1]) + 1 if len(tree) else 0
        while len(low) > trees:
            place = np.arange(len(tree)) - np.searchsorted(tree, tree)
            heads = np.flatnonzero(place % FAN == 0)
            low, high, tree = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads), tree[heads]
            self.masks.append(~(low ^ high))
            self.patterns.append(low & self.masks[-1])
            self.edges.append(np.append(heads, len(place)))

    def connected(self) -> list[np.ndarray]:
        """For each level, the component of each node's codes, or -1 if they are in several."""
        low = high = self.label
        out = [low]
        for edges in self.edges[1:]:
            low, high = np.minimum.reduceat(low, edges[:-1]), np.maximum.reduceat(high, edges[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def link(self, a: np.ndarray, b: np.ndarray, differ: int) -> np.ndarray:
        """Labels after joining all codes of trees a[i] and b[i] (or of one tree, if they are equal) that differ in few bits."""
        top = len(self.patterns) - 1
        far = np.bitwise_count((self.patterns[top][a] ^ self.patterns[top][b]) & self.masks[top][a] & self.masks[top][b])
        keep = far <= differ
        stack = [(top, a[keep], b[keep], far[keep])]
        known, tested, joined = self.connected(), 0, False
        while stack:
            level, a, b, far = stack.pop()
            if len(a) > CHUNK:
                stack.append((level, a[CHUNK:], b[CHUNK:], far[CHUNK:]))
                a, b, far = a[:CHUNK], b[:CHUNK], far[:CHUNK]
            if joined and tested > len(self.label):
                known, tested, joined = self.connected(), 0, False
            new = (known[level][a] != known[level][b]) | (known[level][a] < 0)
            a, b, far = a[new], b[new], far[new]
            if not len(a):
                continue
            if level == 0:
                unite(self.label, a, b)
                joined = True
                continue
            edges = self.edges[level]
            wide, high = edges[b + 1] - edges[b], edges[a + 1] - edges[a]
            pair = np.repeat(np.arange(len(a)), wide * high)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
            x, y = edges[a][pair] + place // wide[pair], edges[b][pair] + place % wide[pair]
            once = (a[pair] != b[pair]) | (x <= y)
            if level == 1:
                once &= x != y
            pair, x, y = pair[once], x[once], y[once]
            shared = self.masks[level][a] & self.masks[level][b]
            patterns, masks = self.patterns[level - 1], self.masks[level - 1]
            more = np.bitwise_count((patterns[x] ^ patterns[y]) & masks[x] & masks[y] & ~shared[pair])
            total = far[pair] + more
            keep = total <= differ
            x, y, total = x[keep], y[keep], total[keep]
            tested += len(pair)
            own = x == y
            # What is taken first: pairs of a node with itself, as they connect most.
            stack.append((level - 1, x[~own], y[~own], total[~own]))
            stack.append((level - 1, x[own], y[own], total[own]))
        return self.label


def search(rows: DataFrame, differ: int) -> DataFrame:
    """(a, b) spanning edges of the codes that differ in few bits, within each pair of groups.

    Rows are (first, second, group, turned, node), of which (first, second) names a pair of groups.
    """

    def found(keys: np.ndarray, codes: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        change = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
        tree = np.cumsum(change) - 1
        heads = np.flatnonzero(change)
        first, second, group = keys[heads].T
        own = np.flatnonzero(first == second)
        # A pair of two groups is two trees, one after the other.
        cross = np.flatnonzero((first != second) & (group == first))
        a, b = np.concatenate((own, cross)), np.concatenate((own, cross + 1))
        label = Forest(codes, tree).link(a, b, differ)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        held: list[tuple[np.ndarray, ...]] = []
        n, enough = 0, RUN

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("first", "second", "group")], axis=1)
            held.append((keys, batch.column("turned").to_numpy().view(U), batch.column("node").to_numpy()))
            n += len(keys)
            if n >= enough:
                keys, codes, nodes = joined()
                cut = int(np.flatnonzero((keys[:, :2] != keys[-1, :2]).any(axis=1))[-1]) + 1 if (keys[0, :2] != keys[-1, :2]).any() else 0
                held = [(keys[cut:], codes[cut:], nodes[cut:])]
                n = len(keys) - cut
                enough = RUN if cut else 2 * n
                if cut:
                    yield found(keys[:cut], codes[:cut], nodes[:cut])
        if n:
            yield found(*joined())

    return rows.repartition("first", "second").sortWithinPartitions("first", "second", "group", "rank").drop("rank").mapInArrow(run, "a bigint, b bigint")


def close_codes(classes: DataFrame, differ: int, group_least: int = GROUP_LEAST) -> DataFrame:
    """(a, b) spanning edges between the nodes of (code, node) whose codes differ in ``differ`` bits at most."""
    rows = write_read(dealt(classes, differ), "gray-blocks")
    blocks, n = rows.agg(F.approx_count_distinct("block"), F.count("*")).first()
    most = min(GROUP_MOST, max(group_least, GROUP_MEAN * n // max(1, blocks)))
    members = write_read(grouped(rows, most), "gray-groups")
    low, high = F.bit_and("turned"), F.bit_or("turned")
    nodes = write_read(members.groupBy("block", "group").agg(low.alias("pattern"), F.bitwise_not(low.bitwiseXOR(high)).alias("mask")), "gray-nodes")
    left = nodes.select("block", F.col("group").alias("first"), F.col("pattern").alias("pattern_"), F.col("mask").alias("mask_"))
    apart = F.col("pattern").bitwiseXOR(F.col("pattern_")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_"))
    pairs = left.join(nodes.withColumnRenamed("group", "second").hint("merge"), "block").where((F.col("first") <= F.col("second")) & (F.bit_count(apart) <= differ)).select("first", "second")
    sides = pairs.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("group"))
    return search(members.join(sides.hint("merge"), "group").select("first", "second", "group", "rank", "turned", "node"), differ)


def simhash_duplicates(df: DataFrame, words: int = 4, differ: int = 4, id_col: str = "doc_id", text_col: str = "text", group_least: int = GROUP_LEAST) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    Fingerprints are linked if they differ in ``differ`` bits at most; ``component_id`` is
    the least id reachable.  Texts that are null, empty or without words have the
    fingerprint zero and are linked like any other.  Rows with one id are one document of that
    id.  Rows without an id have a fingerprint, are linked with nothing and have no component.
    An empty table gives no rows; further columns are not read.
    """
    base = df.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).alias("text_"))
    coded = write_read(fingerprints(base, words, "id_", "text_"), "simhashes")
    known = coded.where("id_ is not null")
    classes = write_read(known.groupBy("code").agg(F.min("id_").alias("node"), F.count("*").alias("n_")), "simhash-classes")
    # A document with several rows may be the least of several fingerprints, and connects them.
    linked = components(close_codes(classes, differ, group_least).unionByName(_repeated(known, classes)))
    named = classes.select("code", "node").join(linked.hint("merge"), "node", "left").select("code", F.coalesce("component", "node").alias("component"))
    out = spread_join(known, write_read(named, "simhash-named"), ["code"], F.col("id_"), counts=classes.select("code", "n_"))
    alone = coded.where("id_ is null").withColumn("component", F.lit(None).cast("bigint"))
    fingerprint_ = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return out.select("id_", "code", "component").unionByName(alone.select("id_", "code", "component")).select(F.col("id_").alias(id_col), fingerprint_, F.col("component").alias("component_id"))


def _repeated(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) edges between the classes that rows of one id are in."""
    again = known.groupBy("id_").agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n_")).where("n_ > 1 and low != high").select("id_")
    rows = known.join(again.hint("merge"), "id_", "left_semi").distinct()
    return rows.join(classes.select("code", "node").hint("merge"), "code").select(F.col("id_").alias("a"), F.col("node").alias("b")).where("a != b")
