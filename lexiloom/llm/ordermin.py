"""Order MinHash fingerprints of whole texts.

A text's k-mers of code points are numbered by occurrence, so that repeats are
distinct.  For each of m hash functions the l numbered k-mers of least value are
selected, put back into text order, and hashed as a tuple.  Two texts agree in
an entry only if the same k-mers stand in the same order, so the share of equal
entries falls with edit distance and not only with the overlap of k-mer sets.
Each hash function multiplies by and adds its own 64-bit values; k-mers are ranked in
slices, so a long text needs no more working memory than a short one.

``fingerprint_edits`` also fingerprints each document's edited text, made with its
successor in id order, shuffling the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_read
from .hashing import U, constants, mix

K, TUPLE, ENTRIES = 12, 2, 64
#: K-mers that are ranked at a time.
SLICE = 2048


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """32-bit hashes of (k-mer, occurrence), in text order; a shorter text is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U) + U(1)
    n = len(points)
    if not n:
        return np.zeros(0, np.uint32)
    width = min(k, n)
    keys = constants(width, 41) | U(1)
    count = n - width + 1
    rolled = points[:count] * keys[0]
    for i in range(1, width):
        rolled += points[i : i + count] * keys[i]
    rolled = mix(rolled)
    # Sort (hash, place) as one number: equal k-mers stand together in text order.
    bits = U(max(1, int(count - 1).bit_length()))
    place_mask = (U(1) << bits) - U(1)
    packed = np.sort((rolled & ~place_mask) | np.arange(count, dtype=U))
    new = np.flatnonzero(np.diff(packed >> bits, prepend=packed[:1] >> bits))
    out = (rolled >> U(32)).astype(np.uint32)
    if len(new) < count - 1:  # some k-mer occurs again
        starts = np.concatenate(([0], new))
        number = np.arange(count) - np.repeat(starts, np.diff(np.concatenate((starts, [count]))))
        again = np.flatnonzero(number)
        where = (packed[again] & place_mask).astype(np.int64)
        out[where] = (mix(rolled[where] + number[again].astype(U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)
    return out


def least_places(base: np.ndarray, size: int, entries: int) -> np.ndarray:
    """For each hash function, the places of the ``size`` k-mers of least rank, of equal ranks the first."""
    times, plus = constants(entries, 43)[:, None] | U(1), constants(entries, 53)[:, None]
    rows = np.arange(entries)[:, None]
    ranks, places = np.zeros((entries, 0), U), np.zeros((entries, 0), np.int64)
    for begin in range(0, len(base), SLICE):
        own = base[None, begin : begin + SLICE].astype(U) * times + plus
        picked, values = [], []
        for _ in range(min(size, own.shape[1])):
            least = own.argmin(axis=1)[:, None]
            picked.append(least)
            values.append(own[rows, least])
            own[rows, least] = np.iinfo(U).max
        # Of earlier slices and this one, the least; a stable order keeps the first of equals.
        ranks, places = np.concatenate([ranks, *values], axis=1), np.concatenate([places, *(p + begin for p in picked)], axis=1)
        order = np.argsort(ranks, axis=1, kind="stable")[:, :size]
        ranks, places = ranks[rows, order], places[rows, order]
    return places


def signature(text: str, k: int = K, size: int = TUPLE, entries: int = ENTRIES) -> np.ndarray:
    """The text's tuples as 16-bit hashes; a text with fewer k-mers than ``size`` uses what it has."""
    base = numbered_kmers(text, k)
    if not len(base):
        return np.zeros(entries, np.uint16)
    places = np.sort(least_places(base, size, entries), axis=1)
    keys = constants(size, 47) | U(1)
    total = np.zeros(entries, dtype=U)
    for j in range(places.shape[1]):
        total += mix(base[places[:, j]].astype(U)) * keys[j]
    return (mix(total + U(places.shape[1])) >> U(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries."""
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT_SQL = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = own if edited == text else signature(edited)
    return len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(own), to_hex(changed), likeness(own, changed), likeness(own, next_own)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, with likenesses.

    Texts are range-partitioned and sorted by id once; each task streams its range
    with one document of lookahead.  Only the first and the last document of each
    range meet in a second step, which joins every range's last to the next range's
    first (the very last to the very first).  Null texts are empty.  Null ids come
    first; rows of one id follow each other by text.  Empty texts are alike.
    """
    kind = df.schema[id_col].dataType.simpleString()
    base = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = base.repartitionByRange(id_col).sortWithinPartitions(id_col, "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = ["part", "role", id_col, *(n for n, _ in RESULT), "text"]
        blank = (None,) * len(RESULT)
        held = None
        id_type = None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            kinds = [pa.int32(), pa.int32(), id_type, *(k for _, k in RESULT), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            found = []
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = signature(text)
                if held is None:
                    found.append((task, 1, i, *blank, text))
                else:
                    found.append((task, 0, held[0], *compare_with_next(held[1], held[2], text, own), None))
                held = (i, text, own)
            yield rows(found)
        if held is not None:
            yield rows([(task, 2, held[0], *blank, held[1])])

    stored = write_read(ranged.mapInArrow(stream, f"part int, role int, {id_col} {kind}, {RESULT_SQL}, text string"), "order-minhash")
    names = [id_col, *(n for n, _ in RESULT)]
    heads = stored.where("role = 1")
    # One row for each range, so this window has as many rows as there are tasks.
    order = Window.orderBy("part")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(everything)).alias("next"))
    ends = stored.where("role = 2").select("part", id_col, "text").join(after, "part")
    ends = ends.join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select(id_col, "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compare_with_next(t, signature(t), f, signature(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * len(RESULT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, RESULT, strict=True))], names=names)

    return stored.where("role = 0").select(*names).unionByName(ends.mapInArrow(finish, f"{id_col} {kind}, {RESULT_SQL}"))
