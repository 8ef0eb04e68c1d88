"""Best-fit packing of token sequences by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (``capacity`` counts, whatever the size of the corpus) reaches the
driver.  There, patterns of few pieces that fill a sequence, or leave little room, are
enumerated by size; non-negative least squares fits how often to repeat each, so that
the histogram is used up; the counts are rounded; and what remains is packed by best
fit, again on counts of equal lengths, first into the room that patterns left.  The
result is a table of runs (length, first rank, place of a piece in its pattern), and
each piece finds its sequence by its rank among the pieces of its length.  Ranks come
from counts by (task, length), so neither a hot length nor a hot source meets in one task.
"""

from __future__ import annotations

import json
import logging
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, map_batches, slices, text_slices, write_read

log = logging.getLogger(__name__)
#: Most pieces of a pattern, and the share of a sequence that it may leave, of the plans that are compared.
PLANS = ((8, 32), (3, 32), (3, 8))
CACHE_ENTRIES, WORD_ENTRIES = 200_000, 500_000
#: Texts with these go to the tokenizer whole: they split Python's words, not its own.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Fixed value: the split pattern of this kind of vocabulary, applied to lower-cased text.
#: Texts with these go through the memory of chunks.
ODD = re.compile("[\u2000-\U0010ffff\u03a3\u0130\x1c-\x1f]|<\\|")
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: The same for letters below U+0180 where no other number than the ten digits occurs.
LATIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
NOT_LATIN = re.compile("[\u0180-\uffff\u00b2\u00b3\u00b9\u00bc-\u00be]")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class ChunkTokenizer:
    """Ids of whole texts through memories of words and space-free chunks.

    For vocabularies whose pre-tokenizer drops white space, a text's ids are the
    ids of its words in turn.  Texts of the common alphabets are composed, lower-cased
    and split here; the library encodes their new words many at a time, between spaces,
    and the tokens that close a word cut its answer.  Other texts are the ids of their
    chunks in turn.  Chunks of the common alphabets are composed, lower-cased and split
    in the same way; all others are encoded by the library, one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        end = self.tokenizer.model.end_of_word_suffix or ""
        self.closes[[i for w, i in vocabulary.items() if end and w.endswith(end)]] = True
        self.own_split = self._splits_as_expected(path)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _splits_as_expected(path: str) -> bool:
        """Whether the file says what ``parts`` does; if not, the library encodes everything."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex", "") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and any(x.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == PARTS.pattern for x in splits)

    def parts(self, chunk: str) -> list[str] | None:
        """Words of a chunk after normalisation; None if the library has to say."""
        if not chunk.isascii():
            if max(chunk) >= "\u2000" or "\u03a3" in chunk or "\u0130" in chunk:
                return None
            chunk = unicodedata.normalize("NFC", chunk)
        if "<|" in chunk:
            return None
        chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else PARTS.findall(chunk)

    def words_of(self, text: str) -> list[str] | None:
        """Words of a whole text after normalisation; None if it goes by chunks."""
        if not self.own_split or ODD.search(text):
            return None
        if text.isascii():
            return ASCII_PARTS.findall(text.lower())
        text = unicodedata.normalize("NFC", text).lower()
        return (PARTS if NOT_LATIN.search(text) else LATIN_PARTS).findall(text)

    def learn(self, words: list[str]) -> None:
        """Put the ids of normalised words into the memory."""
        for a, b in slices([len(w) for w in words], 1 << 20):
            own = words[a:b]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(own):
                flat, cuts = ids.tobytes(), (4 * ends).tolist()
                self.words.update(zip(own, (flat[i:j] for i, j in zip([0, *cuts], cuts)), strict=True))
            else:  # a vocabulary whose words do not end in a token of their own
                self.words.update((w, array("I", e.ids).tobytes()) for w, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if len(self.words) >= WORD_ENTRIES:
            self.words.clear()
        split = [self.words_of(t) for t in texts]
        new: set[str] = set()
        new.update(*(w for w in split if w is not None))
        self.learn(list(new.difference(self.words)))
        self.prepare([t for t, w in zip(texts, split, strict=True) if w is None])
        of = self.words.__getitem__
        return [self.encode(t) if w is None else b"".join(map(of, w)) for t, w in zip(texts, split, strict=True)]

    def prepare(self, texts: list[str]) -> None:
        """Learn all unknown chunks of many texts at once."""
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        new: set[str] = set()
        for t in texts:
            new.update(t.split())
        split = {c: self.parts(c) if self.own_split else None for c in new.difference(self.known)}
        self.learn(list({w for p in split.values() if p for w in p}.difference(self.words)))
        of = self.words.__getitem__
        self.known.update((c, of(p[0]) if len(p) == 1 else b"".join(map(of, p))) for c, p in split.items() if p is not None)
        rest = [c for c, p in split.items() if p is None]
        for a, b in slices([len(c) for c in rest], 1 << 18):
            for c, e in zip(rest[a:b], self.tokenizer.encode_batch_fast(rest[a:b], add_special_tokens=False), strict=True):
                self.known[c] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian ids of a text given to ``prepare`` before."""
        if any(c in text for c in ODD_SPACE):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, text.split()))


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokenized_pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 and, if asked, ids.

    ``task`` and ``seq`` number the pieces of one length within a task.  A null
    text counts as empty and gives one piece that holds ``end_id`` only.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, seq bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("packing", chunk_tokenizer.cache_clear)
        task = TaskContext.get().partitionId()
        tok, seen = chunk_tokenizer(path), np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for a, _, texts in text_slices(batch, text_col, 1 << 20):
                rows, out = [], defaultdict(list)
                for i, own in enumerate(tok.encode_many(texts), a):
                    ids = own + tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        n = len(part) // 4
                        rows.append(i)
                        out["piece"].append(k)
                        out["start"].append(at // 4)
                        out["length"].append(n)
                        out["ids_crc32"].append(zlib.crc32(part))
                        out["seq"].append(int(seen[n]))
                        seen[n] += 1
                        if with_ids:
                            out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                columns = [batch.column(id_col).take(pa.array(rows)), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")), pa.array([task] * len(rows), pa.int32()), pa.array(out["seq"], pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32", "task", "seq"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(df, [id_col, text_col], run, schema)


class PatternSearch:
    """Patterns of a histogram's lengths and how often each fits what those before it left.

    Single pieces and pairs are enumerated completely, by the room that they leave.  Larger
    patterns fill a sequence exactly: for each first length, from the longest, the most
    plentiful lengths of middling size and of all pairs that sum to the rest the one
    with the most pieces.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.found = capacity, {}
        self.rest = np.zeros(capacity + 1, dtype=np.int64)
        for n, c in histogram.items():
            self.rest[n] = c

    def note(self, pattern: tuple[int, ...], times: int) -> None:
        self.found[pattern] = self.found.get(pattern, 0) + times
        for n in pattern:
            self.rest[n] -= times

    def take(self, pattern: tuple[int, ...]) -> int:
        times = min(int(self.rest[n]) // pattern.count(n) for n in set(pattern))
        if times > 0:
            self.note(pattern, times)
        return times

    def pairs(self, room: int) -> None:
        """All patterns of one or two pieces that leave so much room."""
        total = self.capacity - room
        if self.rest[total] > 0:
            self.note((total,), int(self.rest[total]))
        a = np.arange(total // 2 + 1, total)
        both = np.minimum(self.rest[a], self.rest[total - a])
        for i in np.flatnonzero(both).tolist():
            self.note((int(a[i]), total - int(a[i])), int(both[i]))
        if total % 2 == 0 and self.rest[total // 2] > 1:
            self.note((total // 2,) * 2, int(self.rest[total // 2]) // 2)

    def last_pair(self, total: int, longest: int) -> tuple[int, int] | None:
        """Two lengths of this sum with the most pieces to pair."""
        low, high = (total + 1) // 2, min(longest, total - 1)
        if low > high:
            return None
        both = np.minimum(self.rest[low : high + 1], self.rest[total - high : total - low + 1][::-1])
        if 2 * low == total:
            both[0] = self.rest[low] // 2
        i = int(both.argmax())
        return (low + i, total - low - i) if both[i] > 0 else None

    def larger(self, size: int, first: int) -> None:
        """Patterns of ``size`` pieces that begin with the length ``first``, until none is left."""
        while self.rest[first] > 0:
            pattern, total = [first], self.capacity - first
            for _ in range(size - 3):
                mean = total // (size - len(pattern))
                low, high = max(1, mean // 2), min(first, 2 * mean, total - 2)
                own = self.rest[low : high + 1].copy()
                for n in pattern:
                    if low <= n <= high:
                        own[n - low] -= 1
                if not len(own) or own.max() <= 0:
                    return
                pattern.append(low + int(own.argmax()))
                total -= pattern[-1]
            two = self.last_pair(total, first)
            if two is None or not self.take(tuple(sorted((*pattern, *two), reverse=True))) > 0:
                return


def few_piece_patterns(histogram: dict[int, int], capacity: int, size: int, most_room: int) -> dict[tuple[int, ...], int]:
    """Patterns of at most ``size`` pieces and a first guess of their counts."""
    search = PatternSearch(histogram, capacity)
    for room in range(min(most_room, capacity - 1) + 1):
        search.pairs(room)
    for k in range(3, size + 1):
        for first in sorted(histogram, reverse=True):
            search.larger(k, first)
    return search.found


def fit_counts(patterns: list[tuple[int, ...]], histogram: dict[int, int], start: list[float] | None = None, sweeps: int = 200) -> list[float]:
    """Non-negative least squares by accelerated projected gradient steps.

    Minimises the squared difference between the histogram and what the repeated
    patterns use; a pattern's step is bounded by what all patterns use of its lengths.
    """
    if not patterns:
        return []
    at = {n: i for i, n in enumerate(histogram)}
    want = np.array(list(histogram.values()), dtype=float)
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    uses = np.array([at[n] for p in patterns for n in p])
    bound = np.bincount(of, np.bincount(uses, minlength=len(want))[uses])
    x = ahead = np.zeros(len(patterns)) if start is None else np.array(start, dtype=float)
    pace = 1.0
    for _ in range(sweeps):
        rest = want - np.bincount(uses, ahead[of], len(want))
        step = np.bincount(of, rest[uses])
        new = np.maximum(0, ahead + step / bound)
        if step @ (new - x) < 0:
            pace = 1.0
        following = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = np.maximum(0, new + (pace - 1) / following * (new - x))
        if np.abs(new - x).sum() < 1e-4 * max(1.0, new.sum()):
            return new.tolist()
        x, pace = new, following
    return x.tolist()


def best_fit(counts: dict[int, int], capacity: int, begun: list[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: (pattern, repeats), longest lengths first, also into the room of those begun."""
    open_by_room: dict[int, list[list]] = defaultdict(list)  # room -> groups [pattern, repeats]
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], repeats: int) -> None:
        if not room:
            done.append((pattern, repeats))
            return
        if not open_by_room[room]:
            at = bisect_left(rooms, room)
            if at == len(rooms) or rooms[at] != room:
                rooms.insert(at, room)
        open_by_room[room].append([pattern, repeats])

    for pattern, repeats in begun:
        put(capacity - sum(pattern), pattern, repeats)
    for n in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if left >= each:
                    put(capacity - each * n, (n,) * each, left // each)
                if left % each:
                    put(capacity - (left % each) * n, (n,) * (left % each), 1)
                break
            room = rooms[at]
            pattern, repeats = open_by_room[room][-1]
            take = min(repeats, left)
            if take == repeats:
                open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(at)
            else:
                open_by_room[room][-1][1] -= take
            left -= take
            put(room - n, (*pattern, n), take)
    for groups in open_by_room.values():
        done += [(p, r) for p, r in groups]
    return done


def fitted_fill(histogram: dict[int, int], capacity: int, size: int, most_room: int) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Fitted patterns, those of few pieces first, each as often as its rounded count and the
    pieces left allow; the residual by best fit.  Also the number of pieces in fitted patterns."""
    guess = few_piece_patterns(histogram, capacity, size, most_room)
    patterns = list(guess)
    fitted = fit_counts(patterns, histogram, [guess[p] for p in patterns])
    rest, chosen, placed = dict(histogram), [], 0
    for j in sorted(range(len(patterns)), key=lambda j: (len(patterns[j]), -fitted[j], patterns[j])):
        pattern = patterns[j]
        times = min(int(fitted[j] + 0.5), *(rest[n] // pattern.count(n) for n in pattern))
        if times > 0:
            chosen.append((pattern, times))
            placed += times * len(pattern)
            for n in pattern:
                rest[n] -= times
    return best_fit(rest, capacity, chosen), placed


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, repeats, first sequence, offset) that place every piece.

    Every plan of PLANS is fitted patterns and best fit of their residual; that of the
    fewest sequences is taken, of equal ones the first.
    """
    plans = [fitted_fill(histogram, capacity, size, capacity // share) for size, share in PLANS]
    chosen, placed = min(plans, key=lambda p: sum(r for _, r in p[0]))
    log.info("packing: %d sequences; %d of %d pieces in fitted patterns", sum(r for _, r in chosen), placed, sum(histogram.values()))
    used, runs, sequence = defaultdict(int), [], 0
    for pattern, repeats in chosen:
        offset = 0
        for n in pattern:
            runs.append((n, used[n], repeats, sequence, offset))
            used[n] += repeats
            offset += n
        sequence += repeats
    return runs


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with ``length``, ``task`` and ``seq``.

    ``pieces`` must be a stored table (it is read twice).  The plan has a few runs
    for each length at most and its size is bounded by the capacity, not by the
    number of rows, so it and the counts by length are sent to all tasks.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # One row for each (length, task); the running sum within a length gives first ranks.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)
    by_length: dict[int, list] = defaultdict(list)
    for n, start, repeats, sequence, offset in runs:
        by_length[n].append((start, sequence, offset))
    table = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for n, v in by_length.items()}
    sent = spark.sparkContext.broadcast(table)
    # First ranks grow with the number of tasks, so they are never broadcast.
    ranked = pieces.join(first.select("length", "task", "first").hint("merge"), ["length", "task"]).withColumn("rank", F.col("first") + F.col("seq")).drop("first", "task", "seq")
    names = [f.name for f in ranked.schema if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(own):
                    continue
                starts, sequences, offsets = sent.value[int(length[own[0]])]
                at = np.searchsorted(starts, rank[own], side="right") - 1
                sequence[own] = sequences[at] + rank[own] - starts[at]
                offset[own] = offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack all documents: one row for each piece with its place.

    Nulls: a null text is an empty one, a null id is kept.  Repeated rows are packed
    as often as they occur.  An empty table gives no rows.  Ties between pieces of
    one length follow the tasks' order, which does not change the number of sequences.
    """
    pieces = write_read(tokenized_pieces(df, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity)
