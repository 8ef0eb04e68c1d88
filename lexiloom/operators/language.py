"""Which language a text is in, by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams of one to three characters, in order.
A text's own order is compared with each profile: every n-gram costs the
difference of its two ranks, and one that the profile lacks costs the profile's size
(the out-of-place distance).  The language of least distance is taken.

Profiles are counted by Spark over the texts of known language: tasks count the n-grams
of a batch, and only these counts are shuffled.  Profiles are small whatever the
corpus: ``size`` rows a language, and their number is checked before they are sent to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

SIZE = 300
#: Languages that profiles may hold; more are an error, as every task holds all profiles.
MOST_LANGUAGES = 1000
#: Texts up to this length have too little to go by.
LEAST_CHARS = 100
#: Code points of a text whose n-grams are counted at a time.
PIECE = 1 << 20
#: Different letters up to which a text's n-grams are counted in an array of their cube.
MOST_LETTERS = 64


def letters_only(text: Column) -> Column:
    """Lower-case words between single spaces, with one at both ends."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]{2,}|[^\p{L} ]", " "))  # a space between letters stays as it is
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams and how often each occurs.

    A code holds three code points of 21 bits, the first one highest and missing ones
    zero, so that codes are in the order of their strings.  The bare space is no n-gram.
    """
    found: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(points) <= PIECE and len(points) and points.max() < 1 << 16:
        # Few letters: their places among those that occur are codes small enough to be counted without sorting.
        letters = np.append(0, np.flatnonzero(np.bincount(points)))
        k = len(letters)
        if k <= MOST_LETTERS and (k == 1 or letters[1] > 0):
            place = np.zeros(letters[-1] + 1, dtype=np.int64)
            place[letters] = np.arange(k)
            x = place[points]
            one, two = x * (k * k), (x[:-1] * k + x[1:]) * k
            n = np.bincount(np.concatenate((one[points != 32], two, two[:-1] + x[2:])), minlength=k**3)
            at = np.flatnonzero(n)
            return letters[at // (k * k)] << 42 | letters[at // k % k] << 21 | letters[at % k], n[at]
    for a in range(0, len(points), PIECE):
        x = points[a : a + PIECE + 2]
        own = min(PIECE, len(points) - a)
        one = x[:own] << 42
        two = (x[:-1] << 42 | x[1:] << 21)[:own]
        three = (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[:own]
        codes = np.concatenate((found[0], one[x[:own] != 32], two, three))
        weights = np.concatenate((found[1], np.ones(len(codes) - len(found[0]), dtype=np.int64)))
        unique, at = np.unique(codes, return_inverse=True)
        found = unique, np.bincount(at, weights=weights, minlength=len(unique)).astype(np.int64)
    return found


def first_grams(text: str, size: int) -> np.ndarray:
    """The most frequent n-grams in order; of equally frequent ones the lesser string comes first."""
    return in_order(*gram_counts(text))[:size]


def in_order(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """N-grams by falling frequency; equally frequent ones keep their order, which is that of their strings."""
    return codes[np.argsort((-n).astype(np.int16) if len(n) and n.max() < 1 << 15 else -n, kind="stable")]


def gram_text(code: int) -> str:
    points = (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF)
    return "".join(chr(p) for p in points if p)


def gram_code(gram: str) -> int:
    a, b, c = [*map(ord, gram), 0, 0][:3]
    return a << 42 | b << 21 | c


def fit_profiles(docs: DataFrame, size: int = SIZE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, rank): each language's ``size`` most frequent n-grams, ranked from 1.

    Rows without a language or text add nothing.
    """
    base = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), letters_only(F.col(text_col)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = Added()
            for lang, x in zip(batch.column("lang").to_pylist(), batch.column("x"), strict=True):
                if text := x.as_py():
                    added.add(lang, *gram_counts(text))
            yield pa.RecordBatch.from_arrays(added.columns(), names=["lang", "gram", "n"])

    return ranked(base.mapInArrow(run, "lang string, gram string, n bigint"), size)


class Added:
    """Counts of n-grams by language, added up whenever many have come together."""

    MOST = 1 << 20

    def __init__(self):
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held: dict[str, int] = {}

    def add(self, lang: str, codes: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault(lang, []).append((codes, n))
        self.held[lang] = self.held.get(lang, 0) + len(codes)
        if self.held[lang] > self.MOST:
            self.parts[lang], self.held[lang] = [self.total(lang)], 0

    def total(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*self.parts[lang], strict=True))
        order = np.argsort(codes, kind="stable")
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.diff(codes, prepend=-1))
        return codes[first], np.add.reduceat(n, first)

    def columns(self) -> list[pa.Array]:
        langs, grams, counts = [], [], []
        for lang in self.parts:
            codes, n = self.total(lang)
            langs += [lang] * len(codes)
            grams += [gram_text(c) for c in codes.tolist()]
            counts += n.tolist()
        return [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())]


def ranked(parts: DataFrame, size: int) -> DataFrame:
    """Profiles of counts (lang, gram, n) that are still to be added up."""
    counts = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return rank.where(F.col("rank") <= size).select("lang", "gram", "rank")


def detect_language(docs: DataFrame, profiles: DataFrame, size: int = SIZE, default: str | None = None, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, detected, distance, runner_up) for every row.

    ``distance`` is the out-of-place distance to the detected language, ``runner_up`` that to the
    next one (null with one profile).  Of equal distances the language of least name is taken.  Texts
    that are null, of ``least_chars`` characters at most, or without letters have ``default`` and no distance.
    """
    text = F.when(F.length(text_col) > least_chars, letters_only(F.col(text_col)))
    rows = docs.select(id_col, text.alias("x"))
    return _nearest(rows, profiles, size, default, lambda x: first_grams(x, size), id_col, docs.schema[id_col].dataType.simpleString())


def detect_own(docs: DataFrame, size: int = SIZE, default: str | None = None, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``detect_language`` by the profiles of the same texts (``fit_profiles``), whose n-grams are counted once for both.

    Each text's first n-grams are stored beside the counts of its language.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), letters_only(F.col(text_col)).alias("x"), F.coalesce(F.length(text_col) > least_chars, F.lit(False)).alias("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added, firsts = Added(), []
            for lang, x, long in zip(batch.column("lang").to_pylist(), batch.column("x"), batch.column("long").to_pylist(), strict=True):
                text, first = x.as_py(), None
                if text:
                    found = gram_counts(text)
                    if lang is not None:
                        added.add(lang, *found)
                    if long:
                        first = in_order(*found)[:size].astype("<i8").tobytes()
                firsts.append(first)
            ids = batch.column("id")
            none = [pa.nulls(len(ids), k) for k in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(firsts, pa.binary()), *none], names=["id", "x", "lang", "gram", "n"])
            parts = added.columns()
            n = len(parts[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.nulls(n, pa.binary()), *parts], names=["id", "x", "lang", "gram", "n"])

    made = stored(base.mapInArrow(run, f"id {kind}, x binary, lang string, gram string, n bigint"), "text-grams")
    rows = made.where("n is null").select(F.col("id").alias(id_col), "x")
    return _nearest(rows, ranked(made.where("n is not null"), size), size, default, lambda x: np.frombuffer(x, "<i8"), id_col, kind)


def _nearest(rows: DataFrame, profiles: DataFrame, size: int, default: str | None, first: Callable[[str | bytes], np.ndarray], id_col: str, kind: str) -> DataFrame:
    """``detect_language`` of rows (id, x), where ``first`` gives the n-grams of x in order; null and empty ones have the default."""
    found = profiles.limit(MOST_LANGUAGES * size + 1).collect()
    if len(found) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    tables: dict[str, dict[int, int]] = {}
    for r in found:
        tables.setdefault(r["lang"], {})[gram_code(r["gram"])] = r["rank"]
    names = sorted(tables)
    codes = [np.array(sorted(tables[x]), dtype=np.int64) for x in names]
    ranks = [np.array([tables[x][c] for c in own.tolist()], dtype=np.int64) for x, own in zip(names, codes, strict=True)]

    def distances(own: np.ndarray) -> list[int]:
        out = []
        for c, r in zip(codes, ranks, strict=True):
            at = np.minimum(np.searchsorted(c, own), len(c) - 1)
            apart = np.where(c[at] == own, np.abs(r[at] - np.arange(1, len(own) + 1)), size)
            out.append(int(apart.sum()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for x in batch.column("x"):
                x = x.as_py()
                if x and names:
                    far = distances(first(x))
                    best = min(range(len(far)), key=far.__getitem__)
                    rest = sorted(far[:best] + far[best + 1 :])
                    found.append((names[best], far[best], rest[0] if rest else None))
                else:
                    found.append((default, None, None))
            detected, near, next_ = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(detected, pa.string()), pa.array(near, pa.int64()), pa.array(next_, pa.int64())], names=[id_col, "detected", "distance", "runner_up"])

    return rows.mapInArrow(run, f"{id_col} {kind}, detected string, distance bigint, runner_up bigint")


def main_language(docs: DataFrame, lang_col: str = "lang") -> str | None:
    """The most frequent language of a corpus, of equally frequent ones that of least name; null if no row has one."""
    row = docs.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).first()
    return row[0] if row else None


def require_same_language(target: DataFrame, reference: DataFrame, lang_col: str = "lang") -> None:
    """Refuse a comparison of corpora in different languages; a corpus of unknown language may be compared with any."""
    a, b = main_language(target, lang_col), main_language(reference, lang_col)
    if a is not None and b is not None and a != b:
        raise ValueError(f"target corpus is in {a!r}, reference corpus in {b!r}")
