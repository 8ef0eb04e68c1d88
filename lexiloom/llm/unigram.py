"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; a Viterbi
pass carries, for each end, the best score and how many pieces led to it.  Ties
go to the piece that starts first, as scores are replaced only by greater ones
in order of their starts.  A character that no single piece covers costs the
lowest score less ten and counts as its UTF-8 bytes (byte pieces) or, without
byte pieces, as one unknown for each run of such characters.

Words are what the marker U+2581 starts: it stands for each space, and before
the text.  Each distinct word of a worker is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import claim, map_batches, slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 500_000


def zipf_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a SentencePiece file with log-probabilities by Zipf's law on their order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = log(sum(1 / (i + 2) for i in range(n)))
    return [(model.id_to_piece(i), -log(i + 2) - total) for i in range(n)]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        self.pieces = {p: s for p, s in vocabulary if p}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for p, s in self.pieces.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        """Pieces on the best path through one word."""
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(word):
            ends[end].append(piece)  # longest first: those that start first
        best, count, in_unknown = [0.0], [0], [False]
        for end, pieces in enumerate(ends):
            top, pick = 0.0, -1
            for length, own in pieces:
                score = best[end + 1 - length] + own
                if pick < 0 or score > top:
                    top, pick = score, length
            if not pieces or pieces[-1][0] != 1:  # no piece covers this one character
                score = best[end] + self.unknown
                if pick < 0 or score > top:
                    size = len(word[end].encode()) if self.bytes else int(not in_unknown[end])
                    best.append(score)
                    count.append(count[end] + size)
                    in_unknown.append(True)
                    continue
            best.append(top)
            count.append(count[end + 1 - pick] + 1)
            in_unknown.append(False)
        return count[n]

    def prepare(self, texts: list[str]) -> None:
        """Score all words of these texts that are not yet known."""
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        new: set[str] = set()
        for t in texts:
            new.update(self.words(t))
        for w in new.difference(self.known):
            self.known[w] = self.count_word(MARK + w)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their markers; none for the empty text."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        return parts[1:] if text[0] == " " else parts

    def count(self, text: str) -> int:
        """Pieces of a text given to ``prepare`` before."""
        return sum(map(self.known.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(zipf_vocabulary(path))


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens) of every whole text; null counts as empty, with 0 tokens.

    Rows are independent: no shuffle, and repeated rows give repeated results.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_chars bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("unigram", counter.cache_clear)
        model = counter(path)
        for batch in batches:
            texts = texts_of(batch, text_col)
            counts: list[int] = []
            for a, b in slices([len(t) for t in texts]):
                model.prepare(texts[a:b])
                counts += map(model.count, texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return map_batches(df, [id_col, text_col], run, schema)
