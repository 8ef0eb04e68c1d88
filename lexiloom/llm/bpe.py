"""Byte-pair encoding by backtracking, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's byte strings enumerates every
token that starts at each position.  The encoder walks left to right with the
longest token; a token may follow its predecessor only if merging could never
have joined bytes across their border, which the pair-compatibility table says.
Where no token fits, the walk steps back.  The result is the same as applying
the merges in rank order, in time linear in the text for bounded token lengths.

``decode`` gathers token bytes out of one blob through start offsets and
lengths, without touching tokens one by one.

Texts and tables of bytes only; no text is ever cut.  Empty text gives no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import IntMap, claim, map_batches, slices, texts_of

#: Fixed value: the split pattern of byte-level BPE tokenizers.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: No match of SPLIT crosses the start of a single space, so what stands between
#: spaces is encoded once and remembered.  Texts in which a space follows other
#: white space, or ends the text, are split as a whole.
UNSAFE = [s + " " for s in map(chr, range(0x3001)) if s.isspace()]
CACHE_ENTRIES = 300_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, made by their rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def mark_end(symbols: str) -> str:
    """The last symbol as one that ends a word."""
    return symbols[:-1] + chr(256 + ord(symbols[-1])) if symbols else symbols


def offset_table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One blob of all strings, with each one's start and length."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


def gather(ids: np.ndarray, blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The strings of ids, one after the other."""
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return b""
    return blob[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


class BacktrackingBpe:
    """Encoder and decoder for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.suffixed = bool(suffix)
        raw, symbols = {}, {}
        for token in vocab:
            ends = bool(suffix) and token.endswith(suffix)
            raw[token] = bytes(alphabet[c] for c in (token[: -len(suffix)] if ends else token))
            symbols[token] = mark_end(raw[token].decode("latin-1")) if ends else raw[token].decode("latin-1")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        merges = [m for m in merges if m[0] in vocab and m[1] in vocab and m[0] + m[1] in vocab]
        # Symbols are the text's alphabet: bytes and, with a suffix, bytes that end a word.
        # Ranks: single bytes first, then merged tokens in the order of their first merge.
        order = [t for t in vocab if len(raw[t]) == 1]
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(order))]
        rank = {t: i for i, t in enumerate(order)}
        self.joined: dict[tuple[int, int], int] = {}
        for left, right in merges:
            whole = left + right
            if whole not in rank:
                rank[whole] = len(order)
                order.append(whole)
                self.halves.append((rank[left], rank[right]))
            self.joined.setdefault((rank[left], rank[right]), rank[whole])
        self.ids = [vocab[t] for t in order]
        self.automaton = ahocorasick.Automaton()
        # Single symbols always match, so they are left out and put in where they stand.
        self.single = np.zeros(512, dtype=np.int64)
        for t, r in rank.items():
            if len(symbols[t]) == 1:
                self.single[ord(symbols[t])] = r
                continue
            self.automaton.add_word(symbols[t], (len(symbols[t]) << 18) | r)
        self.automaton.make_automaton()
        if len(order) >= 1 << 18 or max(map(len, raw.values())) > 255:
            raise ValueError("vocabulary too large for the packed automaton values")
        self.left, self.right = (np.array(x, dtype=np.int64) for x in zip(*self.halves, strict=True))
        self.pairs = IntMap(np.array([a * len(order) + b for a, b in self.joined]), np.array(list(self.joined.values()), dtype=np.int64), len(order) + 2)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        by_id = {vocab[t]: raw[t] for t in vocab} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(by_id) + 1
        strings = [by_id.get(i, b"") for i in range(self.size)]
        self.strings = offset_table(strings)
        self.decimals = offset_table([b"%d," % i for i in range(self.size)])
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def as_symbols(self, word: bytes) -> str:
        text = word.decode("latin-1")
        return mark_end(text) if self.suffixed else text

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between these two tokens.

        Both tokens are taken apart from the later merge backwards; a pair that
        would have merged across the border earlier than that makes it invalid.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, bound = left, right, len(self.halves) + 1
        fits = True
        while True:
            if self.joined.get((a, b), bound) < bound:
                fits = False
                break
            a_whole, b_whole = self.halves[a][1] == a, self.halves[b][0] == b
            if a_whole and b_whole:
                break
            if (a > b and not a_whole) or b_whole:
                bound, a = a, self.halves[a][1]
            else:
                bound, b = b + 1, self.halves[b][0]
        self.compatible[left, right] = fits
        return fits

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one piece between borders of SPLIT."""
        n = len(word)
        text = self.as_symbols(word)
        starting: list[list[tuple[int, int]]] = [[(1, int(self.single[ord(c)]))] for c in text]
        for end, value in self.automaton.iter(text):
            length, rank = value >> 18, value & 0x3FFFF
            starting[end - length + 1].append((length, rank))
        open_end = bytearray(b"\x01") * (n + 1)
        at, tried, found = 0, [len(s) - 1 for s in starting], []
        while at < n:
            options, k = starting[at], tried[at]
            while k >= 0:
                length, rank = options[k]
                if open_end[at + length] and (not found or self.may_follow(found[-1][1], rank)):
                    break
                k -= 1
            if k >= 0:
                tried[at] = k - 1
                found.append((at, rank))
                at += length
                if at < n:
                    tried[at] = len(starting[at]) - 1
            else:
                open_end[at] = 0
                at, _ = found.pop()
        return [self.ids[r] for _, r in found]

    def may_follow_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` for arrays of pairs."""
        n = len(self.halves)
        fits, rows = np.ones(len(a), dtype=bool), np.arange(len(a))
        bound = np.full(len(a), n + 1, dtype=np.int64)
        while len(rows):
            early = self.pairs.get(a * n + b) < bound
            fits[rows[early]] = False
            right, left = self.right[a], self.left[b]
            a_whole, b_whole = right == a, left == b
            from_a = ((a > b) & ~a_whole) | b_whole
            go = ~(early | (a_whole & b_whole))
            bound = np.where(from_a, a, b + 1)[go]
            a, b, rows = np.where(from_a, right, a)[go], np.where(from_a, b, left)[go], rows[go]
        return fits

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """``encode_word`` for many words, walked in step; ids as little-endian bytes."""
        text = "\u0300".join(map(self.as_symbols, words))
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        points = np.frombuffer(text.encode("utf-16-le"), dtype="<u2").astype(np.int64)
        plain = np.flatnonzero(points < 512)
        alone = (plain << 26) | (1 << 18) | self.single[points[plain]]
        key = np.sort(np.concatenate((((found[:, 0] - (found[:, 1] >> 18) + 1) << 26) | found[:, 1], alone)))
        start, length, rank = key >> 26, (key >> 18) & 255, key & 0x3FFFF
        n = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(n + 1) - 1
        begins = ends - n
        first = np.searchsorted(start, np.arange(len(text) + 2))
        tried = first[1:] - 1  # the longest option not yet tried at each place
        open_end = np.ones(len(text) + 2, dtype=bool)
        back = np.zeros(len(text) + 2, dtype=np.int64)
        token = np.zeros(len(text) + 2, dtype=np.int64)
        at, live = begins.copy(), np.flatnonzero(n > 0)
        while len(live) > 48:
            p = at[live]
            k = tried[p]
            some = k >= first[p]
            stuck, stuck_at = live[~some], p[~some]
            open_end[stuck_at] = False
            at[stuck] = back[stuck_at]
            w, p, k = live[some], p[some], k[some]
            tried[p] = k - 1
            r, e = rank[k], p + length[k]
            good = open_end[e]
            inner = np.flatnonzero(good & (p != begins[w]))
            good[inner] = self.may_follow_many(token[back[p[inner]]], r[inner])
            w, p, e = w[good], p[good], e[good]
            token[p], back[e], at[w] = r[good], p, e
            tried[e] = first[e + 1] - 1
            live = live[at[live] != ends[live]]
        taken = np.zeros(len(text) + 2, dtype=bool)
        done = np.ones(len(words), dtype=bool)
        done[live] = False
        w = np.flatnonzero(done & (n > 0))
        at = ends[w]
        while len(w):
            at = back[at]
            taken[at] = True
            more = at != begins[w]
            w, at = w[more], at[more]
        where = np.flatnonzero(taken)
        flat = np.array(self.ids, dtype="<u4")[token[where]].tobytes()
        a, b = (4 * np.searchsorted(where, begins)).tolist(), (4 * np.searchsorted(where, ends)).tolist()
        out = [flat[i:j] for i, j in zip(a, b, strict=True)]
        for i in live.tolist():
            out[i] = np.array(self.encode_word(words[i]), dtype="<u4").tobytes()
        return out

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of ' ' + chunk into the memory for all these chunks."""
        split = [[" " + c] if c.isalpha() else SPLIT.findall(" " + c) for c in chunks]
        new = list({w for s in split for w in s}.difference(self.words))
        for a, b in slices([len(w) for w in new], 1 << 20):
            self.words.update(zip(new[a:b], self.encode_words([w.encode() for w in new[a:b]]), strict=True))
        of = self.words.__getitem__
        self.chunks.update((c, b"".join(map(of, s))) for c, s in zip(chunks, split, strict=True))

    def forget(self) -> None:
        """Bound the memory; what a text needs is learnt anew after this."""
        if len(self.chunks) >= CACHE_ENTRIES:
            self.chunks.clear()
        if len(self.words) >= CACHE_ENTRIES:
            self.words.clear()

    def chunk_ids(self, chunk: str) -> bytes:
        words = SPLIT.findall(chunk)
        for w in words:
            if w not in self.words:
                self.words[w] = np.array(self.encode_word(w.encode()), dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def plain_ids(self, text: str) -> bytes:
        if any(s in text for s in UNSAFE) or text[-1:] == " ":
            return self.chunk_ids(text)
        head, *rest = text.split(" ")
        try:
            return self.chunk_ids(head) + b"".join(map(self.chunks.__getitem__, rest))
        except KeyError:
            self.forget()
            self.learn(list(set(rest).difference(self.chunks)))
        return self.chunk_ids(head) + b"".join(map(self.chunks.__getitem__, rest))

    def prepare(self, texts: list[str]) -> None:
        """Learn all unknown chunks of many texts at once."""
        self.forget()
        new: set[str] = set()
        for t in texts:
            new.update(t.split(" "))
        self.learn(list(new.difference(self.chunks)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; strings of special tokens in it become their ids."""
        if self.special_split is None or not any(s in text for s in self.special):
            return np.frombuffer(self.plain_ids(text), dtype="<u4")
        parts = [np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self.plain_ids(p) for p in self.special_split.split(text)]
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ids by gathering from the blob through the offset table."""
        return gather(ids, *self.strings)

    def decimal_bytes(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas, gathered like ``decode_bytes``."""
        return gather(ids, *self.decimals)[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")



@lru_cache(maxsize=2)
def tokenizer(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; a null text counts as empty.

    Rows are independent: no shuffle, repeated rows give repeated results, an
    empty table an empty one, and other columns are not read.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in batches:
            texts = texts_of(batch, text_col)
            for a, b in slices([len(t) for t in texts]):
                bpe.prepare(texts[a:b])
                ids = [bpe.encode(t).astype(np.int32) for t in texts[a:b]]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(id_col)[a:b], pa.ListArray.from_arrays(offsets, values)], names=[id_col, "ids"])

    return map_batches(df, [id_col, text_col], run, schema)


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded text) for rows of token ids; null ids count as none."""
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return map_batches(df, [id_col, ids_col], run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; (id, n_tokens, ids_sha256, decoded_sha256).

    The same encoder and decoder as above, fused so that ids never leave the
    worker: only digests travel back.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", tokenizer.cache_clear)
        bpe = tokenizer(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            texts = texts_of(batch, text_col)
            starts = dict(slices([len(t) for t in texts]))
            for i, text in enumerate(texts):
                if i in starts:
                    bpe.prepare(texts[i : starts[i]])
                ids = bpe.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.decimal_bytes(ids)).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=names)

    return map_batches(df, [id_col, text_col], run, schema)
