"""Vectorised hashing of words and shingles.

Words are hashed by a polynomial over random 64-bit values of their bytes,
evaluated for all words of a batch through prefix sums modulo 2**64, and then
mixed.  A batch is a list of whole texts; results never depend on its cuts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0xD1342543DE82EF95
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, U(base)), np.full(n, U(inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def byte_values() -> tuple[np.ndarray, np.ndarray]:
    """Values of bytes, A-Z as a-z and white space as 0, and which bytes are white space."""
    values = constants(256, 7)
    values[65:91] = values[97:123]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    values[space] = 0
    return values, space


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's number of words.

    Words are runs of anything but the space and U+0009 to U+000D, after A-Z are lower-cased.
    """
    raw = "\n".join(texts).encode("utf-8", "surrogatepass") + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    values, is_space = byte_values()
    space = is_space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    begins, ends = edge[0::2], edge[1::2]
    n = len(data)
    up, down = powers(1 << max(20, int(n).bit_length()))
    sums = np.empty(n + 1, dtype=U)
    sums[0] = 0
    np.cumsum(values[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins])
    sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64) + 1
    counts = np.diff(np.searchsorted(begins, np.concatenate(([0], np.cumsum(sizes)))))
    return hashes, counts


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles as 64-bit hashes.

    A text of fewer words gives its whole sequence as one; one without words gives none.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    begins = ends - counts
    n = len(hashes)
    keys = constants(words, 11) | U(1)
    rolled = np.zeros(max(0, n - words + 1), dtype=U)
    for k in range(words):
        rolled += hashes[k : n - words + 1 + k] * keys[k]
    rolled = mix(rolled)
    out = []
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= words:
            s = np.sort(rolled[b : e - words + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif e > b:
            out.append(mix((hashes[b:e] * keys[: e - b]).sum(dtype=U, keepdims=True) + U(e - b)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out
