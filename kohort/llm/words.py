"""Words of many texts at once as 64-bit hashes, in numpy.

A batch of texts is one byte buffer. A word's hash is a polynomial over its bytes modulo 2^64, read off
running sums and scrambled, so that no Python code runs per word. Hashes are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import ASCII_LOWER, give_back, small_batches, text_bytes

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: bytes of text that one step works on; a longer text is a step of its own
STEP = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, STEP + 4096)
        for name, factor in (("up", BASE), ("down", INVERSE)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of ``texts`` (maximal runs of bytes other than space and 0x09-0x0D), A-Z lower-cased.

    ``hash`` and ``text_of`` by word, ``first[i]:first[i + 1]`` the words of text i, ``begin``/``end`` their bytes
    in ``raw``, the joined texts as they came.
    """

    def __init__(self, texts: list[bytes]):
        joined = b" ".join(texts) + b" "
        self.raw = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        lowered = np.frombuffer(joined.translate(ASCII_LOWER), np.uint8)
        space = SPACE[lowered]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
        self.begin, self.end = edge[0::2], edge[1::2]
        up, down = powers(len(lowered))
        total = np.zeros(len(lowered) + 1, np.uint64)
        np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        value = (total[self.end] - total[self.begin]) * down[self.begin]
        self.hash = scramble(value + (self.end - self.begin).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35))
        self.first = np.searchsorted(self.begin, self.offset)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))


def steps(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches holding at most about STEP bytes of column ``text``, with the texts."""
    # a slice at a time, so that a batch of long texts is not copied as a whole
    for batch in small_batches(batches):
        texts = text_bytes(batch.column(text))
        start, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > STEP:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += len(t) + 1
        if start < len(texts):
            yield batch.slice(start), texts[start:]
    give_back()


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shingles of ``k`` consecutive words; a text of fewer words is one shingle, an empty one none."""
    n = len(words.hash)
    count = np.diff(words.first)
    value = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        value = scramble(value * np.uint64(BASE) + words.hash[j : n - k + 1 + j])
    whole = words.text_of[: n - k + 1] == words.text_of[k - 1 :] if n >= k else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    rest = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        for h in words.hash[words.first[t] : words.first[t + 1]]:
            rest[i : i + 1] = scramble(rest[i : i + 1] * np.uint64(BASE) + h)
        rest[i : i + 1] = scramble(rest[i : i + 1] + np.uint64(count[t]))
    return np.concatenate([value[whole], rest]), np.concatenate([words.text_of[: n - k + 1][whole] if n >= k else np.zeros(0, int), short])
