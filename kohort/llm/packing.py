"""Best-fit packing by exact complements.

1. Texts become token ids in their tasks; only pieces (id, number, start, length, checksum) leave them, each
   with its rank among the equally long pieces of its task, and are written as a table.
2. The plan needs nothing but the number of pieces of each length, at most ``size`` counts. For every length,
   longest first, the single, pair and triple sums that exactly fill its gap are looked up and as many
   combinations are consumed as there are pieces; what is left is packed best-fit decreasing, also by counts.
3. A piece's rank among all pieces of its length (its rank in its task plus the counts of earlier tasks)
   says which sequence and offset the plan has for it. No length, however frequent, meets in one task.

Defined cases: a null text counts as empty and is the single id 0; repeated rows are packed row by row; a null
id is kept; further columns are ignored; an empty table gives an empty result. Texts are packed whole: those
over ``size`` tokens are cut into pieces, of which only the last may be shorter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, stage
from .words import steps

PUNCTUATION = rb"[!-/:-@\[-`{-~]"
#: the bytes after 0xC3 of the Latin-1 letters, without the multiplication and division signs
LATIN = rb"[\x80-\x96\x98-\xb6\xb8-\xbf]"
LETTERS = re.compile(rb"(?:[a-z]|\xc3" + LATIN + rb")+")
#: a run of ASCII punctuation between a letter and the end of a word: a pre-token of its own
TAIL = re.compile(PUNCTUATION + rb"(?:(?<=[a-z]" + PUNCTUATION + rb")|(?<=\xc3" + LATIN + PUNCTUATION + rb"))" + PUNCTUATION + rb"*(?![^\x20\x09-\x0d])")
#: texts with a byte from 0xCA on may hold combining marks and go to the library as a whole
PLAIN_BYTES = bytes(range(0xCA))


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


class Encoder:
    """The ids of a tokenizer that lower-cases and drops white space, remembered by word; ``end`` follows every text."""

    def __init__(self, path: str, kept: int, end: int):
        # a task has one core; further threads would only hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.end = Tokenizer.from_file(path), kept, end
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        # no word is empty: the empty one stands for the end of a text
        self.place: dict[bytes, int] = {b"": 0}
        self.begin, self.size = np.zeros(1024, np.int64), np.ones(1024, np.int64)
        self.pool, self.used = np.full(4096, self.end, np.uint32), 1

    def keep(self, words: list[bytes], ids: list[list[int]]) -> None:
        n, m = len(self.place), len(self.place) + len(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        if m > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * m), np.resize(self.size, 2 * m)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.place.update(zip(words, range(n, m)))
        self.used += len(flat)

    def learn(self, words: set[bytes]) -> None:
        """A word of letters is one pre-token, which the model is asked for directly; the library cuts the others."""
        letters = [w for w in words if LETTERS.fullmatch(w)]
        model, spelled = self.tokenizer.model, self.letters
        ids = []
        for word in letters:
            written = word.decode("ascii") if word.isascii() else word.decode().lower().encode().decode("latin-1").translate(spelled)
            ids.append([t.id for t in model.tokenize(written)])
        self.keep(letters, ids)
        others = list(words.difference(letters))
        self.keep(others, [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text and then ``end``."""
        if len(self.place) > self.kept:
            self.clear()
        words: list[bytes] = []
        until, whole = [], {}
        for i, text in enumerate(texts):
            if b"<|" in text or text.translate(None, PLAIN_BYTES):
                whole[i] = np.array([*self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.end], np.uint32)
            else:
                words += TAIL.sub(rb" \g<0>", text.translate(ASCII_LOWER)).split()
                words.append(b"")
            until.append(len(words))
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            new = [words[i] for i in unseen.tolist()]
            self.learn(set(new))
            at[unseen] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.begin[at] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.array([0, *until])]
        return [whole[i] if i in whole else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, kept: int, end: int) -> Encoder:
    """One encoder a worker, so that the words of earlier tasks need not be looked up again."""
    if (path, kept, end) not in _encoders:
        _encoders[path, kept, end] = Encoder(path, kept, end)
    return _encoders[path, kept, end]


def fill(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, number of such sequences) that use up ``counts[length]`` pieces."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[list[int], int]] = []

    def take(pattern: list[int]) -> int:
        lengths, need = np.unique(pattern, return_counts=True)
        n = int((left[lengths] // need).min())
        if n:
            left[lengths] -= n * need
            plan.append((pattern, n))
        return n

    def pairs(gap: int) -> np.ndarray:
        """Longer sides a of pairs a + b = gap of which there are pieces, longest first."""
        half = np.arange(gap - 1, (gap - 1) // 2, -1)
        return half[(left[half] > 0) & (left[gap - half] > 0)]

    for length in range(size, 0, -1):
        gap = size - length
        if left[length] and gap == 0:
            take([length])
        if left[length] and gap and left[gap]:
            take([length, gap])
        if left[length] and gap > 1:
            for a in pairs(gap):
                take([length, int(a), gap - int(a)])
                if not left[length]:
                    break
        if left[length] and gap > 2:
            # triples: one piece first, then the pairs that fill what it leaves
            first = np.flatnonzero(left[: gap - 1])[::-1]
            for a in first:
                if a < gap / 3 or not left[length]:
                    break
                for b in pairs(gap - int(a)):
                    if b <= a:
                        take([length, int(a), int(b), gap - int(a) - int(b)])
                        if not (left[length] and left[a]):
                            break
    return plan + best_fit(left, size)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: equal bins are filled together."""
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    done: list[tuple[list[int], int]] = []

    def put(pattern: list[int], n: int, gap: int) -> None:
        if gap:
            open_bins.setdefault(gap, []).append((pattern, n))
        else:
            done.append((pattern, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = [g for g in open_bins if g >= length]
            if not fits:
                each = size // length
                if n >= each:
                    put([length] * each, n // each, size - each * length)
                if n % each:
                    put([length] * (n % each), 1, size - (n % each) * length)
                break
            gap = min(fits)
            pattern, bins = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
            used = min(n, bins)
            if used < bins:
                put(pattern, bins - used, gap)
            put(pattern + [length], used, gap - length)
            n -= used
    return done + [x for group in open_bins.values() for x in group]


def schedule(plan: list[tuple[list[int], int]], size: int) -> dict[str, np.ndarray]:
    """The plan by piece: ranks [rank, rank + n) of a length go to sequences from ``sequence`` at ``offset``."""
    used, rows, sequence = np.zeros(size + 1, np.int64), [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, path: str, size: int, end: int, id: str, text: str, kept: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(path, kept, end), TaskContext.get().partitionId()
        ranks = np.zeros(size + 1, np.int64)
        for batch, texts in steps(batches, 1):
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode(texts), strict=True):
                ids = ids.astype("<u4", copy=False)
                for number, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    out.append((doc, number, start, len(own), zlib.crc32(own.tobytes()), part, int(ranks[len(own)])))
                    ranks[len(own)] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    read = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return stage(read.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"))


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id: str = "doc_id", text: str = "text", kept: int = 600_000) -> DataFrame:
    """One row per piece with its sequence and its offset there; sequences hold at most ``size`` tokens.

    ``kept`` bounds the words a worker remembers: more of them take memory and save time, the result is the same.
    """
    cut = pieces(docs, path, size, end, id, text, kept)
    by_task = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    # at most one row for each length
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row.length] = row.n
    plan = docs.sparkSession.sparkContext.broadcast(schedule(fill(counts, size), size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.searchsorted(table["key"], (length << 48) + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            kept = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence, pa.int64()), pa.array(table["offset"][at], pa.int64())],
                [*kept, "sequence_id", "offset"],
            )

    ranked = cut.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    placed = ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id)
