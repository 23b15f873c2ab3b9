"""Structure statistics and word hashes of whole texts, for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, shingles, steps

STATISTICS = [
    "bytes", "words", "word_bytes", "upper", "digit", "mark", "line", "high", "again", "distinct", "commonest",
    "ends_marked", "ends_doubly_marked", "bar", "line_words", "fresh_shingles",
]


def _class(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


UPPER, LOWER, DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
MARK = _class(c for c in range(33, 127) if not chr(c).isalnum())
LATIN_UPPER = _class(set(range(0x80, 0x9F)) - {0x97})


def distinct_counts(words: Words, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, owner, count) of the distinct values of each text, in the order of owner."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return v[at], o[at], np.diff(np.append(at, len(v)))


def statistics(words: Words, n: int) -> np.ndarray:
    """One row of STATISTICS per text."""
    raw = words.raw

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[words.offset[1:]] - total[words.offset[:-1]]).astype(float)

    size = np.diff(words.offset) - 1.0
    count = np.diff(words.first).astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(count, 1)
    latin_upper = LATIN_UPPER[raw]
    latin_upper[1:] &= raw[:-1] == 0xC3
    latin_upper[0] = False
    upper, lower, high = share(UPPER[raw] | latin_upper), share(LOWER[raw]), share(raw >= 0xC0)
    lines = share(raw == 10) + 1
    again = np.zeros(len(words.hash), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text_of[1:] == words.text_of[:-1])
    marked = MARK[raw[words.end - 1]]
    doubly = marked & MARK[raw[np.maximum(words.end - 2, 0)]] & (words.end - words.begin > 2)
    _, owner, times = distinct_counts(words, words.hash, words.text_of)
    commonest = np.zeros(n)
    np.maximum.at(commonest, owner, times)
    in_text = lambda mask: np.bincount(words.text_of[mask], minlength=n)
    hashes, of = shingles(words, 3)
    _, kept, _ = distinct_counts(words, hashes, of)
    total = np.bincount(of, minlength=n)
    return np.stack(
        [
            np.log1p(size),
            np.log1p(count),
            size * per_word,
            upper / np.maximum(upper + lower + high, 1),
            share(DIGIT[raw]) * per_byte,
            share(MARK[raw]) * per_byte,
            lines * per_byte,
            high * per_byte,
            in_text(again) * per_word,
            np.bincount(owner, minlength=n) * per_word,
            commonest * per_word,
            in_text(marked) * per_word,
            in_text(doubly) * per_word,
            share(raw == 124) * per_byte,
            np.log1p(count / lines),
            np.bincount(kept, minlength=n) / np.maximum(total, 1),
        ],
        axis=1,
    )


def training_sample(docs: DataFrame, labels: DataFrame, label: Column, most: int, id: str, text: str, extra: list[str]) -> list:
    """At most ``most`` labelled rows with features on the driver: label, extras, statistics, distinct word hashes and counts.

    Which rows is decided by a hash of the id, so the sample is the same wherever it is drawn. Only its ids
    and labels, of bounded number, are broadcast to the texts.
    """
    known = labels.select(F.col(id).cast("long").alias("id"), label.alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    chosen = known.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(most)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *extra)
    # an id of many rows gives the one of the smallest text hash, so that the number of rows is bounded by ``most``
    least = F.min(F.struct(F.xxhash64("text").alias("digest"), "text", *extra)).alias("least")
    rows = own.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(least).select("label", "least.text", *(f"least.{c}" for c in extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            words = Words(texts)
            values = statistics(words, len(texts))
            hashes, owner, times = distinct_counts(words, words.hash, words.text_of)
            cuts = np.searchsorted(owner, np.arange(1, len(texts)))
            pack = lambda parts: pa.array([p.tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(batch.column(i) for i in range(2, batch.num_columns)),
                    pack(values),
                    pack(np.split(hashes, cuts)),
                    pack(np.split(times.astype(np.int64), cuts)),
                ],
                ["label", *extra, "statistics", "hashes", "times"],
            )

    kinds = "".join(f"{c} double, " for c in extra)
    found = rows.mapInArrow(run, f"label int, {kinds}statistics binary, hashes binary, times binary").collect()
    # an order of its own, so that the fit does not depend on the partitions
    return sorted(found, key=lambda r: (r.hashes, r.times, r.label))
