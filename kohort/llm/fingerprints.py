"""Quartile bucket digests: fingerprints of whole texts that can be compared with a bounded difference score.

A digest counts the byte triplets of a text in ``BUCKETS`` buckets by a hash. It holds, for each bucket, in which quartile
of all bucket counts of the text its own count lies (two bits), and the length on a logarithmic scale (one byte). Two
zero bytes follow the text, so texts of one or two bytes have triplets too. Written as lowercase hex: the length
byte, then the codes, four to a byte.

The difference of two digests is the sum of |code - code| over the buckets plus the distance of the length bytes, up to
``LENGTH_CAP``; likeness is 1 - difference / UNLIKE, at least 0. UNLIKE is the difference to be expected of two digests
whose buckets have nothing to do with each other, so unrelated texts come out near 0 only as far as their languages
share no triplets; texts of a language share the frequent ones.

``edited_fingerprints`` also compares each document with an edit of itself and with its neighbour in the order of ids. The
order is made by ranges of (id, hash of the text), sorted within each range, where a document meets the next
one as rows stream by; only two documents are held at a time. What lies at the two ends of each range meets by a join on the range's
number, two documents per range. No range is ever held whole, and a group of copies with one id is split by the last sort
key, as their order among each other does not change the result.

Defined cases: a null text is empty and equals one; all empty texts have one fingerprint; a null id comes before all others;
documents of one id are ordered by a hash of their texts, so that the result is one and the same in every run; a single document follows itself;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, stage, tasks

BUCKETS = 256
#: a step of the length byte is 10 %, so that 255 steps cover 36 GB
STEPS = np.cumprod(np.full(255, 1.1))
LENGTH_CAP = 32
#: odd, its top bits mix all three bytes
MULTIPLIER = np.uint32(2654435761)
#: two unrelated codes differ by 1.25 on average
UNLIKE = 1.25 * BUCKETS


def counted(text: bytes) -> np.ndarray:
    """Triplets of ``text`` and two zero bytes, by bucket."""
    if not text:
        return np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(text + b"\0\0", np.uint8).astype(np.uint32)
    triplet = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return np.bincount(triplet * MULTIPLIER >> np.uint32(24), minlength=BUCKETS)


def digest(text: bytes) -> np.ndarray:
    """The length byte and the codes of the buckets, one byte each."""
    counts = counted(text)
    quartiles = np.sort(counts)[BUCKETS // 4 - 1 : -1 : BUCKETS // 4]
    codes = (counts > quartiles[0]).astype(np.uint8) + (counts > quartiles[1]) + (counts > quartiles[2])
    length = np.searchsorted(STEPS, len(text), "right")
    return np.concatenate([[np.uint8(length)], codes.astype(np.uint8)])


def to_hex(d: np.ndarray) -> str:
    codes = d[1:].reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return bytes([int(d[0]), *packed.tolist()]).hex()


def from_hex(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    codes = raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3
    return np.concatenate([raw[:1], codes.ravel()])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 at a difference of UNLIKE or more."""
    apart = np.abs(a.astype(np.int64) - b.astype(np.int64))
    return float(max(0.0, 1 - (apart[1:].sum() + min(int(apart[0]), LENGTH_CAP)) / UNLIKE))


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    """The row of a document whose successor is ``following``."""
    changed = edit(text, following).encode()
    edited = digest(changed)
    return (
        doc_id, len(text), hashlib.sha256(changed).hexdigest(), to_hex(own), to_hex(edited), likeness(own, edited), likeness(own, other),
    )


def edited_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "salt": F.rand(1)})
    ranges = keyed.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    names = [n for n, _ in FIELDS] + ["place", "last", "edge"]
    types = [t for _, t in FIELDS] + [pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def end(doc_id: int | None, words: str, last: bool) -> tuple:
            return (doc_id, *[None] * 6, place, last, words)

        held = None
        for batch in small_batches(batches):
            out = []
            for doc_id, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = digest(words.encode())
                if held is None:
                    out.append(end(doc_id, words, False))
                else:
                    out.append((*compared(*held, words, own), place, None, None))
                held = doc_id, words, own
            yield batch_of(out)
        if held is not None:
            yield batch_of([end(held[0], held[1], True)])
        give_back()

    done = stage(ranges.mapInArrow(run, f"{SCHEMA}, place int, last boolean, edge string"))
    # the ends of ranges: one number per range is ordered in one place, the texts are joined by it
    heads = done.where("last = false").select(F.col("place").alias("next"), F.col("edge").alias("following"))
    places = heads.select("next").orderBy("next").collect()
    links = [(int(a[0]), int(b[0])) for a, b in zip(places, places[1:] + places[:1])]
    linked = spark.createDataFrame(links, "place int, next int")
    tails = done.where("last").select("doc_id", "place", F.col("edge").alias("text"))
    ends = tails.join(linked, "place").join(heads, "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 16):
            out = [
                compared(i, a, digest(a.encode()), b, digest(b.encode()))
                for i, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])
        give_back()

    inner = done.where("last IS NULL").select(*[n for n, _ in FIELDS])
    return inner.unionByName(ends.mapInArrow(finish, SCHEMA))
