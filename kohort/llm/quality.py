"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + w.x + 1/2 sum_f [(V_f.x)^2 - (V_f^2).x^2]): all pairwise interactions through vectors of low
rank in time linear in the features of a text, by the sum-of-squares identity. Inputs are the hashed words of
the whole text, statistics of its structure (standardised and by sample quantile) and the metadata column
``n_chars``; labels, language, source and id never are. The machine is fitted on the driver on at most ``most``
labelled rows (drawn by a hash of the id), a documented bound; every text is then scored in its task.

Defined cases: a null text is scored as empty; a null ``n_chars`` counts as the text's own length in bytes; labels
for no document are ignored, rows with a null label too; conflicting labels of a document both count; repeated rows
are scored row by row; a null id is held out as an empty string's checksum says; further columns are ignored; an
empty table gives an empty result; without a single labelled row every score is 0.5, with labels of one kind
only the machine learns that kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, beside
from .features import STATISTICS, distinct_counts, statistics, training_sample
from .words import Words, steps

BITS, RANK, BINS = 11, 6, 10


class Machine:
    """The fitted machine; ``score`` takes the parts of the features that a task has."""

    def __init__(self, sample: list, epochs: int = 30, step: float = 0.02, penalty: float = 1e-5, seed: int = 7):
        self.words = 1 << BITS
        self.fitted = bool(sample)
        if not sample:
            return
        values = np.stack([np.append(np.frombuffer(r.statistics), np.log1p(max(r.n_chars, 0.0))) for r in sample])
        self.mean, self.spread = values.mean(axis=0), values.std(axis=0) + 1e-6
        self.cuts = np.quantile(values, np.arange(1, BINS) / BINS, axis=0).T
        x = np.zeros((len(sample), self.width), np.float32)
        for i, r in enumerate(sample):
            column, weight = self.hashed(np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.times, np.int64))
            np.add.at(x[i], column, weight / np.sqrt(max(1.0, float((weight * weight).sum()))))
        x[:, self.words :] = self.structure(values)
        self.fit(x, np.array([r.label for r in sample], np.float32), epochs, step, penalty, seed)

    @property
    def width(self) -> int:
        return self.words + (len(STATISTICS) + 1) * (1 + BINS)

    def hashed(self, hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.sqrt(times).astype(np.float32)

    def structure(self, values: np.ndarray) -> np.ndarray:
        """Standardised statistics and the sample quantile bin of each."""
        plain = np.clip((values - self.mean) / self.spread, -4, 4)
        bins = np.zeros((len(values), values.shape[1], BINS))
        for j in range(values.shape[1]):
            bins[np.arange(len(values)), j, np.searchsorted(self.cuts[j], values[:, j], side="right")] = 1
        return np.concatenate([plain / 4, bins.reshape(len(values), -1)], axis=1).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, step: float, penalty: float, seed: int) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        p = {
            "b": np.zeros(1),
            "w": np.zeros(self.width),
            "v": random.normal(0, 0.01, (self.width, RANK)),
        }
        first, second, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for start in range(0, len(x), 128):
                own = x[order[start : start + 128]].astype(np.float64)
                sums = own @ p["v"]
                raw = p["b"] + own @ p["w"] + 0.5 * ((sums**2).sum(1) - (own**2) @ (p["v"] ** 2).sum(1))
                off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[order[start : start + 128]]) / len(own)
                gradient = {
                    "b": np.array([off.sum()]),
                    "w": own.T @ off + penalty * p["w"],
                    "v": own.T @ (off[:, None] * sums) - p["v"] * ((own**2).T @ off)[:, None] + penalty * p["v"],
                }
                t += 1
                for k, g in gradient.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] -= step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self.b, self.w, self.v = float(p["b"][0]), p["w"], p["v"]

    def score(self, words: Words, n: int, metadata: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(n, 0.5)
        hashes, owner, times = distinct_counts(words, words.hash, words.text_of)
        column, weight = self.hashed(hashes, times)
        norm = np.sqrt(np.maximum(1.0, np.bincount(owner, weight.astype(float) ** 2, minlength=n)))
        # hash collisions within a text add up before they are squared, as in the fit
        key, place = np.unique(owner * self.words + column, return_inverse=True)
        owner, column = np.divmod(key, self.words)
        value = np.bincount(place, weight.astype(float), minlength=len(key)) / norm[owner]
        structure = self.structure(np.column_stack([statistics(words, n), np.log1p(np.maximum(metadata, 0.0))])).astype(float)
        w, v = self.w[self.words :], self.v[self.words :]
        raw = self.b + structure @ w + np.bincount(owner, value * self.w[column], minlength=n)
        for f in range(RANK):
            part = value * self.v[column, f]
            sums = structure @ v[:, f] + np.bincount(owner, part, minlength=n)
            raw += 0.5 * (sums**2 - (structure**2) @ (v[:, f] ** 2) - np.bincount(owner, part**2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def held_out(id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> Machine:
    size = F.coalesce(F.col(chars).cast("double"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("double"))
    learnt = labels.where(~held_out(F.col(id)))
    sample = training_sample(
        docs.withColumn("n_chars", size), learnt, F.col("quality").cast("int"), most, id, text, ["n_chars"]
    )
    return Machine(sample)


def scorer(machine: Machine, spark):
    """Batches of (anything..., text, n_chars) to their scores, for mapInArrow."""
    sent = spark.sparkContext.broadcast(machine)

    def scores(batches: Iterator[pa.RecordBatch], text: int, chars: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch, texts in steps(batches, text):
            stated = batch.column(chars).to_pylist()
            metadata = np.array([len(t) if c is None else c for t, c in zip(texts, stated, strict=True)], float)
            yield batch, sent.value.score(Words(texts), len(texts), metadata)

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.7, most: int = 6000, id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``least`` on) of every text."""
    scores = scorer(fit(docs, labels, most, id, text, chars), docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches, 2, 3):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= least).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    key = F.col(id).cast("long")
    read = docs.select(key.alias("id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(chars).cast("double").alias("chars"))
    return read.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, most: int = 6000, id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``docs`` without the texts that score under ``least``, all columns kept; nothing is shuffled."""
    scores = scorer(fit(docs, labels, most, id, text, chars), docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scores(batches, len(names), len(names) + 1):
            yield as_rows(batch.filter(pa.array(score >= least)), names)

    read = beside(docs, F.col(text).cast("string"), F.col(chars).cast("double"))
    return read.mapInArrow(run, docs.schema)
