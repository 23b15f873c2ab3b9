"""Mixing sources to target weights through soft memberships.

1. A softmax classifier learns the domains of a labelled table and gives every document a posterior over them.
   Its inputs are the presence of words that are frequent in the sample and the structure statistics; it is
   fitted on the driver on at most ``most`` labelled rows, a documented bound.
2. Nonnegative document rates r are fitted by projected-gradient least squares so that the expected tokens of
   every domain, sum_d r_d t_d p_dk, meet their targets. The residual has one number per domain, so
   an iteration is one pass that sums K numbers. Tasks replay the residuals of earlier passes to get the rates of
   their own documents: no state is kept between passes and a lost executor costs a task.
3. ``resample`` writes each document floor(r + u) times, u a hash of the document in [0, 1).

Targets state weights of domains. The anchor domain keeps the tokens it has, the others follow from the
weights, so that a mix is reached by thinning or repeating what surrounds the anchor.

With ``thin`` nothing is repeated and the anchor loses nothing: documents whose likeliest domain is the anchor have rate 1,
the others rates in [0, 1], fitted so that the expected tokens of the other domains stand to those of the anchor as their
weights do. A domain below its weight keeps what it has.

Defined cases: a null text counts as empty and has 0 tokens, and its rate has no effect on any total; labels
for no document and null labels are ignored; repeated rows count row by row and get one rate; a null
id is kept; further columns pass through ``resample``; an empty table gives an empty result; a target for
a domain without tokens cannot be met and leaves the least-squares rates; without labelled rows all rates are 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_rows, beside, small_batches, stage
from .features import statistics, training_sample
from .words import Words, steps

#: words that the classifier looks at: those in at least LEAST sample texts, at most VOCABULARY of them
VOCABULARY, LEAST = 2048, 5


class Domains:
    """Softmax regression; ``posteriors`` of whole texts."""

    def __init__(self, sample: list, names: list[str], epochs: int = 40, step: float = 0.02, penalty: float = 2e-4, seed: int = 11):
        self.names = names
        self.fitted = bool(sample)
        if not sample:
            return
        hashes = [np.frombuffer(r.hashes, np.uint64) for r in sample]
        label = np.array([r.label for r in sample])
        word, place = np.unique(np.concatenate(hashes), return_inverse=True)
        owner = np.repeat(np.arange(len(sample)), [len(h) for h in hashes])
        seen = np.stack([np.bincount(place[label[owner] == k], minlength=len(word)) for k in range(len(names))])
        total, share = seen.sum(axis=0), np.bincount(label, minlength=len(names)) / len(sample)
        expected = np.maximum(share[:, None] * total, 1e-9)
        # words whose spread over the domains departs most from that of all texts
        told = np.where(total >= LEAST, ((seen - expected) ** 2 / expected).sum(axis=0), -1.0)
        best = np.sort(np.argsort(-told, kind="stable")[:VOCABULARY])
        self.vocabulary = word[best[told[best] >= 0]]
        values = np.stack([np.frombuffer(r.statistics) for r in sample])
        self.mean, self.spread = values.mean(axis=0), values.std(axis=0) + 1e-6
        x = np.zeros((len(sample), self.width), np.float32)
        for i, h in enumerate(hashes):
            x[i, self.places(h)[1]] = 1
        x[:, len(self.vocabulary) :] = self.structure(values)
        self.fit(x, label, epochs, step, penalty, seed)

    @property
    def width(self) -> int:
        return len(self.vocabulary) + 3 * len(self.mean) + 1

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, vocabulary columns) of the known words."""
        if not len(self.vocabulary):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == hashes)
        return known, at[known]

    def structure(self, values: np.ndarray) -> np.ndarray:
        plain = np.clip((values - self.mean) / self.spread, -4, 4)
        return np.concatenate([plain / 2, plain**2 / 8, np.tanh(plain), np.ones((len(values), 1))], axis=1)

    def fit(self, x: np.ndarray, label: np.ndarray, epochs: int, step: float, penalty: float, seed: int) -> None:
        random, k = np.random.Generator(np.random.PCG64(seed)), len(self.names)
        goal = np.eye(k)[label]
        w = np.zeros((self.width, k))
        first, second, t = np.zeros_like(w), np.zeros_like(w), 0
        for _ in range(epochs):
            order = random.permutation(len(x))
            for start in range(0, len(x), 256):
                rows = order[start : start + 256]
                own = x[rows].astype(np.float64)
                g = own.T @ (self.softmax(own @ w) - goal[rows]) / len(rows) + penalty * w
                t += 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        self.w = w

    @staticmethod
    def softmax(raw: np.ndarray) -> np.ndarray:
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posterior per domain) of each text; a token is a word."""
        words, n = Words(texts), len(texts)
        tokens = np.diff(words.first).astype(np.int64)
        if not self.fitted:
            return tokens, np.full((n, len(self.names)), 1 / len(self.names))
        at, column = self.places(words.hash)
        pairs = np.unique(words.text_of[at] * np.int64(VOCABULARY) + column)
        owner, column = np.divmod(pairs, VOCABULARY)
        raw = self.structure(statistics(words, n)) @ self.w[len(self.vocabulary) :]
        for k in range(len(self.names)):
            raw[:, k] += np.bincount(owner, self.w[column, k], minlength=n)
        return tokens, self.softmax(raw)


@dataclass
class Rates:
    """What the passes found: replaying it gives the rate of any posterior."""

    step: float
    residuals: list[np.ndarray]
    momenta: list[float]
    converged: bool
    error: float
    #: when thinning, the domain whose documents keep rate 1
    kept: int | None = None

    def free(self, p: np.ndarray) -> np.ndarray:
        """Which documents are fitted."""
        return np.ones(len(p), bool) if self.kept is None else p.argmax(axis=1) != self.kept

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, extrapolated rates) of documents with posteriors ``p`` after all passes so far."""
        r = z = np.ones(len(p))
        free = self.free(p)
        for residual, momentum in zip(self.residuals, self.momenta, strict=True):
            new = np.maximum(0.0, z - self.step * (p @ residual))
            if self.kept is not None:
                new = np.where(free, np.minimum(1.0, new), 1.0)
            r, z = new, new + momentum * (new - r)
            if self.kept is not None:
                z = np.clip(z, 0.0, 1.0)
        return r, z


def _sums(rows: DataFrame, k: int, values) -> np.ndarray:
    """Element-wise sums of ``values(t, p)``, an array per batch; tasks add up, the driver gets one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            p = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, k)
            own = values(t, p).ravel()
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "value"])

    found = rows.select("tokens", "posterior").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = {r["at"]: r["value"] for r in found.collect()}
    return np.array([out[i] for i in sorted(out)])


def fit_rates(rows: DataFrame, weights: np.ndarray, anchor: int, passes: int = 200, tolerance: float = 1e-4, thin: bool = False) -> Rates:
    """Projected-gradient least squares with momentum over (tokens, posterior) rows.

    Steps are taken in the metric of the documents' tokens, so that long and short documents of one posterior get
    one rate. ``passes`` bounds the work; a fit that has not come within ``tolerance`` of its targets nor stopped
    moving by then raises.
    """
    k = len(weights)
    one, kept = Rates(0.0, [], [], True, 0.0), anchor if thin else None
    one.kept = kept
    # what is summed of a posterior; when thinning, what each domain has beyond its weight beside the anchor
    gains = np.eye(k)
    if thin:
        gains[anchor] -= weights / weights[anchor]

    def first(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        q, free = p @ gains, t * one.free(p)
        return np.concatenate([t @ p, t @ q, ((q * free[:, None]).T @ q).ravel()])

    start = _sums(rows, k, first)
    if not len(start) or not start[:k].any() or not start[anchor] or not start[2 * k :].any():
        return one
    now, total, spread = start[:k], start[k : 2 * k], start[2 * k :].reshape(k, k)
    target = weights / weights[anchor] * now[anchor]
    size = np.linalg.norm(target)
    if thin:
        size = np.linalg.norm(np.delete(target, anchor)) or np.linalg.norm(now)
        target = np.minimum(total, 0.0)
    found = Rates(1 / np.linalg.eigvalsh(spread)[-1], [], [], False, 0.0, kept)
    speed, last = 1.0, np.inf
    for _ in range(passes):
        residual = total - target
        error = float(np.linalg.norm(residual) / size)
        if error <= tolerance or abs(last - error) <= 1e-9:
            found.converged, found.error = True, error
            # the last extrapolation is nonnegative only after one more projection
            found.residuals.append(gains @ residual)
            found.momenta.append(0.0)
            return found
        # momentum starts afresh when the error grows
        speed = 1.0 if error > last else speed
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        found.residuals.append(gains @ residual)
        found.momenta.append((speed - 1) / faster)
        speed, last = faster, error
        # a closure must not see later passes
        frozen = Rates(found.step, list(found.residuals), list(found.momenta), False, 0.0, kept)
        total = _sums(rows, k, lambda t, p, f=frozen: (t * f.replay(p)[1]) @ (p @ gains))
    raise ValueError(f"the rates are {error:.2e} off their targets after {passes} passes")


@dataclass
class Mix:
    """A classifier, the rates fitted with it, and the written (row, id, tokens, posterior) table."""

    domains: Domains
    rates: Rates
    rows: DataFrame


def fit_mix(docs: DataFrame, labels: DataFrame, label: Column, weights: dict[str, float], anchor: str, most: int = 6000, id: str = "doc_id", text: str = "text", thin: bool = False) -> Mix:
    """Classify, then fit the rates. ``label`` is the position of a labelled row's domain in ``weights``."""
    names = list(weights)
    domains = Domains(training_sample(docs, labels, label, most, id, text, []), names)
    sent = docs.sparkSession.sparkContext.broadcast(domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, 1):
            tokens, p = sent.value.posteriors(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens), pa.array([row.tobytes() for row in p], pa.binary())], ["id", "tokens", "posterior"]
            )

    read = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = stage(read.mapInArrow(run, "id long, tokens long, posterior binary"))
    rates = fit_rates(rows, np.array([weights[n] for n in names], float), names.index(anchor), thin=thin)
    return Mix(domains, rates, rows)


def document_rates(mix: Mix, id: str = "doc_id") -> DataFrame:
    """id, n_tokens, one column p_<domain> per domain, rate."""
    names, rates = [f"p_{n}" for n in mix.domains.names], mix.rates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            p = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(p[:, i].copy()) for i in range(len(names))), pa.array(rates.replay(p)[0])],
                ["id", "n_tokens", *names, "rate"],
            )

    columns = "".join(f"{n} double, " for n in names)
    return mix.rows.mapInArrow(run, f"id long, n_tokens long, {columns}rate double").withColumnRenamed("id", id)


def resample(docs: DataFrame, mix: Mix, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every row floor(rate + u) times, u in [0, 1) a hash of id and text. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast((mix.domains, mix.rates))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        domains, rates = sent.value
        for batch, texts in steps(batches, len(names)):
            _, p = domains.posteriors(texts)
            u = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            times = np.floor(rates.replay(p)[0] + u).astype(int)
            yield as_rows(batch.take(pa.array(np.repeat(np.arange(len(texts)), times))), names)

    u = F.pmod(F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return beside(docs, F.col(text).cast("string"), u).mapInArrow(run, docs.schema)
