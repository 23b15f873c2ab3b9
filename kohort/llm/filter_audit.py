"""Interaction audit of document filters: what each removes in every order, and its Shapley share.

One pass over the whole texts gives each document the set of filters it fails, as bits; documents then are counts per
part and set. Everything asked about orders is a function of the 32 coalition values v(S), the number of documents
of a part that the filters of S remove together:

* the filter f, applied after those of S, removes v(S + f) - v(S), and its removals of good or toxic documents are
  the same differences of coalition values counted over those documents;
* its Shapley value is the solution of a least squares problem: additive shares are fitted to all coalition
  values with the Shapley kernel as weights, under the constraint that they sum to v(all). The normal equations with the
  constraint's multiplier are solved in rationals, so nothing is rounded; the sum over the 120 orders is 120 times the share.

Filters: A fewer than 100 words; B distinct words under 80 in 100; C more than 10 capitals A-Z in 100 code points; D a
character of ``#$%&*|``; E text identical to that of a smaller doc_id. Words are runs without ASCII white space.

E needs the smallest id of each text. Rows are first counted by (text digest, id, part, labels), which spreads a large
group of copies over its ids, then per text the row of the smallest id and the count of all rows are combined before
the shuffle. Copies therefore never meet in one task.

Defined cases: a null text is empty; a null part is the empty string; a document with a null id has no labels, never fails
E and makes none fail; a repeated row counts each time, and copies with one id do not fail E through each other; of several
label rows for an id, any with the value 1 counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches, stage, text_bytes

FILTERS = "ABCDE"
CAPITALS, SPECIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: bytes of UTF-8 that begin no code point
CONTINUED = bytes(range(0x80, 0xC0))
COUNTS = ["n", "good", "toxic"]


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: which of A to D a text fails."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    special = len(text.translate(None, SPECIAL)) != len(text)
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | special << 3


def tested(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest, bits): the narrow table that all later steps use; texts are not shuffled."""
    rows = docs.select(
        F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = text_bytes(batch.column(2))
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            bits = pa.array([text_failures(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, bits], ["doc_id", "part", "digest", "bits"])
        give_back()

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, bits int")


def failure_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, bits, n, good, toxic): documents by the set of filters they fail."""
    rows = stage(tested(docs, id, text, part))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows without an id have no labels and are no copies; they stay out of both joins
    known = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "digest", "part", "bits").agg(F.count("*").alias("n"))
    known = known.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    copies = known.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")
    )
    copies = stage(copies)
    least = copies.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    copies = copies.join(least, "digest")
    firsts = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    e = 1 << FILTERS.index("E")
    halves = F.explode(
        F.array(
            F.struct(F.col("bits").alias("bits"), firsts.alias("n")),
            F.struct(F.col("bits").bitwiseOR(e).alias("bits"), (F.col("n") - firsts).alias("n")),
        )
    )
    split = copies.select("part", "good", "toxic", halves.alias("half")).select("part", "half.bits", "half.n", "good", "toxic")
    strange = rows.where("doc_id IS NULL").select("part", "bits", F.lit(1).cast("long").alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return split.unionByName(strange).groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def removals(counts: list[int], players: int) -> list[int]:
    """v(S) for every coalition S: documents that at least one of its filters removes. ``counts`` is by failed set."""
    passed = list(counts)
    # sum over subsets: passed[T] becomes the number of documents whose failed set lies within T
    for i in range(players):
        for s in range(len(passed)):
            if s >> i & 1:
                passed[s] += passed[s ^ 1 << i]
    everything = len(passed) - 1
    return [passed[everything] - passed[everything ^ s] for s in range(len(passed))]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """Solution of a regular linear system, by elimination in rationals."""
    rows = [[*row, right] for row, right in zip(a, b, strict=True)]
    for i in range(len(rows)):
        pivot = next(r for r in range(i, len(rows)) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(len(rows)):
            if r != i and (factor := rows[r][i]):
                rows[r] = [v - factor * w for v, w in zip(rows[r], rows[i])]
    return [row[-1] for row in rows]


def shapley(values: list[int], players: int) -> list[Fraction]:
    """Shapley values as a kernel-weighted least squares fit whose shares sum to the value of all players."""
    gram = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [Fraction(0)] * (players + 1)
    for s in range(1, len(values) - 1):
        size = s.bit_count()
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        inside = [i for i in range(players) if s >> i & 1]
        for i in inside:
            right[i] += weight * values[s]
            for j in inside:
                gram[i][j] += weight
    for i in range(players):
        gram[i][players] = gram[players][i] = Fraction(1)
    right[players] = Fraction(values[-1])
    return solve(gram, right)[:players]


SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def audit_part(part: str, table: pd.DataFrame, names: str = FILTERS) -> pd.DataFrame:
    """All orders and steps of one part from its counts by failed set, at most 2 ** len(names) rows."""
    k = len(names)
    by_set = {c: [0] * (1 << k) for c in COUNTS}
    for row in table.itertuples(index=False):
        for c in COUNTS:
            by_set[c][row.bits] += int(getattr(row, c))
    total = sum(by_set["n"])
    v, good, toxic = (removals(by_set[c], k) for c in COUNTS)
    everything = (1 << k) - 1
    orders = list(permutations(range(k)))
    shares = [len(orders) * share for share in shapley(v, k)]
    if any(share.denominator != 1 for share in shares):
        raise ArithmeticError("the summed Shapley values are not whole")
    out = []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = v[after] - v[before]
            out.append(
                (part, "".join(names[i] for i in order), step, total - v[after], removed, v[1 << f] - removed,
                 v[everything] - v[everything ^ 1 << f], good[after] - good[before], toxic[after] - toxic[before], int(shares[f]))
            )
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"step": np.int32})


def filter_audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; see the module's text for the columns."""
    counts = failure_counts(docs, labels, id, text, part)
    return counts.groupBy("part").applyInPandas(lambda key, table: audit_part(key[0], table), SCHEMA)
