"""k-nearest-neighbour regression, block against block.

A block pair keeps only the k best training rows of each query, so what leaves a task is
queries x k, never all pairs; a second aggregate merges the block winners.

Euclidean distances are bounded from below by one matrix product, with its rounding taken off; only pairs whose bound does not
exceed the k-th best distance found so far have their distance computed from differences. What is kept, ties included, is
what the distances of all pairs would keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import matrix
from .gram import rectangle_blocks, runs

# differences held at once while one block meets another
SLICE_VALUES = 1 << 22
#: queries and training rows whose bounds are computed at once
QUERIES, TRAINING = 256, 4096


def nearest_by_difference(a: np.ndarray, b: np.ndarray, take: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``take`` nearest rows of ``b``, ties by place, from the differences of all pairs."""
    out = []
    few = max(1, SLICE_VALUES // max(1, b.size))
    for start in range(0, len(a), few):
        gap = np.abs(a[start : start + few, None, :] - b[None, :, :])
        distance = gap.sum(-1) if p == 1 else np.sqrt((gap * gap).sum(-1))
        order = np.argsort(distance, axis=1, kind="stable")[:, :take]
        out.append((order, np.take_along_axis(distance, order, 1)))
    return np.concatenate([o for o, _ in out]), np.concatenate([g for _, g in out])


def nearest_euclidean(a: np.ndarray, b: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_by_difference`` with p = 2, for finite rows whose squares are finite."""
    d = a.shape[1]
    # more than the rounding of a product, of a sum of squares and of the differences, as a share of both squared lengths
    slack = 16 * (d + 8) * np.finfo(float).eps
    length_a, length_b = (a * a).sum(1), (b * b).sum(1)
    low_a = length_a * (1 - slack)
    right = np.column_stack([b, length_b * (1 - slack)])
    order, distance = np.zeros((len(a), take), np.int64), np.full((len(a), take), np.inf)
    for start in range(0, len(a), QUERIES):
        end = min(start + QUERIES, len(a))
        n = end - start
        left = np.column_stack([-2 * a[start:end], np.ones(n)])
        best, place = np.full((n, take), np.inf), np.full((n, take), -1)
        for begin in range(0, len(b), TRAINING):
            part = right[begin : begin + TRAINING]
            bound = left @ part.T
            # a tiny addition keeps a limit of zero or of rounding above equal rows
            limit = best[:, -1] ** 2 * (1 + slack) - low_a[start:end]
            near = bound <= limit[:, None]
            if near.sum() > 8 * take * n and part.shape[0] > take:
                few = np.argpartition(bound, take - 1, axis=1)[:, :take]
                over = np.take_along_axis(bound, few, 1) + low_a[start:end, None] + 2 * slack * (length_a[start:end, None] + length_b[begin + few])
                near &= bound <= (over.max(1) * (1 + slack) - low_a[start:end])[:, None]
            row, column = np.nonzero(near)
            if not len(row):
                continue
            column += begin
            exact = np.empty(len(row))
            for at in range(0, len(row), step := max(1, SLICE_VALUES // max(1, d))):
                gap = np.abs(a[start + row[at : at + step]] - b[column[at : at + step]])
                exact[at : at + step] = np.sqrt((gap * gap).sum(-1))
            # those kept so far come first: their places are lower
            met = np.unique(row)
            held = place[met] >= 0
            rows = np.concatenate([np.repeat(met, take)[held.ravel()], row])
            values, places = np.concatenate([best[met][held], exact]), np.concatenate([place[met][held], column])
            sort = np.lexsort((places, values, rows))
            rows, values, places = rows[sort], values[sort], places[sort]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = rank < take
            best[rows[keep], rank[keep]], place[rows[keep], rank[keep]] = values[keep], places[keep]
        order[start:end], distance[start:end] = place, best
    return order, distance


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int = 5,
    p: int = 2,
    id_col: str = "subject_id",
    block_rows: int | None = None,
) -> DataFrame:
    """(row, query, neighbour, y, distance), the k nearest training rows of each query, ties by id."""
    # a row is asked for on its own, also where several rows share an id
    queries = queries.withColumn("_row", F.monotonically_increasing_id())
    d = len((train.select("x").first() or [[]])[0])
    cores = train.sparkSession.sparkContext.defaultParallelism
    sizes = rectangle_blocks(queries.count(), train.count(), d, d, block_rows, cores)

    def spread(side: DataFrame, is_query: bool) -> DataFrame:
        own, other = sizes if is_query else sizes[::-1]
        rows = side.select(
            F.col(id_col).alias("id"),
            (F.col("_row") if is_query else F.lit(None).cast("bigint")).alias("row"),
            "x",
            (F.lit(None) if is_query else F.col("age")).cast("double").alias("y"),
            F.lit(is_query).alias("q"),
            # salted with the vector, so copies of an id spread as well
            F.pmod(F.xxhash64(F.col(id_col), "x"), F.lit(own)).cast("int").alias("own"),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"),
        )
        a, b = ("own", "other") if is_query else ("other", "own")
        return rows.select("id", "row", "x", "y", "q", (F.col(a) * sizes[1] + F.col(b)).alias("task"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in runs(batches, ["task"]):
            values, asked = matrix(part, "x"), part.column("q").to_numpy(zero_copy_only=False)
            if asked.all() or not asked.any():
                continue
            part = part.select(["id", "row", "y"])
            left, right = part.filter(pa.array(asked)), part.filter(pa.array(~asked))
            by_id = pc.sort_indices(right.column("id"))
            right, take = right.take(by_id), min(k, len(by_id))
            # finite, and far from overflow and underflow, also once squared
            size = np.abs(values)
            plain = p != 1 and bool(((size < 1e140) & ((size > 1e-140) | (size == 0))).all())
            a, b = values[asked], values[np.flatnonzero(~asked)[by_id.to_numpy()]]
            del values, size
            order, distance = nearest_euclidean(a, b, take) if plain else nearest_by_difference(a, b, take, p)
            found = pa.array(order.ravel())
            ask = pa.array(np.repeat(np.arange(len(a)), take))
            # what is not a number has no value
            yield pa.RecordBatch.from_arrays(
                [
                    left.column("row").take(ask), left.column("id").take(ask), right.column("id").take(found),
                    pa.array(right.column("y").take(found).to_numpy(zero_copy_only=False), from_pandas=True), pa.array(distance.ravel(), from_pandas=True),
                ],
                ["row", "query", "neighbour", "y", "distance"],
            )

    kind = queries.schema[id_col].dataType.simpleString()
    both = spread(queries, True).unionByName(spread(train, False))
    dealt = both.repartitionById(sizes[0] * sizes[1], "task").sortWithinPartitions("task")
    winners = dealt.mapInArrow(best, f"row bigint, query {kind}, neighbour {kind}, y double, distance double")
    w = Window.partitionBy("row").orderBy("distance", "neighbour")
    return winners.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def knn_regress(
    queries: DataFrame, train: DataFrame, k: int = 5, p: int = 2, weights: str = "uniform", **options
) -> DataFrame:
    """(subject_id, prediction), one row per query row. Distance weights: an exact match decides alone."""
    found = nearest(queries, train, k, p, **options)
    if weights == "uniform":
        prediction = F.avg("y")
    else:
        exact = F.col("distance") == 0
        inverse = F.when(~exact, 1 / F.col("distance"))
        prediction = F.coalesce(F.avg(F.when(exact, F.col("y"))), F.sum(F.col("y") * inverse) / F.sum(inverse))
    by_row = found.groupBy("row", F.col("query").alias("subject_id")).agg(prediction.alias("prediction"))
    return by_row.drop("row")
