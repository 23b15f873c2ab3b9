"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to unit length and turned by pseudo-rotations, three rounds of random signs and a Hadamard
transform; the hash of a vector is the signed axis nearest to it. ``tables`` rotations make ``tables``
hash tables; a query looks into the ``probes`` nearest axes of each. Where a query meets a candidate its exact
Euclidean distance is computed at once, on the original vectors in double precision, and only the ``k`` best of
each query leave a group, so nothing of the size of all candidate pairs is ever written or shuffled.

A bucket is dealt in blocks of bounded size, candidates and queries alike, so that a crowded axis is
many tasks. Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest, the rest is left out
before the search, exactly; they still ask as queries.

A query that met fewer than ``k`` candidates meets all vectors of its width in a second search, in blocks of the same
bound, so every query has ``k`` rows, or one for each candidate if there are fewer.

Defined cases: null, empty, zero vectors and those holding null or non-finite components take no part; vectors
of different length never meet; rows with a null id take no part; a repeated row counts once; a row whose id
is the query's is never its neighbour; ties go to the smaller id; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage

#: rows of a block, of candidates and of queries
BLOCK = 4096
#: differences held at once while distances are computed
HELD = 1 << 21


def rotate(x: np.ndarray, table: int, rounds: int = 3) -> np.ndarray:
    """Pseudo-rotation number ``table`` of the rows of ``x``, whose width is a power of two."""
    width = x.shape[1]
    signs = np.random.Generator(np.random.PCG64([table, width])).choice([-1.0, 1.0], (rounds, width))
    for s in signs:
        x, half = x * s, 1
        while half < width:
            x = x.reshape(len(x), -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), width)
            half *= 2
        x = x / np.sqrt(width)
    return x


def axes(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row (2 i for +i, 2 i + 1 for -i), nearest first."""
    width = 1 << max(0, vectors.shape[1] - 1).bit_length()
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = np.zeros((len(vectors), width))
    unit[:, : vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    turned = rotate(unit, table)
    both = np.stack([turned, -turned], axis=2).reshape(len(turned), -1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def hashed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(bucket, id, v) for each table and probe; a bucket names the width, the table and the axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            ids, raw = batch.column(0), batch.column(1).to_pylist()
            rows = [np.frombuffer(v, np.float64) for v in raw]
            for width in sorted({len(r) for r in rows}):
                own = [i for i, r in enumerate(rows) if len(r) == width]
                x = np.stack([rows[i] for i in own])
                for table in range(tables):
                    found = axes(x, table, probes)
                    bucket = ((width * tables + table) << 20) + found
                    at = pa.array(np.repeat(own, found.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket.ravel(), pa.int64()), ids.take(at), batch.column(1).take(at)], ["bucket", "id", "v"]
                    )

    return vectors.mapInArrow(run, "bucket long, id long, v binary")


def pack_vectors(table: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part, v the components as doubles."""
    x = F.col(vector).cast("array<double>")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4096):
            column = batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()).cumsum()
            rows = [r.astype(np.float64).tobytes() for r in np.split(flat, ends[:-1])] if len(ends) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "v"])

    rows = table.select(F.col(id).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & usable)
    return rows.mapInArrow(run, "id long, v binary").distinct()


def without_copies(vectors: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the rows with the ``most`` smallest ids; first within salts, so that no copy group is one task."""
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        order = Window.partitionBy(*keys).orderBy("id")
        salted = salted.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return salted.select("id", "v")


def blocks(rows: DataFrame, name: str) -> DataFrame:
    """Number of blocks of each bucket."""
    return rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))


def distances(queries: np.ndarray, vectors: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of Euclidean distances, a few queries at a time."""
    step = max(1, HELD // max(1, vectors.size))
    for start in range(0, len(queries), step):
        difference = queries[start : start + step, None, :] - vectors[None, :, :]
        yield from np.sqrt((difference * difference).sum(axis=2))


def meet(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of the candidates that share a bucket with each query."""
    sizes = stage(blocks(index, "index_blocks").join(blocks(asked, "asked_blocks"), "bucket"))

    def dealt(side: DataFrame, own: str, other: str, flag: bool) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        dealt = side.join(sizes, "bucket")
        mine = F.pmod(F.xxhash64("id"), F.col(own + "_blocks")).cast("int").alias(own)
        theirs = F.explode(F.sequence(F.lit(0), F.col(other + "_blocks") - 1)).alias(other)
        return dealt.select("bucket", "id", "v", F.lit(flag).alias("asks"), mine, theirs).select(
            "bucket", "id", "v", "asks", "index", "asked"
        )

    meeting = dealt(index, "index", "asked", False).unionByName(dealt(asked, "asked", "index", True))

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = group.column("id").to_numpy()
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float64).reshape(len(ids), -1)
        q_ids, v_ids = ids[asks], ids[~asks]
        # by id, so that a stable order breaks ties in favour of the smaller one
        order = np.argsort(v_ids, kind="stable")
        v_ids, vectors = v_ids[order], x[~asks][order]
        out: tuple[list, list, list] = ([], [], [])
        if len(q_ids) and len(v_ids):
            for q, d in zip(q_ids, distances(x[asks], vectors), strict=True):
                best = np.argsort(d, kind="stable")
                best = best[v_ids[best] != q][:k]
                out[0].extend([q] * len(best))
                out[1].extend(v_ids[best])
                out[2].extend(d[best])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = meeting.groupBy("bucket", "index", "asked").applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(table: DataFrame, every: int = 100, k: int = 10, tables: int = 12, probes: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = stage(pack_vectors(table, id, vector))
    kept, queries = without_copies(rows, k + 1), rows.where(F.col("id") % every == 0)
    index, asked = stage(hashed(kept, tables, 1)), stage(hashed(queries, tables, probes))
    found = stage(meet(index, asked, k))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stage(queries.join(full, "id", "left_anti"))
    if short.isEmpty():
        return found
    # one bucket per width: who met fewer than k meets every candidate, so that its answer is exact
    width = F.octet_length("v").cast("long").alias("bucket")
    whole = meet(kept.select(width, "id", "v"), short.select(width, "id", "v"), k)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(whole)
