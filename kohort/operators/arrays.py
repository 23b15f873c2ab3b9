"""Arrow batches to numpy matrices and back, and distributed sums of array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(batch: pa.RecordBatch, name: str, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as an (n, d) matrix."""
    column = batch.column(name)
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    # Spark may split a column over several lists; an empty first row means d = 0
    if column.null_count:
        raise ValueError(f"column {name} holds NULL vectors")
    lengths = column.value_lengths()
    if pc.min(lengths) != pc.max(lengths):
        raise ValueError(f"column {name} holds vectors of different lengths")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(len(column), -1), dtype=dtype)


def vector(batch: pa.RecordBatch, name: str, dtype=np.float64) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(dtype)


def list_array(values: np.ndarray) -> pa.ListArray:
    """An (n, d) matrix as an Arrow list column."""
    values = np.ascontiguousarray(values, dtype=np.float64)
    n, d = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d) if d else np.zeros(n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


DIRECT_PARTITIONS = 32


def collect_sum(df: DataFrame, column: str, partitions: int) -> np.ndarray:
    """Element-wise sum of the one-row-per-task results of a repeated pass, as a driver array.

    Up to ``DIRECT_PARTITIONS`` tasks send their sums straight to the driver, which saves two
    shuffles in every pass of an iterative fit; more tasks are merged on the executors first.
    """
    if partitions <= DIRECT_PARTITIONS:
        return np.sum([r[0] for r in df.select(column).collect()], axis=0)
    return np.asarray(sum_arrays(df, column).first()[column])


def sum_arrays(df: DataFrame, column: str, by: list[str] | None = None, fan_in: int = 64) -> DataFrame:
    """Element-wise sum of an array column per group, in two rounds.

    Every task contributes one row per group; the first round adds them in ``fan_in``
    slices so that no single task has to read the output of a whole large stage.
    """
    by = by or []
    sliced = df.select(*by, array_to_vector(column).alias("_v"), (F.spark_partition_id() % fan_in).alias("_s"))
    partial = sliced.groupBy(*by, "_s").agg(Summarizer.sum(F.col("_v")).alias("_v"))
    total = partial.groupBy(*by).agg(Summarizer.sum(F.col("_v")).alias("_v"))
    return total.select(*by, vector_to_array("_v").alias(column))


#: numbers in one slice of a summed array
SLICE = 4096


#: slices in one batch, so that a task's sums are not copied as a whole on their way out
SLICES = 256


def sliced(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task returns for ``sum_slices``: its array of each group, cut into slices."""
    kinds = pa.int32(), pa.int32(), pa.list_(pa.float64())
    for g, s in sums.items():
        flat = s.ravel()
        places = range(-(-flat.size // SLICE))
        for begin in range(0, len(places), SLICES):
            parts = places[begin : begin + SLICES]
            columns = [g] * len(parts), parts, [flat[part * SLICE : (part + 1) * SLICE] for part in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "part", "s"])


def fewer_sums(df: DataFrame, rows: int, width: int) -> DataFrame:
    """``df`` in so few partitions that tasks which each return width * width sums do not return more than they read."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // max(width, 1)))


def summed_slices(df: DataFrame) -> DataFrame:
    """The rows (g, part, s) of all tasks added up, a row per slice."""
    return df.groupBy("g", "part").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))


def sum_slices(df: DataFrame) -> dict[int, np.ndarray]:
    """{group: array} summed over the rows (g, part, s) of all tasks, for passes that repeat.

    One shuffle by slice: a reducer adds up one slice of every task as they come, so neither a task nor the driver reads
    the whole arrays of a large stage, and the driver gets one array per group.
    """
    rows = sorted((r["g"], r["part"], r["s"]) for r in summed_slices(df).collect())
    found: dict[int, list] = {}
    for g, _, s in rows:
        found.setdefault(g, []).append(s)
    return {g: np.concatenate(s) for g, s in found.items()}
