"""What the operators share: ASCII case, Arrow helpers, written stages and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes -> bytes, A-Z lower-cased and all else as it is
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and go on from there: cuts lineage, survives lost executors."""
    return cut_lineage(df)


def beside(docs: DataFrame, *helpers: Column) -> DataFrame:
    """All columns of ``docs`` and then the helpers, under names that cannot clash; restore the names with ``as_rows``."""
    own = [F.col(f"`{c}`").alias(f"_column_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, *(h.alias(f"_helper_{i}") for i, h in enumerate(helpers)))


def as_rows(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """The first columns of a batch under their own names."""
    return pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that what one step holds stays small beside very long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: returns freed memory of the C library to the system, where the library can
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for other stages, which count it as used."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Forest:
    """Union-find over the positions 0..n-1; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is the smallest node it can reach.

    Alternates the large-star and small-star steps of a distributed connected-components job. Each
    step is two aggregates and a join on narrow rows, and the edge list is written after each round,
    so a lost executor costs one step. Stops when a round changes nothing.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    pairs = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = star(large)
        pairs = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def in_blocks(members: DataFrame, key: list[str], member: str, size: int) -> DataFrame:
    """Members of groups, dealt to pairs of blocks so that no task meets a whole large group.

    A group of at most ``size`` members is one block. A larger one is cut into ``n`` blocks by a hash
    of the member and every pair of blocks becomes a group of its own, so that any two members still
    meet in exactly one of them. Adds ``block_a``, ``block_b`` (the group) and ``block`` (the member's own).
    Groups of one member are left out, as nobody meets there.
    """
    sizes = members.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    # written, so that both sides of the join are shuffled and Spark can split the rows of a large group
    sizes = stage(sizes.withColumn("_blocks", F.ceil(F.col("_n") / F.lit(size)).cast("int")))
    dealt = members.join(sizes, key).withColumn("block", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = dealt.withColumn("_other", other)
    return (
        dealt.withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_n", "_blocks", "_other")
    )


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterable[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows of each group, one after another in the tasks that hold the sorted groups.

    For very many small groups: unlike a grouped map there is no hand-over per group. A group is held whole, so
    its size must be bounded (see in_blocks). ``keys`` are long or int columns without nulls.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, out = None, []

        def flush() -> None:
            out.extend(work(pa.Table.from_batches(held)))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
            cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(columns[a])
                if held and key != last:
                    flush()
                held.append(batch.slice(a, b - a))
                last = key
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def long_array(rows: list[np.ndarray]) -> pa.ListArray:
    """A list<int64> column from 64-bit rows."""
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
