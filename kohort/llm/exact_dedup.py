"""Exact deduplication against a persistent digest index, with built-in functions only.

The index is a table bucketed and sorted by digest. New rows are reduced to one row per digest
(combined before the shuffle, so a group holding a third of all rows collapses in its own tasks),
anti-joined with the index by a sort-merge join that moves only the new digests, and appended.

Defined cases: a null text counts as empty, and all empty texts are equal; a null id ranks below
every other; of several rows with one id and equal texts exactly one stays; an empty table gives an
empty result; further columns pass through untouched where rows are filtered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.session import work_folder

from .common import ascii_lower, stage, tasks


def digest_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8 after lower-casing A-Z; null as empty."""
    return F.sha2(ascii_lower(text), 256)


class DigestIndex:
    """Digests seen so far: ``digest, keep_id, keep_row``, bucketed and sorted by ``digest``.

    The table lives at ``location``; opening the same location in a later session finds the digests
    of earlier ones. ``buckets`` is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT, keep_row BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add those of ``rows`` (digest, id, row) whose digest is new; the largest id of a digest stays for it."""
        heads = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("head"))
        heads = heads.select("digest", F.col("head.id").alias("keep_id"), F.col("head.row").alias("keep_row"))
        fresh = heads.repartition(self.buckets, "digest").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti"
        )
        # append, never overwrite: what the index holds is not rewritten
        fresh.select("digest", "keep_id", "keep_row").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index of its own in the shared folder."""
    folder = work_folder(spark)
    return DigestIndex(spark, f"digests_{folder.rsplit('/', 1)[-1]}", f"{folder}/digests", buckets or tasks(spark))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, row) per row, written once so that the text is hashed once and row numbers stay."""
    return stage(
        docs.select(
            F.col(id).cast("long").alias("id"), digest_of(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")
        )
    )


def in_batches(rows: DataFrame, index: DigestIndex, batches: int = 2) -> None:
    """Feed ``rows`` to the index, largest ids first, as ``batches`` arrivals.

    The order makes the largest id stay for its digest, as an earlier arrival always wins.
    """
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if low is None:
        index.append(rows)
        return
    cuts = [low + (high + 1 - low) * i // batches for i in range(batches + 1)]
    for i in reversed(range(batches)):
        part = (F.col("id") >= cuts[i]) & (F.col("id") < cuts[i + 1])
        index.append(rows.where(part | F.col("id").isNull() if i == 0 else part))


def decide(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per row of ``rows``: id, digest, keep_id, group_size, kept."""
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    # written, so that both sides of the next join are shuffled and Spark can split a hot digest
    settled = stage(sizes.join(index.table().hint("merge"), "digest"))
    return rows.join(settled.hint("merge"), "digest").select(
        "id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept")
    )


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """The decision on every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, index = digests(docs, id, text), new_index(docs.sparkSession)
    in_batches(rows, index, batches)
    return decide(rows, index).select(
        F.col("id").alias(id), "keep_id", F.col("group_size").cast("long"), "kept", F.col("digest").alias("text_sha256")
    )


def drop_exact(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """``docs`` without its exact copies, all columns kept.

    The rows meet the index on (digest, id), so the copies of a hot text are spread over all tasks.
    """
    rows, index = digests(docs, id, text), new_index(docs.sparkSession)
    in_batches(rows, index, batches)
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    inner = inner.withColumn("digest", digest_of(F.col(f"d.`{text}`"))).withColumn("id", F.col(f"d.`{id}`").cast("long"))
    keep = index.table().select(F.col("digest").alias("k_digest"), F.col("keep_id"))
    on = reduce(lambda a, b: a & b, [F.col("digest") == F.col("k_digest"), F.col("id").eqNullSafe(F.col("keep_id"))])
    kept = inner.join(keep, on, "left_semi")
    return kept.dropDuplicates(["digest", "id"]).select(*names)
