"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kohort")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # array columns are wide: keep an Arrow batch to a few MB
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        # per-column sketches open one group per column, more than the default of 128
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        # no call-site capture per expression: plans of wide tables build several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none, as in tests, gets a temporary folder; on a cluster, where executors
    would each write to their own disk, a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kohort-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the file system that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def settle(small: DataFrame) -> DataFrame:
    """Write a derived lookup table and read it back, so that its size is known before it is joined.

    Read from files it is broadcast when smaller than ``spark.sql.autoBroadcastJoinThreshold``;
    beyond that Spark falls back to a sort-merge join. Left as a plan of unknown size it would
    have made Spark shuffle the large side by a site or model key, of which there are few.
    """
    return cut_lineage(small)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Iterative operators call this so that a lost executor re-reads a file
    instead of replaying every earlier iteration.
    """
    path = work_folder(df.sparkSession) + "/stage"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
