"""Session settings and the shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches for Python hold whole texts; fewer rows at once keep them small in the JVM and in the worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on that may change on a live session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_for(spark: SparkSession, input_bytes: int, partition_bytes: int = 128 * 2**20) -> int:
    """Shuffle partitions for an input: one per ``partition_bytes``, merged at run time where small.

    The setting only grows; 100 TB at 128 MB give about 800,000, so pass a larger partition
    size where executors have the memory (512 MB: 200,000).
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def stored_bytes(df) -> int:
    """Size of the files of a table, as Spark's statistics have it from the listing of its folder; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def local_session(cores: str = "*", memory: str = "8g", partitions: int = 8, shared: str | None = None) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own. ``shared`` is a new folder where not given."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orebook")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="orebook-shared-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, named by the cluster in ``spark.checkpoint.dir``.

    A session without the setting gets a temporary folder when it runs in local mode
    only; on a cluster the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    return os.path.join(tempfile.gettempdir(), "orebook-checkpoints")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/orebook/{name}-{uuid.uuid4().hex}"


def cut(df, name: str):
    """Write ``df`` to the shared folder and read it back: one evaluation for many readers.

    The files outlive any executor, so a lost task re-reads them instead of the lineage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
