"""Sessions whose Python workers can import this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of an Arrow batch at most (a single row may be larger): what JVM and Python worker hold at once for a task.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


#: Python workers live on between tasks; with these they give the memory of a task's arrays back.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": "1000000", "MALLOC_TRIM_THRESHOLD_": "4000000", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' path and bounds Arrow batches by bytes.

    On a cluster without that folder, ship it with --py-files.
    """
    held = spark.conf.get(BATCH[0], None)
    held = held.rstrip("b") if held else "0"
    if held.isdigit() and not 0 < int(held) <= BATCH[1]:  # what a user has set with a unit stays
        spark.conf.set(BATCH[0], str(BATCH[1]))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for name, value in ALLOCATION.items():
        env.setdefault(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach, in spark.checkpoint.dir.

    Where that is unset, a local folder is set on a single machine; on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pageforge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pageforge-{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that run within it leave no shuffle files; others' stay until the driver happens to collect its garbage."""
    held = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, held)


def cut(df: DataFrame, where: str, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it: a lineage cut that survives lost executors.

    What was shuffled for it is removed, as nothing reads it again.
    """
    path = f"{where}/{name}"
    with freeing(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local(name: str = "pageforge", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and local runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    conf = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return prepare(builder.config(map=conf).getOrCreate())
