"""Tables that streams append to without writing anything twice.

Each micro-batch goes to a partition of its own, named by its number, and replaces what an earlier attempt has left
there.  So a batch that is repeated after a failure changes no row, and nothing of a batch that broke off stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def write_batch(rows: DataFrame, batch: int, folder: str) -> None:
    """Puts the rows of a batch in its partition, in place of others there; other partitions stay as they are.

    A batch without rows leaves an empty partition: it removes what an earlier attempt wrote.
    """
    if BATCH in rows.columns:
        raise ValueError(f"the table's own column is called {BATCH}")
    rows.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")


def read(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All rows with their batch.  With a schema (without the batch) tables of no batch yet can be read."""
    reader = spark.read.option("basePath", folder)
    return reader.schema(f"{schema}, {BATCH} long").parquet(folder) if schema else reader.parquet(folder)


def store(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes all that a stream holds by now, batch by batch, and stops."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of rows with one key, which several batches may hold, that of the last batch."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), BATCH).alias("r")).select(*key, "r.*")
