"""A folder of uploads as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageforge.operators.uploads import validate

SCHEMA = "session_id string, name string, mime string, content binary, uploaded_at timestamp"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Upload rows from Parquet files as they arrive, validated."""
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    return validate(rows.withColumn("length", F.length("content")))


def per_hour(validated: DataFrame, late: str = "1 hour") -> DataFrame:
    """Accepted and rejected uploads of each hour; hours close when the watermark passes them."""
    window = F.window("uploaded_at", "1 hour")
    counted = validated.withWatermark("uploaded_at", late).groupBy(window.alias("hour"))
    return counted.agg(F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"))


def store(validated: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what was accepted to a table, all that is there by now, and stops."""
    accepted = validated.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
