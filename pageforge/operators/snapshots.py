"""The state of pages from a stored snapshot and the edits since, whatever order edits come in.

A snapshot has two tables: what each page's edits amount to, with the key (at, seq) of every edit that decided something,
and the turns that still count, those after the page's last crop.  Two snapshots of any two parts of a log merge into
that of both: later keys win, and turns that a crop of the other part has overtaken go.  So late edits are put right, and
a log is folded once, however it is cut into batches.

Logs are tables partitioned by batch, the number under which edits arrived.  A stored snapshot is named by the last
batch that it holds; `advance` reads that snapshot and later batches alone.  A version counts when it is written whole,
so a run that broke off or runs twice does no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of edits whose last value counts, and the column that holds it.
LAST = {"recrop": "corners", "mode": "mode", "demoire": "on"}


@dataclass(frozen=True)
class Snapshot:
    """pages: page_id, <kind>_key and <kind> of each of LAST, deleted, n_exports, n_edits; turns: page_id, key, degrees."""

    pages: DataFrame
    turns: DataFrame


def _counting(turns: DataFrame, pages: DataFrame) -> DataFrame:
    """The turns after each page's last crop."""
    crop = pages.where("recrop_key is not null").select("page_id", "recrop_key")
    return turns.join(crop, "page_id", "left").where(F.col("recrop_key").isNull() | (F.col("key") > F.col("recrop_key"))).drop("recrop_key")


def folded(log: DataFrame) -> Snapshot:
    """The snapshot of edits (page_id, at, seq, op, degrees, mode, on, corners), as `catalog.page_state` reads them."""
    key = F.struct("at", "seq")
    own = {op: F.when(F.col("op") == op, key) for op in LAST}
    last = [c for op, value in LAST.items() for c in (F.max(own[op]).alias(f"{op}_key"), F.max_by(F.when(F.col("op") == op, F.col(value)), own[op]).alias(op))]
    pages = log.groupBy("page_id").agg(*last, F.coalesce(F.bool_or(F.col("op") == "delete"), F.lit(False)).alias("deleted"), F.count_if(F.col("op") == "export").alias("n_exports"), F.count("*").alias("n_edits"))
    turns = log.where((F.col("op") == "rotate") & (F.col("degrees") % 360 != 0)).select("page_id", key.alias("key"), "degrees")
    return Snapshot(pages, _counting(turns, pages))


def merged(a: Snapshot, b: Snapshot) -> Snapshot:
    last = [c for op in LAST for c in (F.max(f"{op}_key").alias(f"{op}_key"), F.max_by(op, f"{op}_key").alias(op))]
    pages = a.pages.unionByName(b.pages).groupBy("page_id").agg(*last, F.bool_or("deleted").alias("deleted"), F.sum("n_exports").alias("n_exports"), F.sum("n_edits").alias("n_edits"))
    return Snapshot(pages, _counting(a.turns.unionByName(b.turns), pages))


def state(s: Snapshot) -> DataFrame:
    """The columns of `catalog.page_state`."""
    turns = s.turns.groupBy("page_id").agg(F.sum("degrees").alias("degrees"))
    out = s.pages.join(turns, "page_id", "left")
    rotation = F.pmod(F.coalesce("degrees", F.lit(0)), F.lit(360)).cast("int")
    return out.select("page_id", F.col("recrop").alias("corners"), F.coalesce("mode", F.lit("color")).alias("mode"), "demoire", "deleted", "n_exports", "n_edits", rotation.alias("rotation"))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are whole, from the marker that Spark writes last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/turns/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and done(n))


def stored(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot | None:
    """A version of the snapshots in a folder, the last one by default."""
    every = _versions(spark, folder)
    if version is None and every:
        version = every[-1]
    return Snapshot(*(spark.read.parquet(f"{folder}/{version}/{t}") for t in ("pages", "turns"))) if version in every else None


def since(spark: SparkSession, folder: str, log: DataFrame) -> DataFrame:
    """The batches of a log (partitioned by batch) that the last snapshot lacks; no other is read."""
    every = _versions(spark, folder)
    return log.where(F.col("batch") > every[-1]) if every else log


def advance(spark: SparkSession, folder: str, log: DataFrame) -> Snapshot | None:
    """Folds the batches that are new into the last snapshot, and stores and returns the result; nothing new, nothing done."""
    before, new = stored(spark, folder), since(spark, folder, log)
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        return before
    after = folded(new)
    after = after if before is None else merged(before, after)
    after.pages.write.mode("overwrite").parquet(f"{folder}/{last}/pages")
    pages = spark.read.schema(after.pages.schema).parquet(f"{folder}/{last}/pages")
    turns = _counting(after.turns, pages)  # the crops are known by now; the marker of this table ends the version
    turns.write.mode("overwrite").parquet(f"{folder}/{last}/turns")
    return stored(spark, folder, last)
