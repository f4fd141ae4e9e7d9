"""Shared helpers of the training-data operators: tables, shared folders, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.session import cut, freeing, shared_dir, shuffle_parts

__all__ = ["cut", "freeing", "shared_dir", "shuffle_parts"]  # of the session, for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: other columns, whatever they are called, go."""
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in columns.items()])


def drop(spark: SparkSession, where: str, *names: str) -> None:
    """Removes tables that `cut` wrote, once what was made of them is written itself."""
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 18, rows: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each part has about `most` bytes of text, and `rows` rows at most.

    Rows stay whole: a row that is longer than `most` is a part of its own.
    """
    _, off = byte_view(batch.column(text))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        end = min(end, at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of many byte spans of one buffer at once.

    A polynomial over random per-byte codes, modulo 2**64: prefix sums give every span in constant time; an odd base
    has an inverse, so equal spans get equal hashes wherever they stand.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.codes = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power))
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                row = np.full(size, np.uint64(base))
                row[0] = 1
                setattr(self, name, np.cumprod(row, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.power[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.inverse[starts]
        return splitmix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))
