"""Whitening of vectors by Chan's merging of covariances (operator 11).

Components become whole numbers, floor(64 c) + 1000000, and the model is fitted to each distinct vector once.  Each
partition of these gives a count, whole sums, and the scatter about its own mean; treeReduce merges two of them at a
time, the difference of their means taken from the whole sums without rounding.  The driver holds one matrix for each
length of vectors, never rows.  A second pass projects the fitted vectors and merges the covariance of the results in the
same way: its distance from the identity is part of the answer.

Vectors that are null, or hold null or non-finite components, or ones too large for a long, are left out; vectors of
different lengths are whitened apart, each length with a model of its own; empty vectors have no components.  Zero
vectors and null ids take part, repeated rows are fitted once and returned each, extra columns of any name are ignored.
A component without variance (fewer distinct vectors than components, constant ones) has a null `whitened`; where no
component has any, `explained` is null too.  Of equal variances any order and any axes are right.  An empty table gives
none.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageforge.llm.common import cut, pick, shared_dir, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Components beyond this in size do not fit a long.
LARGEST = 2.0**56
#: Up to here sums and products of whole numbers are taken in 64 bits, beyond in Python's integers.
EXACT = 2.0**61
ROWS = 4096


def whole(v: Column) -> Column:
    """The components as whole numbers; null where the vector takes no part."""
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST), F.lit(False)))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")))


@dataclass
class Moments:
    """Count, sums (Python integers where the rows are whole numbers), scatter about the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        """Of at least one row; whole numbers are centred about the first row before they become doubles."""
        first, n = rows[0], len(rows)
        past = (rows - first).astype(np.float64)
        sums = past.sum(0)
        past -= sums / n
        whole = np.issubdtype(rows.dtype, np.integer)
        total = _exact_sums(rows) if whole else sums + n * first
        return Moments(n, total, past.T @ past)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula; the difference of the means is taken from cross products, so that whole sums lose nothing."""
        a, b = self.n, other.n
        apart = ((other.sums * a - self.sums * b) / (a * b)).astype(np.float64)
        return Moments(a + b, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (a / (a + b) * b))


def _exact_sums(rows: np.ndarray) -> np.ndarray:
    if float(np.abs(rows.astype(np.float64)).max(initial=0)) * len(rows) < EXACT:
        return rows.sum(0).astype(object)
    return rows.astype(object).sum(0)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the rows of each length above 0."""
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        yield own, flat[starts[own][:, None] + np.arange(n)]


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    out = dict(a)
    for n, m in b.items():
        out[n] = out[n].merged(m) if n in out else m
    return out


def _summaries(batches: Iterator[pa.RecordBatch], models: dict[int, Model] | None) -> Iterator[pa.RecordBatch]:
    held: dict[int, Moments] = {}
    for batch in batches:
        for _, x in by_length(batch.column("x")):
            for at in range(0, len(x), ROWS):
                rows = x[at : at + ROWS]
                if models is not None:
                    model = models[rows.shape[1]]
                    rows = model.project(model.centred(rows))[:, : model.live]
                held = _merged(held, {x.shape[1]: Moments.of(rows)})
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)])], ["moments"])


def moments(vectors: DataFrame, models: dict[int, Model] | None = None) -> dict[int, Moments]:
    """The moments of column x of all rows by length; with models, those of the whitened rows."""
    rows = vectors.select("x").mapInArrow(partial(_summaries, models=models), "moments binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return rows.treeReduce(_merged) if rows.getNumPartitions() else {}


@dataclass
class Model:
    """Of vectors of one length: axes as columns by falling variance, as many as asked for, `live` of them with variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    live: int
    total: float
    identity_error: float | None = None

    @staticmethod
    def of(m: Moments, most: int = COMPONENTS) -> Model:
        cov = m.scatter / m.n
        values, axes = np.linalg.eigh(cov)
        values, axes = values[::-1], axes[:, ::-1]
        live = int((values > max(values[0], 0.0) * len(values) * np.finfo(float).eps).sum())
        return Model(m.n, [int(s) for s in m.sums], np.ascontiguousarray(axes[:, :most]), values[:most].copy(), min(live, most), float(np.trace(cov)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self._spread(x) / self.n).astype(np.float64)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers."""
        if self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) < EXACT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n x - S) ** 2 of each row, exactly."""
        apart = self._spread(x)
        if float((apart.astype(np.float64) ** 2).sum(1).max(initial=0)) < EXACT:
            return (apart.astype(np.int64) ** 2).sum(1).tolist()
        return (apart.astype(object) ** 2).sum(1).tolist()

    def project(self, centred: np.ndarray) -> np.ndarray:
        """On axes of unit variance; components without variance are not a number."""
        out = np.full((len(centred), len(self.values)), np.nan)
        out[:, : self.live] = centred @ self.axes[:, : self.live] / np.sqrt(self.values[: self.live])
        return out


def fit(df: DataFrame, most: int = COMPONENTS, vector: str = "embedding", where: str | None = None) -> dict[int, Model]:
    """A model for each length of the distinct vectors of a table."""
    spark = df.sparkSession
    distinct = df.select(whole(F.col(f"`{vector}`")).alias("x")).where("x is not null and size(x) > 0").distinct()
    distinct = cut(distinct, where or shared_dir(spark), "fit")  # read twice
    models = {n: Model.of(m, most) for n, m in moments(distinct).items()}
    for n, m in moments(distinct, models).items():
        if models[n].live:
            models[n].identity_error = float(np.abs(m.scatter / m.n - np.eye(models[n].live)).max())
    return models


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _rows(batches: Iterator[pa.RecordBatch], models: dict[int, Model]) -> Iterator[pa.RecordBatch]:
    from decimal import Decimal

    for batch in batches:
        for own, every in by_length(batch.column("x")):
            model = models[every.shape[1]]
            k = len(model.values)
            explained = model.values / model.total if model.total > 0 else np.full(k, np.nan)
            for at in range(0, len(own), ROWS):
                x = every[at : at + ROWS]
                ids = batch.column("vec_id").take(pa.array(np.repeat(own[at : at + ROWS], k)))
                values = model.project(model.centred(x)).ravel()
                apart = pa.array([Decimal(d) for d in model.deviation(x)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                shares = np.tile(explained, len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(values), model.n)),
                        apart,
                        pa.array(values, mask=np.isnan(values)),
                        pa.array(shares, mask=np.isnan(shares)),
                        pa.array([model.identity_error] * len(values), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )


def whiten(df: DataFrame, models: dict[int, Model], vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector of a length that has a model, and each component."""
    known = [F.lit(n) for n in sorted(models)]
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole(F.col(f"`{vector}`")).alias("x")).where("x is not null")
    rows = rows.where(F.size("x").isin(known) if known else F.lit(False))
    return rows.mapInArrow(partial(_rows, models=models), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of the table; a deviation that does not fit a long is an error."""
    vectors = pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", embedding="embedding")
    return whiten(vectors, fit(vectors)).withColumn("deviation", F.col("deviation").cast("long"))
