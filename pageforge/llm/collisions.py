"""Approximate nearest neighbours by collision counting (operator 9).

Vectors are dealt into cells, by the nearest of some of them, and large cells into shards by hash.  A shard keeps, for
each of some random directions, its vectors sorted by their projection.  Around a query's projection a window opens in
every sorted array; the windows widen by a factor (virtual rehashing: wider windows need no other index), and vectors
that lie in more windows than a threshold are verified by their true distance.

A query is searched in its own shard first, until as many neighbours as asked for lie within the radius that the windows
stand for.  The distance of the last of these bounds the search elsewhere: a query goes only to cells whose projections
its windows of that radius meet in as many directions as the threshold asks for, as no vector of another cell can
collide often enough, and there one window is opened, of that radius.

Every row is indexed.  Queries stream through the shards in batches, so memory holds one shard and one batch.
Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of another length than
the query's are no candidates.  Ties go to the smaller id; rows with the query's own id are its own and no candidates,
and what is found for several rows of one id is ranked together.  Tables without queries give no rows, nor do empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.llm.common import cut, pick, shared_dir, table
from pageforge.llm.vectors import is_sound, matrix

#: Random directions; half a window's width for radius 1; share of the directions that must collide (1.5 deviations below
#: what a vector at the radius has); growth of the radius.
DIRECTIONS, HALF_WIDTH, GROWTH = 64, 0.8, 1.2
_P = 0.5763  # how often a vector at the radius lies in a window: P(|N(0,1)| <= HALF_WIDTH)
THRESHOLD = _P - 1.5 * (_P * (1 - _P) / DIRECTIONS) ** 0.5
#: Rows of a shard at most, rows for a cell, cells at most.
MOST, LEAST, CELLS = 50_000, 5_000, 1024


def axes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, DIRECTIONS))


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        n, dim = rows.shape
        self.axes = axes(dim)
        spots = (rows @ self.axes).T
        order = np.argsort(spots, axis=1)
        spots = np.take_along_axis(spots, order, 1)
        self.scale = float(np.sqrt((rows**2).sum(1).max())) or 1.0
        self.step = 64 * self.scale * dim**0.5 + 1.0  # keeps the arrays apart in one sorted line
        self.order = order.astype(np.int32).ravel()
        self.line = (spots + self.step * np.arange(DIRECTIONS)[:, None]).ravel()
        self.first = np.arange(DIRECTIONS) * n
        self.low, self.high = spots[:, 0].copy(), spots[:, -1].copy()

    def nearest(self, own: int, q: np.ndarray, k: int, within: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found; of those no farther than `within`, by windows of that radius alone."""
        n = len(self.ids)
        reach = self.step * 0.49
        spot = np.clip(q @ self.axes, -reach, reach) + self.step * np.arange(DIRECTIONS)
        low = high = np.searchsorted(self.line, spot)
        low, high = np.clip(low, self.first, self.first + n), np.clip(high, self.first, self.first + n)
        count, checked = np.zeros(n, np.int32), np.zeros(n, bool)
        found, distance = np.zeros(0, np.int64), np.zeros(0)
        need = THRESHOLD * DIRECTIONS
        radius = self.scale / 64 if within is None else within
        while True:
            half = min(HALF_WIDTH * radius, reach)
            wide = half >= reach
            new_low = self.first if wide else np.clip(np.searchsorted(self.line, spot - half), self.first, self.first + n)
            new_high = self.first + n if wide else np.clip(np.searchsorted(self.line, spot + half, side="right"), self.first, self.first + n)
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            start, size = np.concatenate([new_low, high]), np.concatenate([low - new_low, new_high - high])
            low, high = new_low, new_high
            total = int(size.sum())
            if total:
                ends = np.cumsum(size)
                met = self.order[np.repeat(start - (ends - size), size) + np.arange(total)]
                if total > n // 4:
                    count += np.bincount(met, minlength=n).astype(np.int32)
                    fresh = np.flatnonzero((count >= need) & ~checked)
                else:  # only what was met anew can have come over the threshold
                    np.add.at(count, met, 1)
                    fresh = np.unique(met[(count[met] >= need) & ~checked[met]])
                if len(fresh):
                    checked[fresh] = True
                    fresh = fresh[self.ids[fresh] != own]
                    found = np.concatenate([found, fresh])
                    distance = np.concatenate([distance, euclidean(self.rows[fresh], q)])
                    if len(found) > k:
                        best = np.lexsort((self.ids[found], distance))[:k]
                        found, distance = found[best], distance[best]
            if within is not None or wide or len(found) >= k and distance.max() <= radius:
                best = np.lexsort((self.ids[found], distance))[:k]
                best = best[distance[best] <= within] if within is not None else best
                return self.ids[found[best]], distance[best]
            radius *= GROWTH


def euclidean(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances in double precision, squares added up in the order of the components."""
    return np.sqrt(np.cumsum((rows - q) ** 2, axis=1)[:, -1])


FOUND = "query_id long, vec_id long, score double, dim int, cell int, low array<double>, high array<double>"


def _search(batches: Iterator[pa.RecordBatch], k: int, ends: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by length, cell and shard, a shard's vectors before its queries; what is found and, with `ends`, each shard's reach of projections."""
    key, held, shard = None, [], None
    names = [x.split()[0] for x in FOUND.split(", ")]
    doubles = pa.list_(pa.float64())

    def built():
        nonlocal shard, held
        if shard is None and held:
            shard, held = Shard(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), []
            if not ends:
                return
            one = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([shard.low.tolist()], doubles), pa.array([shard.high.tolist()], doubles)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "sub", "asks", "vec_id", "within")]
        change = np.flatnonzero(sum(np.diff(c.astype(np.int64)) != 0 for c in cols[:4])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            part, now = matrix(batch.column("v").slice(a, b - a)), tuple(int(c[a]) for c in cols[:3])
            if now != key:
                if ends:  # also of shards without queries
                    yield from built()
                key, held, shard = now, [], None
            if not cols[3][a]:
                held.append((cols[4][a:b].copy(), part.copy()))
                continue
            yield from built()
            if shard is None:
                continue
            out = [(int(own), *shard.nearest(int(own), q, k, None if np.isnan(r) else float(r))) for own, q, r in zip(cols[4][a:b], part, cols[5][a:b])]
            n = sum(len(x[1]) for x in out)
            asked = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
            found = [pa.array(asked), *(pa.array(np.concatenate([x[i] for x in out])) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, doubles), pa.nulls(n, doubles)], names)
    if ends:
        yield from built()


def _celled(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with the number of the nearest pivot of their length; -1 where none has it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.full(b.num_rows, -1, np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                if dim in shared.value:
                    p = shared.value[dim]
                    x = matrix(b.column("v").take(pa.array(own)))
                    cell[own] = ((p**2).sum(1) - 2 * (x @ p.T)).argmin(1)
            yield b.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, "vec_id long, v array<double>, dim int, cell int")


def _routed(queries: DataFrame, reach: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each query once for each cell that it must visit: its own, cells without a pivot, and those that its windows meet."""
    by_dim: dict[int, list] = {}
    for (dim, cell), (low, high) in reach.items():
        by_dim.setdefault(dim, []).append((cell, low, high))
    table = {dim: (np.array([c for c, _, _ in x]), np.stack([y for _, y, _ in x]), np.stack([z for _, _, z in x])) for dim, x in by_dim.items()}
    shared = queries.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            dims, within = b.column("dim").to_numpy(), b.column("within").to_numpy()
            row, to = [np.arange(b.num_rows)], [b.column("cell").to_numpy()]
            for dim in np.unique(dims).tolist():
                if dim not in shared.value:
                    continue
                cells, low, high = shared.value[dim]
                own = np.flatnonzero(dims == dim)
                spots = matrix(b.column("v").take(pa.array(own))) @ axes(dim)
                for i, spot in zip(own.tolist(), spots):
                    half = HALF_WIDTH * within[i]
                    meets = ((spot - half <= high) & (spot + half >= low)).sum(1) >= THRESHOLD * DIRECTIONS
                    found = cells[meets & (cells != to[0][i])]
                    row.append(np.full(len(found), i))
                    to.append(found)
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("vec_id", "v", "dim", "within")] + [b.column("cell").take(at), b.column("sub").take(at), pa.array(np.concatenate(to).astype(np.int32))], ["vec_id", "v", "dim", "within", "home", "home_sub", "cell"])

    return queries.mapInArrow(run, "vec_id long, v array<double>, dim int, within double, home int, home_sub int, cell int")


def search(df: DataFrame, asks: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", where: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row where `asks` (over vec_id) holds."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    rows = pick(df, vec_id=vec_id, v=embedding).where(F.col("vec_id").isNotNull() & is_sound(F.col("v")))
    rows = rows.select("vec_id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("dim"))
    cells = max(1, min(CELLS, rows.count() // LEAST))
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(cells).collect():  # CELLS rows at most
        pivots.setdefault(r["dim"], []).append(r["v"])
    located = _celled(rows, {dim: np.array(x) for dim, x in pivots.items()})
    sizes = located.groupBy("dim", "cell").agg(F.ceil(F.count("*") / MOST).cast("int").alias("subs"))
    placed = located.join(cut(sizes, where, "sizes"), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).drop("subs")
    placed = cut(placed, where, "placed")
    sizes = spark.read.schema(sizes.schema).parquet(f"{where}/sizes")
    shards = sizes.agg(F.sum("subs")).first()[0] or 1
    columns = ("dim", "cell", "sub", "asks", "vec_id", "v", "within")

    def searched(queries: DataFrame, name: str, ends: bool = False) -> DataFrame:
        held = placed.withColumns({"asks": F.lit(False), "within": F.lit(None).cast("double")})
        both = held.select(*columns).unionByName(queries.withColumn("asks", F.lit(True)).select(*columns))
        # More tasks than shards, so that few tasks get two of them.
        both = both.repartition(min(4 * shards, 20_000), "dim", "cell", "sub").sortWithinPartitions("dim", "cell", "sub", "asks")
        return cut(both.mapInArrow(partial(_search, k=k, ends=ends), FOUND), where, name)

    queries = placed.where(asks)
    home = searched(queries.withColumn("within", F.lit(None).cast("double")), "home", ends=True)
    near = home.where("query_id is not null").select("query_id", "vec_id", "score")
    reach: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    ends = home.where("low is not null and cell >= 0").select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x")).groupBy("dim", "cell", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    ends = ends.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("x"))
    for r in ends.toLocalIterator():  # CELLS rows at most
        reach[r["dim"], r["cell"]] = tuple(np.array([x[c] for x in r["x"]]) for c in ("low", "high"))
    if shards > 1:
        bound = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("within"))
        asked = queries.join(bound, "vec_id", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
        sent = _routed(asked, reach).join(sizes, ["dim", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        sent = sent.where("cell <> home or sub <> home_sub")
        near = near.union(searched(sent, "away").where("query_id is not null").select("query_id", "vec_id", "score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(df: DataFrame, found: DataFrame, ids: list[int], vec_id: str = "vec_id", embedding: str = "embedding") -> float:
    """The share of the true nearest that `found` has, for a few queries, by brute force over all rows."""
    k = found.agg(F.max("rank")).first()[0] or 0
    own = found.where(F.col("query_id").isin(ids)).collect()
    rows = pick(df, vec_id=vec_id, v=embedding).where(is_sound(F.col("v")))
    hits = total = 0
    for q in rows.where(F.col("vec_id").isin(ids)).collect():
        far = F.sqrt(F.aggregate(F.zip_with("v", F.lit(list(q["v"])), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
        true = {r["vec_id"] for r in rows.where((F.col("vec_id") != q["vec_id"]) & (F.size("v") == len(q["v"]))).orderBy(far, "vec_id").limit(k).collect()}
        hits += len(true & {r["vec_id"] for r in own if r["query_id"] == q["vec_id"]})
        total += len(true)
    return hits / total if total else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
