"""Best-fit packing by a configuration linear program (operator 7).

The histogram of piece lengths (at most `capacity` rows, so it may go to the driver) defines a covering program with
one variable for each way to fill a sequence.  Prices of the lengths start as their sizes; at each pricing a knapsack
dynamic program finds what the best filling is worth, fillings near that worth cover what they can of the demand, and
by multiplicative weights the prices of lengths that they leave open go up.  Every pricing gives a lower bound, every
cover a solution; the best of each are kept until they are within `GAP`, or prices have settled.  Rounded down, the
fillings become a plan; where rounding leaves lengths over, the fillings go on with subset sums of what is left.  The plan says for each length which of its pieces, by rank, go where;
its size depends on `capacity` alone.  Ranks come from counts by length and bucket, and rows are dealt into buckets by a
number that each got when the pieces were written, so neither a length nor an id that a third of all pieces share is
ranked in one task.

Null and empty texts are documents of one id, the end id.  Repeated rows are packed separately.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageforge.llm.common import cut, pick, shared_dir, shuffle_parts, slices, table
from pageforge.llm.wordcodes import library_codes

CAPACITY, END_ID = 4096, 1
#: Pricings of the linear program at most, the share of the bound that its solution may lie above it, the factor's logarithm
#: by which prices rise at first, classes of lengths (of equal volume) that rise together, and what counts as nothing.
ROUNDS, GAP, RATE, CLASSES, EMPTY = 120, 5e-3, 0.5, 64, 1e-9


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    codes = library_codes(path)
    for batch in batches:
        for part in slices(batch, "text"):
            ids, off = codes(part.column("text"))
            size = np.diff(off) + 1
            flat = np.full(int(size.sum()), end_id, "<u4")
            ends = np.cumsum(size)
            flat[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size - 1)] = ids
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = ends[row] - size[row] + start
            crc = [zlib.crc32(flat[a : a + n].data) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def pieces(df: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most `capacity` ids."""
    run = partial(_pieces, path=path, end_id=end_id, capacity=capacity)
    return pick(df, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(prices: np.ndarray) -> np.ndarray:
    """For each room from 0 on the greatest value of lengths that fit; prices: by length, from 0 to the capacity."""
    best = np.zeros(len(prices))
    for room in range(1, len(prices)):
        best[room] = max(best[room - 1], float((prices[1 : room + 1] + best[:room][::-1]).max()))
    return best


def cover(prices: np.ndarray, best: np.ndarray, want: np.ndarray, slack: float) -> tuple[Counter, np.ndarray]:
    """Fillings whose worth is within `slack` (a share) of the best one's, and the demand that they leave open.

    A filling starts with the longest length that still has some; others follow, the longest one first of those that
    keep the filling within the slack.  It is taken until one of its lengths is used up.  Nothing is covered twice.
    """
    left, out, capacity = want.copy(), Counter(), len(want) - 1
    for n in np.flatnonzero(want)[::-1].tolist():
        while left[n] > EMPTY:
            filling, room, spare = [n], capacity - n, slack * best[capacity] - (best[capacity] - prices[n] - best[capacity - n])
            while room and spare >= 0:
                lost = best[room] - prices[1 : room + 1] - best[:room][::-1]  # by a length that goes in next
                fits = np.flatnonzero((lost <= spare) & (left[1 : room + 1] > EMPTY))
                if not len(fits):
                    spare -= best[room]  # the rest stays empty
                    break
                m = int(fits[-1])
                spare -= max(0.0, float(lost[m]))
                filling.append(m + 1)
                room -= m + 1
            if spare < 0:
                break
            counts = Counter(filling)
            times = min(left[m] / k for m, k in counts.items())
            out[tuple(filling)] += times
            for m, k in counts.items():
                left[m] -= k * times
    return out, np.where(left > EMPTY, left, 0)


def solve(demand: dict[int, int], capacity: int, rounds: int = ROUNDS, gap: float = GAP, rate: float = RATE) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional fillings that cover the demand, and a lower bound on what any solution needs.

    At any prices the demand's worth over that of the best filling is a bound.  A cover by fillings that are all worth
    nearly as much as the best one needs hardly more sequences than the bound says, so when near-best fillings leave
    nothing open, the program is solved.  Until then the prices of what is left open rise, by classes of lengths; where
    the bound stops rising, steps are halved and start again from the best prices.  What near-best fillings leave open is
    covered by the best ones that its lengths have.
    """
    lengths, size, want = np.array(sorted(demand)), np.arange(capacity + 1.0), np.zeros(capacity + 1)
    want[lengths] = [demand[n] for n in lengths.tolist()]
    volume = np.cumsum(want * size)[lengths]
    kind = np.unique((volume / volume[-1] * CLASSES).astype(int), return_inverse=True)[1]
    count = np.bincount(kind, want[lengths])
    middle = np.bincount(kind, want[lengths] * lengths) / count
    weight = held = np.zeros(len(count))
    bound, least, stalled, slack, found = 0.0, float("inf"), 0, 1e-3, Counter()
    for _ in range(rounds):
        prices = np.zeros(capacity + 1)
        prices[lengths] = np.maximum.accumulate(lengths * np.exp(np.interp(lengths, middle, weight)))
        best = knapsack(prices)
        prices, best = prices / best[capacity], best / best[capacity]
        worth = float(want @ prices)
        stalled = 0 if worth > bound * (1 + 1e-4) else stalled + 1
        if worth >= bound:
            bound, held = worth, weight
        near, left = cover(prices, best, want, slack)
        rest, _ = cover(prices, best, left, 1.0)
        if (total := near.total() + rest.total()) < least:
            least, found = total, near + rest
        if least <= bound * (1 + gap) or rate < gap / 4:
            break
        if stalled >= 4:
            rate, stalled, weight = rate / 2, 0, held
        slack = max(gap / 2, min(rate / 2, 0.05))
        open_share = np.bincount(kind, left[lengths]) / count
        weight = weight + rate * open_share / max(open_share.max(), EMPTY)
    return dict(found), bound


def completed(core: Counter, lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """A filling that holds the core, and lengths that are left, larger ones first, filling the rest as far as sums of them can."""
    room = capacity - sum(n * k for n, k in core.items())
    full, mask = 1 << room, (1 << room + 1) - 1
    reach, steps = 1, []
    for n in lengths[bisect_left(lengths, -room, key=lambda n: -n) :]:
        if reach & full:
            break
        m, k = left[n] - core[n], 1
        while k <= m and k * n <= room:
            wider = (reach | reach << k * n) & mask
            if wider != reach:
                steps.append((n, k, reach))
                reach = wider
            m, k = m - k, 2 * k
    at = reach.bit_length() - 1
    out = Counter(core)
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            out[n] += k
            at -= k * n
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, facts: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many sequences get each; together they take every piece once.

    The fractional solution is rounded down, then each filling is taken once more in order of what rounding lost: with
    what is left of its lengths, and its room completed by others that are left.  What no filling covers is filled in the
    same way, longest piece first.  `facts` gets the numbers of
    sequences of each kind, the fractional solution's and the bound.
    """
    left = {n: c for n, c in histogram.items() if n < capacity}
    plan = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    made = {"full": histogram.get(capacity, 0), "fractional": 0.0, "bound": 0.0, "rounded": 0, "completed": 0, "rest": 0}
    order = sorted(left, reverse=True)

    def take(found: dict[int, int], most: int, kind: str) -> int:
        share = min(most, *(left[n] // k for n, k in found.items()))
        if share:
            plan.append((found, share))
            made[kind] += share
            for n, k in found.items():
                left[n] -= k * share
                if not left[n]:
                    del order[bisect_left(order, -n, key=lambda n: -n)]
        return share

    if left:
        solved, made["bound"] = solve(left, capacity)
        made["fractional"] = float(sum(solved.values()))
        whole = [(f, int(x)) for f, x in solved.items() if x >= 1]
        parts = sorted((f for f, x in solved.items() if x > int(x)), key=lambda f: int(solved[f]) - solved[f])
        for filling, times in whole:
            times -= take(Counter(filling), times, "rounded")
        for filling in parts:
            if left[filling[0]]:  # a filling whose longest piece is gone has no use
                core = Counter()
                for n in filling:
                    core[n] += left[n] > core[n]
                found = completed(+core, order, left, capacity)
                take(found, 1, "rounded" if found == Counter(filling) else "completed")
        while order:
            found = completed(Counter(order[:1]), order, left, capacity)
            take(found, left[order[0]], "rest")
    if facts is not None:
        facts.update(made)
    return plan


def placing(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of first rank, first sequence, pieces of this length in each sequence, offset of the first."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        offset = 0
        for n in sorted(filling, reverse=True):
            k = filling[n]
            rows.setdefault(n, []).append((taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def _place(frames: Iterator[pd.DataFrame], plan) -> Iterator[pd.DataFrame]:
    for f in frames:
        length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
        sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            rows = plan.value[int(n)]
            r = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
            past = rank[own] - r[:, 0]
            sequence[own] = r[:, 1] + past // r[:, 2]
            offset[own] = r[:, 3] + past % r[:, 2] * n
        yield f.drop(columns="rank").assign(sequence_id=sequence, offset=offset)


def pack(df: DataFrame, capacity: int = CAPACITY, where: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with `doc_id, piece, start, length, ids_crc32`."""
    spark = df.sparkSession
    df = cut(df.withColumn("number", F.monotonically_increasing_id()), where or shared_dir(spark), "pieces")  # encoded and numbered once
    histogram = {r["length"]: r["n"] for r in df.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(placing(configurations(histogram, capacity)))
    buckets = 4 * shuffle_parts(spark)
    df = df.withColumn("bucket", F.pmod(F.xxhash64("number"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("number")
    ranked = df.withColumn("nth", F.row_number().over(within)).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(partial(_place, plan=plan), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(pieces(table(spark, sf_dir, "documents"), path("word_bpe_49k.json")))
