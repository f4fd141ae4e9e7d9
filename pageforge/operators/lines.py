"""Straight lines of pages by voting: the turn of a page as an aggregate over its edge pixels.

Every edge pixel (page_id, y, x) votes for one line in each of 180 directions.  Only edge pixels are shuffled, by page
and into partitions of about `EDGES` of them: votes are counted, and the lines that stand out from their neighbours found
by window frames, where the page's edges are.  A page's votes are bounded by directions times distances.  Distances are rounded from whole-number sines and cosines, so that they are the
same wherever they are worked out.
"""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A direction for each degree; votes that a line must exceed, lines looked at, degrees that count as level.
DIRECTIONS, VOTES, MOST, LEVEL = 180, 200, 100, 0.5
#: What sines and cosines are multiplied by; edge pixels of a partition, of which each votes in every direction.
UNIT, EDGES = 1 << 16, 20_000


def votes(edges: DataFrame) -> DataFrame:
    """page_id, theta (degrees of the normal), rho (its length in pixels), n: the votes of edge pixels."""
    c, s = (F.array(*[F.lit(round(f(pi * t / 180) * UNIT)) for t in range(DIRECTIONS)]) for f in (cos, sin))
    cast = edges.select("page_id", "y", "x", F.explode(F.sequence(F.lit(0), F.lit(DIRECTIONS - 1))).alias("theta"))
    rho = F.floor((F.col("x") * F.get(c, F.col("theta")) + F.col("y") * F.get(s, F.col("theta")) + UNIT // 2) / UNIT)
    return cast.select("page_id", "theta", rho.alias("rho")).groupBy("page_id", "theta", "rho").agg(F.count("*").alias("n"))


def lines(edges: DataFrame, least: int = VOTES, most: int = MOST) -> DataFrame:
    """page_id, theta, rho, n: the `most` lines with the most votes above `least` that no neighbour outdoes."""

    def beside(by: str, along: str, step: int):
        frame = Window.partitionBy("page_id", by).orderBy(along).rangeBetween(step, step)
        return F.coalesce(F.max("n").over(frame), F.lit(0))

    n = F.col("n")
    spread = edges.select("page_id", "y", "x").repartition(edges.count() // EDGES + 1, "page_id")
    found = votes(spread).where(n > least)  # a neighbour with fewer votes outdoes none of these
    found = found.withColumns({"nearer": beside("theta", "rho", -1), "farther": beside("theta", "rho", 1)})
    found = found.withColumns({"before": beside("rho", "theta", -1), "after": beside("rho", "theta", 1)})
    found = found.where((n > F.col("nearer")) & (n >= F.col("farther")) & (n > F.col("before")) & (n >= F.col("after")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "theta", "rho"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("page_id", "theta", "rho", "n")


def turns(lines: DataFrame) -> DataFrame:
    """page_id, turn: the median degrees from the horizontal of each page's near-horizontal lines, below half a degree 0."""
    degrees = lines.select("page_id", (F.col("theta") - 90).alias("d")).where((F.col("d") > -45) & (F.col("d") < 45))
    turn = degrees.groupBy("page_id").agg(F.percentile("d", 0.5).alias("turn"))
    return turn.withColumn("turn", F.when(F.abs("turn") < LEVEL, 0.0).otherwise(F.col("turn")))
