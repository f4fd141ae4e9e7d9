"""Window sums of any size by running sums: along each line, then down each column of what that gives.

Scan lines (page_id, y, h, w, v) become pixels with mirrored borders; a window's sum is the difference of two running
sums in each direction, so its cost does not depend on the window, and two shuffles are all.  Sums are whole numbers.
A window frame holds one line or one column of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The window, the weight of the deviation, and half the range of grays.
WINDOW, WEIGHT, RANGE = 25, 0.2, 127.5


def mirrored(i: Column, n: Column) -> Column:
    """The place in 0 to n - 1 that a place beyond the border shows, the outermost pixel not repeated."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    k = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.when(k < n, k).otherwise(period - k))


def bordered(lines: DataFrame, reach: int) -> DataFrame:
    """page_id, y, x, v (long) of all pixels, and of the mirrored ones up to `reach` beyond the border."""
    rows = lines.where(F.size("v") > 0)
    across = F.transform(F.sequence(F.lit(-reach), F.col("w") - 1 + reach), lambda i: F.get("v", mirrored(i, F.col("w")).cast("int")).cast("long"))
    down = F.filter(F.sequence(F.lit(-reach), F.col("h") - 1 + reach), lambda i: mirrored(i, F.col("h")) == F.col("y"))
    rows = rows.select("page_id", "h", "w", F.explode(down).alias("y"), across.alias("v"))
    return rows.select("page_id", "h", "w", "y", F.posexplode("v").alias("x", "v")).withColumn("x", F.col("x") - reach)


def window_sums(pixels: DataFrame, reach: int, **values: Column) -> DataFrame:
    """The pixels with each value replaced by its sum over the square of `reach` pixels in each direction.

    Right where the square lies within the pixels; others are null.
    """

    def along(rows: DataFrame, across: str, by: str) -> DataFrame:
        line = Window.partitionBy("page_id", across).orderBy(by)
        rows = rows.withColumns({c: F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, 0)) for c in values})
        before = {c: F.when(F.row_number().over(line) == reach + 1, F.lit(0)).otherwise(F.lag(c, reach + 1).over(line)) for c in values}
        return rows.withColumns({c: F.lead(c, reach).over(line) - before[c] for c in values})

    rows = pixels.withColumns(values)
    return along(along(rows, "y", "x"), "x", "y")


def black_white(lines: DataFrame, window: int = WINDOW, weight: float = WEIGHT, half: float = RANGE) -> DataFrame:
    """page_id, y, x, white of the pixels of gray pages: brighter than a threshold from mean and deviation of their window."""
    reach, n = window // 2, window * window
    pixels = bordered(lines, reach).withColumn("gray", F.col("v"))
    sums = window_sums(pixels, reach, s=F.col("v"), q=F.col("v") * F.col("v")).where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("w")) & (F.col("y") < F.col("h")))
    mean = F.col("s") / n
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - mean * mean))
    return sums.select("page_id", "y", "x", (F.col("gray") > mean * (1 + weight * (deviation / half - 1))).alias("white"))
