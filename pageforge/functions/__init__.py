"""Column functions: rounding, colour, conditional lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def nearest(x: Column) -> Column:
    """To the nearest integer, halves up, as 8-bit image arithmetic does."""
    return F.floor(x + 0.5)


def flags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def gray(b: Column, g: Column, r: Column) -> Column:
    return nearest(0.114 * b + 0.587 * g + 0.299 * r)


def python_strip(text: Column) -> Column:
    """Without white space at either end, white space in the Unicode sense."""
    space = "[\\\\s\\\\x{1c}-\\\\x{1f}\\\\x{85}\\\\x{a0}\\\\x{1680}\\\\x{2000}-\\\\x{200a}\\\\x{2028}\\\\x{2029}\\\\x{202f}\\\\x{205f}\\\\x{3000}]".replace("\\\\", "\\")
    return F.regexp_replace(text, f"^{space}+|{space}+$", "")
