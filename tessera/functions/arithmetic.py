"""Integer and floating-point expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def power_residue(base: Column, exponent: Column, modulus: int) -> Column:
    """base ** exponent % modulus without large numbers; exponents from 1."""
    start = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(1), exponent.cast("int")), start, lambda so_far, _: so_far * (base.cast("long") % modulus) % modulus)


def pearson(n: Column, x: Column, y: Column, xy: Column, xx: Column, yy: Column) -> Column:
    """Pearson's coefficient from sums; 0 where either side has no variance."""
    var_x, var_y = n * xx - x * x, n * yy - y * y
    return F.when(var_x * var_y <= 0, 0.0).otherwise((n * xy - x * y) / F.sqrt(F.when(var_x * var_y <= 0, 1.0).otherwise(var_x * var_y)))


def jaccard(shared: Column, left: Column, right: Column) -> Column:
    """Shared elements over all elements; 0 for two empty sets."""
    union = left + right - shared
    return F.when(union == 0, 0.0).otherwise(shared / F.when(union == 0, 1).otherwise(union))
