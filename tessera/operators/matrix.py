"""Exact integer matrix products over coordinates (i, j, v)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(spark: SparkSession, rows: list[list[int]]) -> DataFrame:
    """Cells of a dense matrix that the driver holds."""
    return spark.createDataFrame([(i, j, int(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "i int, j int, v long")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def random_rows(seed: int, rows: int, columns: int, low: int = 1, high: int = 99) -> list[list[int]]:
    """A dense matrix of whole numbers from `low` up to, but not, `high`, by the seed."""
    draw = random.Random(seed)
    return [[draw.randrange(low, high) for _ in range(columns)] for _ in range(rows)]


def mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, a, b): cells that differ; one that a side lacks is null there."""
    a, b = left.select("i", "j", F.col("v").alias("a")), right.select("i", "j", F.col("v").alias("b"))
    return a.join(b, ["i", "j"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, k, v): joined on the inner index alone; partial sums before the shuffle; absent cells are zero and stay absent."""
    a = left.select("i", F.col("j").alias("inner"), F.col("v").alias("a"))
    b = right.select(F.col("i").alias("inner"), F.col("j").alias("k"), F.col("v").alias("b"))
    return a.join(b, "inner").groupBy("i", "k").agg(F.sum(F.col("a") * F.col("b")).alias("v"))
