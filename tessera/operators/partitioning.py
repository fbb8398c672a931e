"""Rows dealt out by key or by partition number, and reports of what each partition holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.arithmetic import power_residue


def by_power(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows in partition key ** key % partitions, by the number itself."""
    return rows.repartitionById(partitions, power_residue(F.col(key), F.col(key), partitions).cast("int"))


def by_hash(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    return rows.repartition(partitions, key)


def report(dealt: DataFrame, partitions: int) -> DataFrame:
    """(n_partitions, pid, n_items) for every partition, empty ones included."""
    held = dealt.groupBy(F.spark_partition_id().alias("pid")).agg(F.count("*").alias("n_items"))
    every = dealt.sparkSession.range(partitions).select(F.col("id").cast("int").alias("pid"))
    return every.join(held, "pid", "left").select(F.lit(partitions).alias("n_partitions"), "pid", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def totals(reported: DataFrame) -> DataFrame:
    """One row: the number of partitions and of items."""
    return reported.groupBy("n_partitions").agg(F.sum("n_items").alias("n_items"))
