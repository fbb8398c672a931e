"""Session defaults, the shared folder, a reliable cut of lineage, and run times."""

from __future__ import annotations

import math
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "tessera", **options: str) -> SparkSession:
    """A session with the engine's defaults; `options` go over them."""
    return SparkSession.builder.appName(name).config(map=DEFAULTS | options).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only on a local master, where all run on one machine, a folder of our own where that is unset.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{scratch(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition where their number grows with the input, so that the memory of a task does not.
PART = 500_000


def dealt(rows: DataFrame, n: float, *keys: str) -> DataFrame:
    """The rows by the keys in partitions of about PART of `n` rows, or fewer rows in up to as many partitions as the session names.

    Adaptive execution joins small partitions up to a number of bytes and of cores, whatever rows
    they become in memory; a number that is given stays.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, math.ceil(n / PART), min(usual, math.ceil(n * 16 / PART))), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table of the shared folder, which takes a part of a checkpoint's bytes."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores where few partitions of the input hold any, as in a file of one row group; else as they are.

    Only partition numbers are read to see that. What is shuffled then is no more than a quarter of
    the cores read in one round of tasks, so a large table never is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(cores) if 0 < held <= cores // 4 else rows


def timed(run: Callable[[], object]) -> tuple[object, float]:
    """What a job returns, and the seconds it took."""
    began = time.monotonic()
    return run(), time.monotonic() - began
