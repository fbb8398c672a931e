"""What the operators share: reading tables, the scratch folder, cutting lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import new_folder, scratch, spread  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows, over all cores where its file has few row groups."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The rows travel as one struct, so that the plan forgets how they were dealt out: a later join
    then shuffles both sides, and adaptive execution can split a hot key there.
    """
    scratch(df.sparkSession)
    return df.select(F.struct(*df.columns).alias("_row")).checkpoint(eager=True).select("_row.*")


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The same rows written to a folder and read again; for tables with whole texts."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
