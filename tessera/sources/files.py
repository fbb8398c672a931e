"""Readers and writers of review data files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEWS = "review_id string, user_id string, business_id string, stars double, date timestamp_ntz, text string"
BUSINESSES = "business_id string, state string"
RATINGS = "user_id int, business_id int, rate int, year int"
BASKETS = "user_id string, business_id string, rate string, year string"
RATING_MODEL = "b1 string, b2 string, sim double, num_co_rated int"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, by the schema; malformed lines fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated values whose header names the columns, without quoting; all strings unless a schema names the types.

    The schema's columns are matched by name, in whatever order the header has them.
    """
    reader = spark.read.option("header", True).option("quote", "").option("mode", "FAILFAST")
    rows = reader.csv(path)
    if schema is None:
        return rows
    wanted = spark.createDataFrame([], schema).schema
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted if f.name in rows.columns])


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """The words of a text file between white space: (word)."""
    from tessera.functions.text import split_words

    return spark.read.text(path).select(F.explode(split_words(F.col("value"))).alias("word")).distinct()


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_json_document(values: DataFrame, path: str) -> None:
    """One JSON document of a table's only row, an object with a member for each column, nested ones included."""
    values.select(F.to_json(F.struct(*values.columns), {"ignoreNullFields": "false"})).coalesce(1).write.text(path)


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The row of a document that may span lines; anything malformed fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_stop_words(words: tuple[str, ...], spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(" ".join(words),)], "value string").write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header of column names."""
    rows.write.option("header", True).csv(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles (kind, id, words) as lines {"business": [id, [words]]} or {"user": [id, [words]]}."""
    pair = F.concat(F.lit("["), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(","), F.to_json("words"), F.lit("]"))
    profiles.select(F.concat(F.lit('{"'), F.col("kind"), F.lit('":'), pair, F.lit("}"))).write.text(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles as `write_profiles` leaves them: (kind, id, words)."""
    lines = spark.read.schema("business array<string>, user array<string>").option("mode", "FAILFAST").json(path)
    own = F.coalesce("business", "user")
    # a nested list in a list of strings is read as its JSON text
    return lines.select(F.when(F.col("business").isNotNull(), "business").otherwise("user").alias("kind"), own[0].alias("id"), F.from_json(own[1], "array<string>").alias("words"))
