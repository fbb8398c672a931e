"""The test tables seen as ratings, reviews, businesses and baskets; all rows that the joins give.

Every adapter has the SQL that gives the same rows, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, business_id, stars, date): line items with their orders; 1 to 5 stars by quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stars = 1 + F.floor((F.col("l_quantity").cast("int") - 1) / 10)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("business_id"), stars.cast("double").alias("stars"), F.col("o_orderdate").alias("date"))


RATINGS_SQL = "SELECT o_custkey AS user_id, l_suppkey AS business_id, CAST(1 + (CAST(l_quantity AS INTEGER) - 1) // 10 AS DOUBLE) AS stars, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, user_id, business_id, date, text): documents with the orders of their ids, those without such an order left out; a source is a business."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = dealt(docs, docs.count() * 50.0, "doc_id")  # a text takes the bytes of many rows of numbers
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return docs.join(orders, F.col("doc_id") == F.col("o_orderkey")).select(F.col("doc_id").alias("review_id"), F.col("o_custkey").alias("user_id"), F.col("source").alias("business_id"), F.col("o_orderdate").alias("date"), "text")


REVIEWS_SQL = "SELECT doc_id AS review_id, o_custkey AS user_id, source AS business_id, o_orderdate AS date, text FROM documents JOIN orders ON doc_id = o_orderkey"


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, state): suppliers with the names of their nations."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), F.col("n_name").alias("state"))


BUSINESSES_SQL = "SELECT s_suppkey AS business_id, n_name AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): the suppliers of each order, once each."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"))
    return dealt(lines, lines.count(), "basket").distinct()


BASKETS_SQL = "SELECT DISTINCT l_orderkey AS basket, l_suppkey AS item FROM lineitem"


def url_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item): the distinct lower-case alphanumeric parts of each page's URL."""
    parts = F.filter(F.split(F.lower(F.coalesce("url", F.lit(""))), "[^a-z0-9]+"), lambda p: p != "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), F.explode(F.array_distinct(parts)).alias("item")).distinct()


URL_SETS_SQL = "SELECT DISTINCT user_id, item FROM (SELECT page_id AS user_id, unnest(regexp_split_to_array(lower(coalesce(url, '')), '[^a-z0-9]+')) AS item FROM pages) WHERE item <> ''"
