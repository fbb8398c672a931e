"""Review analytics over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, edge_tokens_sql
from tessera.operators import partitioning, reviews
from tessera.session import new_folder, timed
from tessera.sources import files, tables
from tessera.sources.tables import BUSINESSES_SQL, RATINGS_SQL, REVIEWS_SQL

YEAR = 1998  #: the dates run from 1995 to 2001
YEAR_ROWS = 2000
STATE = "NATION_7"
PARTITIONS = 10


def _orders(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"))


def _json_states(spark, sf_dir):
    """Counts of all states written as JSON lines and read again."""
    path = new_folder(spark, "states")
    files.write_json_lines(reviews.state_counts(tables.ratings(spark, sf_dir), tables.businesses(spark, sf_dir)), path)
    return files.read_json_lines(spark, path, "state string, n long")


def _json_report(spark, sf_dir):
    """Mean stars and the top months as one JSON document, read again."""
    path = new_folder(spark, "report")
    rated = tables.ratings(spark, sf_dir)
    mean = reviews.mean(rated, "stars", "avg_stars").select(F.round("avg_stars", 6).alias("avg_stars"))
    months = reviews.top_months(rated).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "month"))), lambda m: F.concat(m["month"], F.lit(":"), (-m["n"]).cast("string"))).alias("months"))  # five rows
    files.write_json_document(mean.join(months), path)  # one row each
    return files.read_json_document(spark, path, "avg_stars double, months array<string>").select("avg_stars", F.array_join("months", ",").alias("months"))


def _runtime(spark, sf_dir):
    """The run time of a job as a row; that it was measured is what can be compared."""
    n, seconds = timed(lambda: tables.ratings(spark, sf_dir).count())
    return spark.createDataFrame([(n, seconds > 0)], "n long, measured boolean")


def _without_stop_file(spark, sf_dir):
    """Top words without the stop-words of a file."""
    path = new_folder(spark, "stop-words")
    files.write_stop_words(STOP_WORDS, spark, path)
    return reviews.top_words_without(tables.reviews(spark, sf_dir), YEAR, files.read_stop_words(spark, path))


def _csv_pairs(spark, sf_dir):
    """The pairs of one state written as CSV and read again, counted by user."""
    path = new_folder(spark, "pairs")
    files.write_csv(reviews.pairs_in_state(tables.ratings(spark, sf_dir), tables.businesses(spark, sf_dir), STATE), path)
    return files.read_csv(spark, path, files.RATINGS).groupBy("user_id").agg(F.count("*").alias("n"))


def _years(spark, sf_dir):
    return reviews.years_over(_orders(spark, sf_dir), YEAR_ROWS)


QUERIES = {
    "top_states": lambda s, d: reviews.top_states(tables.ratings(s, d), tables.businesses(s, d)),
    "avg_rating": lambda s, d: reviews.mean(tables.ratings(s, d), "stars", "avg_stars").select(F.round("avg_stars", 6).alias("avg_stars")),
    "reviews_not_in_year": lambda s, d: reviews.count_where(tables.ratings(s, d), F.year("date") != YEAR, "n"),
    "top_months": lambda s, d: reviews.top_months(tables.ratings(s, d)),
    "years_over_threshold": _years,
    "words_per_month": lambda s, d: reviews.words_per_month(tables.reviews(s, d), YEAR),
    "avg_words_per_review": lambda s, d: reviews.words_per_review(tables.reviews(s, d), YEAR).select(F.round("avg_words", 6).alias("avg_words")),
    "top_words": lambda s, d: reviews.top_words(tables.reviews(s, d), YEAR),
    "partition_report_power": lambda s, d: partitioning.report(partitioning.by_power(_years(s, d), "year", PARTITIONS), PARTITIONS),
    "partition_report_hash": lambda s, d: partitioning.totals(partitioning.report(partitioning.by_hash(_years(s, d), "year", PARTITIONS), PARTITIONS)),
    "region_basket_pairs": lambda s, d: reviews.pairs_in_state(tables.ratings(s, d), tables.businesses(s, d), STATE),
    "top_words_stop_file": _without_stop_file,
    "json_round_trip": _json_states,
    "json_document_round_trip": _json_report,
    "runtime_metric": _runtime,
    "csv_round_trip": _csv_pairs,
}

_CLEAN = f"SELECT strftime(date, '%m') AS month, {edge_tokens_sql('text')} AS words FROM ({REVIEWS_SQL}) WHERE year(date) >= {YEAR}"
_YEARS = f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > {YEAR_ROWS}"
_RESIDUE = f"CAST(list_reduce(list_transform(range(year), lambda i: CAST(year AS BIGINT)), lambda a, b: (a * b) % {PARTITIONS}) % {PARTITIONS} AS INTEGER)"
_STATE_COUNTS = f"SELECT state, count(*) AS n FROM ({RATINGS_SQL}) JOIN ({BUSINESSES_SQL}) USING (business_id) GROUP BY state"
_TOP_WORDS = f"SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM ({_CLEAN})) WHERE length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT 10"

ORACLES = {
    "top_states": f"{_STATE_COUNTS} ORDER BY n DESC, state LIMIT 5",
    "avg_rating": f"SELECT round(avg(stars), 6) AS avg_stars FROM ({RATINGS_SQL})",
    "reviews_not_in_year": f"SELECT count(*) FILTER (year(date) <> {YEAR}) AS n FROM ({RATINGS_SQL})",
    "top_months": f"SELECT strftime(date, '%m') AS month, count(*) AS n FROM ({RATINGS_SQL}) GROUP BY 1 ORDER BY n DESC, month LIMIT 5",
    "years_over_threshold": _YEARS,
    "words_per_month": f"SELECT month, CAST(sum(len(words)) AS BIGINT) AS n_words FROM ({_CLEAN}) GROUP BY month",
    "avg_words_per_review": f"SELECT round(avg(len(words)), 6) AS avg_words FROM ({_CLEAN})",
    "top_words": _TOP_WORDS,
    "top_words_stop_file": _TOP_WORDS,
    "partition_report_power": f"SELECT {PARTITIONS} AS n_partitions, CAST(pid AS INTEGER) AS pid, count(held) AS n_items FROM range({PARTITIONS}) every(pid) LEFT JOIN (SELECT {_RESIDUE} AS held FROM ({_YEARS})) ON held = pid GROUP BY pid",
    "partition_report_hash": f"SELECT {PARTITIONS} AS n_partitions, count(*) AS n_items FROM ({_YEARS})",
    "region_basket_pairs": f"SELECT user_id, business_id FROM ({RATINGS_SQL}) WHERE business_id IN (SELECT business_id FROM ({BUSINESSES_SQL}) WHERE state = '{STATE}')",
    "json_round_trip": _STATE_COUNTS,
    "json_document_round_trip": f"SELECT (SELECT round(avg(stars), 6) FROM ({RATINGS_SQL})) AS avg_stars, (SELECT string_agg(month || ':' || n, ',' ORDER BY n DESC, month) FROM (SELECT strftime(date, '%m') AS month, count(*) AS n FROM ({RATINGS_SQL}) GROUP BY 1 ORDER BY n DESC, month LIMIT 5)) AS months",
    "runtime_metric": f"SELECT count(*) AS n, true AS measured FROM ({RATINGS_SQL})",
    "csv_round_trip": f"SELECT CAST(user_id AS INTEGER) AS user_id, count(*) AS n FROM ({RATINGS_SQL}) WHERE business_id IN (SELECT business_id FROM ({BUSINESSES_SQL}) WHERE state = '{STATE}') GROUP BY user_id",
}
