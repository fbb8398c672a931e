"""Means, counts, top lists and word counts of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, edge_tokens, month_name


def mean(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the mean of a column, nulls left out; null over no rows."""
    return rows.agg(F.avg(column).alias(name))


def count_where(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """One row: how many rows meet the condition."""
    return rows.agg(F.count_if(condition).alias(name))


def key_counts(rows: DataFrame, key: Column, name: str, count: str = "n") -> DataFrame:
    """All keys and their counts."""
    return rows.groupBy(key.alias(name)).agg(F.count("*").alias(count))


def top_counts(rows: DataFrame, key: Column, name: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent keys and their counts; of equal counts the smaller key first."""
    return key_counts(rows, key, name, count).orderBy(F.desc(count), name).limit(n)


def top_months(reviews: DataFrame, n: int = 5) -> DataFrame:
    return top_counts(reviews, month_name(F.col("date")), "month", n)


def top_states(reviews: DataFrame, businesses: DataFrame, n: int = 5) -> DataFrame:
    """States by number of reviews of their businesses; duplicate keys multiply, as in any inner join."""
    return state_counts(reviews, businesses).orderBy(F.desc("n"), "state").limit(n)


def state_counts(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """(state, n): every state with the number of reviews of its businesses."""
    return key_counts(reviews.select("business_id").join(businesses, "business_id"), F.col("state"), "state")


def years_over(reviews: DataFrame, least: int) -> DataFrame:
    """Years with more than `least` reviews."""
    return reviews.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n")).filter(F.col("n") > least)


def cleaned(reviews: DataFrame, from_year: int, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(month, words) of reviews from a year on."""
    return reviews.filter(F.year("date") >= from_year).select(month_name(F.col("date")).alias("month"), edge_tokens(F.col("text"), stop_words).alias("words"))


def words_per_month(reviews: DataFrame, from_year: int, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Cleaned words of each month; months whose reviews have none count 0."""
    return cleaned(reviews, from_year, stop_words).groupBy("month").agg(F.sum(F.size("words")).alias("n_words"))


def words_per_review(reviews: DataFrame, from_year: int, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """One row: the mean number of cleaned words."""
    return cleaned(reviews, from_year, stop_words).agg(F.avg(F.size("words")).alias("avg_words"))


def top_words(reviews: DataFrame, from_year: int, n: int = 10, longer_than: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The most frequent cleaned words of more than `longer_than` characters."""
    words = cleaned(reviews, from_year, stop_words).select(F.explode("words").alias("word")).filter(F.char_length("word") > longer_than)
    return top_counts(words, F.col("word"), "word", n)


def top_words_without(reviews: DataFrame, from_year: int, stop_words: DataFrame, n: int = 10, longer_than: int = 3) -> DataFrame:
    """The same with the stop-words (word) of a table, which an anti join leaves out."""
    words = cleaned(reviews, from_year, ()).select(F.explode("words").alias("word")).filter(F.char_length("word") > longer_than)
    # counted before the join, so that a row a word meets the stop-words
    return key_counts(words, F.col("word"), "word").join(stop_words.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(n)


def pairs_in_state(reviews: DataFrame, businesses: DataFrame, state: str) -> DataFrame:
    """(user_id, business_id) of every review of the state's businesses, repeats included."""
    return reviews.select("user_id", "business_id").join(businesses.filter(F.col("state") == state), "business_id", "left_semi").select("user_id", "business_id")
