"""Content profiles: TF-IDF words of businesses, unions of them for users, Jaccard scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arithmetic import jaccard
from tessera.functions.text import STOP_WORDS, has_strict_token, strict_tokens
from tessera.session import cut, dealt, stored

#: Fixed values of the model: least share of a kept word, words of a profile, least score of a prediction.
SHARE = 0.0001
WORDS = 100
LEAST = 0.01


def word_counts(reviews: DataFrame) -> DataFrame:
    """(business_id, word, n): strict tokens of each business, counted before the shuffle."""
    return reviews.select("business_id", F.explode(strict_tokens(F.col("text"))).alias("word")).groupBy("business_id", "word").agg(F.count("*").alias("n"))


def tfidf(reviews: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, share: float = SHARE) -> DataFrame:
    """(business_id, word, score) of kept words: no stop-words, more than `share` of all words but those.

    Term frequency is over the most frequent kept word of the business; document frequency and the
    number of businesses are over all tokens. Scores have nine digits, so that ranks don't hang on
    the last bit of a logarithm.
    """
    counts = cut(word_counts(reviews))
    per_word = counts.groupBy("word").agg(F.sum("n").alias("total"), F.count("*").alias("df"))
    stopped = F.col("word").isin(*stop_words) if stop_words else F.lit(False)
    every = per_word.filter(~stopped).agg(F.sum("total").alias("every"))
    n = counts.agg(F.count_distinct("business_id").alias("businesses"))
    kept = per_word.filter(~stopped).join(every).join(n).filter(F.col("total") / F.col("every") > share)  # one row each
    joined = counts.join(kept, "word").select("business_id", "word", "n", F.log2(F.col("businesses") / F.col("df")).alias("idf"))
    # a maximum that combines before the shuffle, not a window over all words of a business
    most = joined.groupBy("business_id").agg(F.max("n").alias("most"))
    return joined.join(most, "business_id").select("business_id", "word", F.round(F.col("n") / F.col("most") * F.col("idf"), 9).alias("score"))


def business_profiles(scores: DataFrame, words: int = WORDS) -> DataFrame:
    """(business_id, word) of the best-scored words; of equal scores the later word."""
    best = Window.partitionBy("business_id").orderBy(F.desc("score"), F.desc("word"))
    return scores.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= words).select("business_id", "word")


def user_profiles(reviews: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user_id, word): the words of all businesses that the user wrote any token about."""
    met = stored(reviews.filter(has_strict_token(F.col("text"))).select("user_id", "business_id").distinct(), "met")
    # a profile of at most WORDS words travels as one row; words multiply where a user's businesses have met
    lists = profiles.groupBy("business_id").agg(F.collect_list("word").alias("words"))
    owned = dealt(met.join(lists, "business_id"), met.count() * 10.0, "user_id")
    return owned.select("user_id", F.explode("words").alias("word")).distinct()


def model(users: DataFrame, businesses: DataFrame) -> DataFrame:
    """(kind, id, words) of both kinds of profile."""
    words = F.array_sort(F.collect_set("word")).alias("words")
    one = businesses.groupBy(F.col("business_id").cast("string").alias("id")).agg(words).withColumn("kind", F.lit("business"))
    two = users.groupBy("user_id").agg(words).select(F.col("user_id").cast("string").alias("id"), "words").withColumn("kind", F.lit("user"))  # where a user's words are
    return one.unionByName(two).select("kind", "id", "words")


def predict(test: DataFrame, users: DataFrame, businesses: DataFrame, least: float = LEAST) -> DataFrame:
    """`test` (user_id, business_id, ...) with sim, the Jaccard of both profiles; 0 without a profile; rows under `least` go."""
    theirs = businesses.groupBy("business_id").agg(F.collect_set("word").alias("_theirs"))
    mine = users.groupBy("user_id").agg(F.collect_set("word").alias("_mine"))  # of the vocabulary's kept words
    asked = test.join(theirs, "business_id", "left")
    scored = dealt(asked, test.count() * 10.0, "user_id").join(mine, "user_id", "left")
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    scored = scored.withColumns({"_both": size(F.array_intersect("_mine", "_theirs")), "_nu": size(F.col("_mine")), "_nb": size(F.col("_theirs"))})
    return scored.withColumn("sim", F.round(jaccard(F.col("_both"), F.col("_nu"), F.col("_nb")), 6)).filter(F.col("sim") >= least).select(*test.columns, "sim")
