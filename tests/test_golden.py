"""Hand-derived cases of the engine's definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.arithmetic import power_residue
from tessera.functions.text import edge_tokens, strict_tokens
from tessera.operators import itemsets, matrix, partitioning, profiles, recommend, reviews, similarity

TEXT = "(Hello), it's GREAT!! 5-star."
BASKETS = {1: "abc", 2: "ab", 3: "abd", 4: "bc", 5: "acd", 6: "ab"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def baskets(spark):
    return spark.createDataFrame([(b, i) for b, items in BASKETS.items() for i in items], "basket long, item string")


def test_tokenisers(spark):
    one = spark.createDataFrame([(TEXT,), (None,), ("",)], "t string")
    got = one.select(edge_tokens(F.col("t"), ()).alias("e"), strict_tokens(F.col("t")).alias("s")).collect()
    assert got[0]["e"] == ["hello", "it's", "great", "5-star"]
    assert got[0]["s"] == ["hello", "its", "great", "star"]
    assert got[1]["e"] == got[2]["s"] == []


def test_unicode_space_and_digits(spark):
    one = spark.createDataFrame([("a b c\x1cd x²y ٣z",)], "t string")
    assert one.select(strict_tokens(F.col("t")).alias("s")).first()["s"] == ["a", "b", "c", "d", "xy", "z"]


def test_power_partitions(spark):
    years = spark.createDataFrame([(y,) for y in (2010, 2011, 2012, 2015, 2017, 2019)], "y int")
    got = {r["y"]: r["p"] for r in years.select("y", power_residue(F.col("y"), F.col("y"), 10).alias("p")).collect()}
    assert got == {y: pow(y, y, 10) for y in got} == {2010: 0, 2011: 1, 2012: 6, 2015: 5, 2017: 7, 2019: 9}
    report = partitioning.report(partitioning.by_power(years, "y", 10), 10)
    assert [r[2] for r in rows(report)] == [1, 1, 0, 0, 0, 1, 1, 1, 0, 1]
    assert rows(partitioning.totals(partitioning.report(partitioning.by_hash(years, "y", 10), 10))) == [(10, 6)]


def test_frequent_sets(baskets):
    assert rows(itemsets.frequent(baskets, 3, 1)) == [("a", 5), ("b", 5), ("c", 3)]
    assert rows(itemsets.frequent(baskets, 3, 2)) == [("a", "b", 4)]
    assert rows(itemsets.frequent_sets(baskets, 3)) == [(1, "a", 5), (1, "b", 5), (1, "c", 3), (2, "a,b", 4)]
    assert rows(itemsets.fpgrowth(baskets, 3)) == [("a", 5), ("a,b", 4), ("b", 5), ("c", 3)]


def test_frequent_sets_of_every_size(spark):
    table = spark.createDataFrame([(i, x) for i in range(3) for x in "abcde"] + [(3, "a")], "basket long, item string")
    sizes = {1: 5, 2: 10, 3: 10, 4: 5, 5: 1}
    found = rows(itemsets.frequent_sets(table, 3))
    assert {k: sum(r[0] == k for r in found) for k in sizes} == sizes and len(found) == 31
    assert sorted(r[1:] for r in found) == rows(itemsets.fpgrowth(table, 3))
    assert {r[0] for r in rows(itemsets.frequent_sets(table, 3, 2))} == {1, 2}


def test_candidates(baskets):
    assert rows(itemsets.candidates(baskets, 3, 1, 2)) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(itemsets.candidates(baskets, 3, 2, 2)) == [("a", "b"), ("a", "c"), ("a", "d")]
    assert rows(itemsets.candidates(baskets, 3, 3, 2)) == []
    assert rows(itemsets.candidate_counts(baskets, 3, 2, 2)) == [(1, 4, 3), (2, 3, 1)]


def test_frequent_is_sound_and_complete(spark):
    draw = random.Random(3)
    held = {b: draw.sample(range(12), draw.randint(1, 6)) for b in range(60)}
    table = spark.createDataFrame([(b, i) for b, items in held.items() for i in items], "basket long, item long")
    want = {}
    for items in held.values():
        own = sorted(items)
        for x in range(len(own)):
            for y in range(x + 1, len(own)):
                for z in range(y + 1, len(own)):
                    want[own[x], own[y], own[z]] = want.get((own[x], own[y], own[z]), 0) + 1
    want = {k: v for k, v in want.items() if v >= 3}
    assert {r[:3]: r[3] for r in rows(itemsets.frequent(table, 3, 3))} == want
    pairs = {r[:2] for r in rows(itemsets.frequent(table, 6, 2))}
    assert pairs <= {*rows(itemsets.candidates(table, 6, 2, 4))}


def test_baskets(spark):
    ratings = spark.createDataFrame([("u", "b", "1", "2016"), ("u", "b", "2", "2016"), ("u", "c", "0", "2016"), ("v", "b", "3", "2015")], "user_id string, business_id string, rate string, year string")
    assert rows(itemsets.conditional_baskets(ratings)) == [("u", "b")]
    assert rows(itemsets.conditional_baskets(ratings.drop("year"))) == [("u", "b"), ("u", "c"), ("v", "b")]
    assert rows(itemsets.business_baskets(ratings, 2016, "rate")) == [("b", "u")]
    assert rows(itemsets.larger_baskets(itemsets.user_baskets(ratings), 1)) == [("u", "b"), ("u", "c")]


def test_hash_and_jaccard(spark):
    a1, b1, a2, b2, m, x = 3, 1, 5, 2, 10, 4
    assert [(((a1 * (x + 1) + b1) % similarity.PRIME) + ((a2 * (x + 1) + b2) % similarity.PRIME) * (i + 1)) % m for i in (0, 1)] == [3, 0]
    sets = spark.createDataFrame([("p", i) for i in (1, 2, 3)] + [("q", i) for i in (2, 3, 4)] + [("r", 9)], "user_id string, item long")
    assert rows(similarity.exact_jaccard(sets)) == [("p", "q", 0.5)]
    assert rows(similarity.dense_index(sets, "item")) == [(1, 0), (2, 1), (3, 2), (4, 3), (9, 4)]


def test_signatures_and_bands(spark):
    draw = random.Random(5)
    held = {u: {*draw.sample(range(30), draw.randint(2, 9))} for u in range(25)}
    sets = spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "user_id long, item long")
    index = {i: n for n, i in enumerate(sorted({i for s in held.values() for i in s}))}
    want = {u: [min((((a1 * (index[i] + 1) + b1) % similarity.PRIME) + ((a2 * (index[i] + 1) + b2) % similarity.PRIME) * (k + 1)) % len(index) for i in s) for k, (a1, b1, a2, b2) in enumerate(similarity.coefficients())] for u, s in held.items()}
    signed = similarity.signatures(sets)
    assert {r["user_id"]: r["sig"] for r in signed.collect()} == want
    pairs = {(u, v) for u in held for v in held if u < v and any(want[u][2 * b : 2 * b + 2] == want[v][2 * b : 2 * b + 2] for b in range(50))}
    assert {*rows(similarity.band_candidates(signed))} == pairs
    exact = {(u, v): s for u, v, s in rows(similarity.exact_jaccard(sets))}
    found = rows(similarity.similar_pairs(sets, 0.3))
    assert all(exact[u, v] == s and s >= 0.3 for u, v, s in found)
    assert len(rows(similarity.agreement(signed, similarity.exact_jaccard(sets)))) == len(exact)
    true = [p for p, s in exact.items() if s >= 0.3]
    metrics = similarity.quality(spark.createDataFrame(sorted(pairs), "u1 long, u2 long"), spark.createDataFrame(true, "u1 long, u2 long")).first()
    hit = len({*true} & pairs)
    assert metrics["precision"] == round(hit / len(pairs), 6) and metrics["recall"] == round(hit / len(true), 6)


def test_profiles(spark):
    texts = spark.createDataFrame([("r", "X", "good good pizza"), ("s", "Y", "good sushi")], "user_id string, business_id string, text string")
    scores = profiles.tfidf(texts, ())
    assert rows(scores) == [("X", "good", 0.0), ("X", "pizza", 0.5), ("Y", "good", 0.0), ("Y", "sushi", 1.0)]
    owned = profiles.business_profiles(scores)
    users = profiles.user_profiles(texts, owned)
    test = spark.createDataFrame([("r", "X", 1), ("r", "Y", 2), ("nobody", "X", 3)], "user_id string, business_id string, extra int")
    assert rows(profiles.predict(test, users, owned)) == [("r", "X", 1, 1.0), ("r", "Y", 2, 0.333333)]
    assert [r[2] for r in rows(profiles.business_profiles(scores, 1).withColumn("n", F.lit(1)))] == [1, 1]


def stars(spark, cells):
    return spark.createDataFrame([(u, b, float(s)) for u, b, s in cells], "user_id string, business_id string, stars double")


def test_pearson(spark):
    cells = [("u1", "A", 5), ("u2", "A", 3), ("u2", "A", 4), ("u3", "A", 1), ("u4", "A", 4), ("u1", "B", 4), ("u2", "B", 3), ("u3", "B", 2), ("u4", "C", 5)]
    medians = recommend.median_ratings(stars(spark, cells))
    assert ("u2", "A", 3.5) in rows(medians)
    assert rows(recommend.pearson_model(medians)) == [("A", "A", 1.0, 4), ("A", "B", 0.989743, 3), ("B", "B", 1.0, 3)]
    flat = stars(spark, [("u1", "A", 1), ("u2", "A", 1), ("u3", "A", 1), ("u1", "B", 2), ("u2", "B", 3), ("u3", "B", 4)])
    assert rows(recommend.pearson_model(flat, least=-1.0)) == [("A", "A", 0.0, 3), ("A", "B", 0.0, 3), ("B", "B", 1.0, 3)]


def test_pearson_over_all_ratings(spark):
    cells = [("u1", "A", 5), ("u2", "A", 3), ("u3", "A", 1), ("u1", "B", 4), ("u2", "B", 3), ("u3", "B", 2), ("u4", "B", 5)]
    of = {(u, b): s for u, b, s in cells}
    iuf = {"A": math.log2(4 / 3), "B": 0.0}
    mean = {b: sum(s * iuf[b] for (_, x), s in of.items() if x == b) / sum(x == b for _, x in of) for b in "AB"}
    both = [(of[u, "A"] - mean["A"], of[u, "B"] - mean["B"]) for u in ("u1", "u2", "u3")]
    want = sum(x * y for x, y in both) / math.sqrt(sum(x * x for x, _ in both) * sum(y * y for _, y in both))
    got = {r[:2]: r[2] for r in rows(recommend.pearson_model_all_ratings(stars(spark, cells)))}
    assert got["A", "B"] == round(want, 6)


def test_prediction(spark):
    train = stars(spark, [("u", "A", 5), ("u", "B", 3)])
    test = spark.createDataFrame([("u", "T"), ("stranger", "T")], "user_id string, business_id string")
    model = spark.createDataFrame([("A", "T", 0.8, 25)], "b1 string, b2 string, sim double, num_co_rated int")
    assert rows(recommend.predict(train, test, model)) == [("u", "T", 5.0)]
    assert rows(recommend.predict(train, test, model.limit(0))) == [("u", "T", 2.5)]


def test_matrix(spark):
    assert rows(matrix.multiply(matrix.from_rows(spark, [[1, 2], [3, 4]]), matrix.from_rows(spark, [[5, 6], [7, 8]]))) == [(0, 0, 19), (0, 1, 22), (1, 0, 43), (1, 1, 50)]
    import numpy as np

    draw = np.random.default_rng(1)
    for n, m, k in ((1, 1, 1), (3, 7, 2), (9, 4, 11)):
        a, b = draw.integers(1, 99, (n, m)), draw.integers(1, 99, (m, k))
        got = {(i, j): v for i, j, v in rows(matrix.multiply(matrix.from_rows(spark, a.tolist()), matrix.from_rows(spark, b.tolist())))}
        assert got == {(i, j): int((a @ b)[i, j]) for i in range(n) for j in range(k)}


def test_review_counts(spark):
    table = spark.sql("SELECT * FROM VALUES ('a', 1.0D, timestamp_ntz'2015-01-02', 'The (good) food, the end'), ('a', 4.0D, timestamp_ntz'2016-01-02', '!!!'), ('b', NULL, timestamp_ntz'2016-03-02', NULL) AS t(business_id, stars, date, text)")
    assert reviews.mean(table, "stars", "m").first()["m"] == 2.5
    assert reviews.count_where(table, F.year("date") != 2015, "n").first()["n"] == 2
    assert rows(reviews.top_months(table, 1)) == [("01", 2)]
    assert rows(reviews.words_per_month(table, 2015)) == [("01", 3), ("03", 0)]
    assert reviews.words_per_review(table, 2016).first()["avg_words"] == 0.0
    assert rows(reviews.top_words(table, 2015, 10, 3)) == [("food", 1), ("good", 1)]
    assert rows(reviews.years_over(table, 1)) == [(2016, 2)]
    states = spark.createDataFrame([("a", "AZ"), ("b", "NV")], "business_id string, state string")
    assert rows(reviews.top_states(table, states)) == [("AZ", 2), ("NV", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "basket long, item string")
    assert itemsets.frequent_sets(none, 2).count() == itemsets.fpgrowth(none, 2).count() == itemsets.candidates(none, 2, 2).count() == 0
    assert reviews.mean(spark.createDataFrame([], "x double"), "x", "m").first()["m"] is None
    assert recommend.pearson_model(stars(spark, [])).count() == 0
    assert similarity.similar_pairs(spark.createDataFrame([], "user_id long, item string")).count() == 0


def test_large_sets_meet_item_by_item(spark, monkeypatch):
    monkeypatch.setattr(similarity, "WHOLE", 3)
    sets = {1: "abcd", 2: "abce", 3: "ab", 4: "abc", 5: "xyz", 6: "abcd", 7: "xyzvwabcdefgh", 8: "y"}
    table = spark.createDataFrame([(u, i) for u, own in sets.items() for i in own], "user_id long, item string")
    for least in (0.3, 0.5, 0.75, 1.0):
        want = [(a, b, s) for a in sets for b in sets if a < b and (s := round(len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}), 6)) >= least]
        assert rows(similarity.exact_jaccard(table, least=least)) == sorted(want)
    pairs = spark.createDataFrame([(1, 2), (3, 5), (1, 5), (7, 8)], "u1 long, u2 long")
    assert rows(similarity.exact_jaccard(table, pairs)) == [(1, 2, 0.6), (1, 5, 0.0), (3, 5, 0.0), (7, 8, round(1 / 13, 6))]


def test_equal_signatures_meet_once(spark):
    signed = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 2, 9, 9]), (3, [1, 2, 3, 4]), (4, [7, 7, 9, 9]), (5, [0, 0, 0, 0]), (6, [1, 2, 3, 4])], "user_id long, sig array<long>")
    assert rows(similarity.band_candidates(signed)) == [(1, 2), (1, 3), (1, 6), (2, 3), (2, 4), (2, 6), (3, 6)]


def test_timed_and_shared_folder(spark):
    from tessera import session

    found, seconds = session.timed(lambda: 7)
    assert found == 7 and seconds >= 0
    assert session.new_folder(spark, "x") != session.new_folder(spark, "x")


def test_candidates_of_every_level(spark):
    """Level by level with local pruning, against all sets of each partition."""
    from itertools import combinations

    draw = random.Random(4)
    held = {b: sorted(draw.sample(range(9), draw.randint(1, 6))) for b in range(60)}
    table = spark.createDataFrame([(b, i) for b, own in held.items() for i in own], "basket long, item long")
    for k in (1, 2, 3, 4):
        want = set()
        for pid in range(3):
            here = [own for b, own in held.items() if b % 3 == pid]
            sets = [c for own in here for c in combinations(own, k)]
            want |= {c for c in sets if sets.count(c) * len(held) >= 9 * len(here)}
        assert rows(itemsets.candidates(table, 9, k, 3)) == sorted(want)
