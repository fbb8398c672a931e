"""What grows with the input: plans and results of the steps that larger tables need."""

import random
import re
from itertools import combinations

import pytest

from tessera import session
from tessera.operators import blocks, itemsets, profiles, recommend, similarity


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def crowd():
    """Sets that nearly all share items and bands, two of them equal and one large."""
    draw = random.Random(8)
    held = {u: {"x", *draw.sample("abcdefgh", draw.randint(1, 5))} for u in range(40)}
    return held | {40: held[3], 41: {*"xabcdefghijklmnop"}}


@pytest.fixture
def sets(spark, crowd, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "STRIP", 64)
    monkeypatch.setattr(similarity, "WHOLE", 12)
    return spark.createDataFrame([(u, i) for u, own in crowd.items() for i in sorted(own)], "user_id long, item string")


def true(crowd, least):
    found = {(a, b): round(len(crowd[a] & crowd[b]) / len(crowd[a] | crowd[b]), 6) for a in crowd for b in crowd if a < b}
    return {p: s for p, s in found.items() if s >= least}


def banded(signed):
    of = {r["user_id"]: r["sig"] for r in signed.collect()}
    return {(a, b) for a in of for b in of if a < b and any(of[a][k : k + 2] == of[b][k : k + 2] for k in range(0, 100, 2))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowded_bands_meet_without_a_shuffle_of_pairs(sets):
    """block by block, no join on bands whose pairs travel."""
    signed = similarity.signatures(sets)
    found = similarity.band_candidates(signed)
    assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
    assert {*rows(found)} == banded(signed)


def test_crowded_items_meet_without_a_shuffle_of_pairs(spark, crowd, sets, monkeypatch):
    """the same for exact similarities; only pairs with a large set meet item by item."""
    for least in (0.3, 0.5, 0.8, 1.0):
        assert {r[:2]: r[2] for r in rows(similarity.exact_jaccard(sets, least=least))} == true(crowd, least)
    monkeypatch.setattr(similarity, "WHOLE", 4096)
    found = similarity.exact_jaccard(sets, least=0.3)
    assert "CartesianProduct" in plan(found) and "Exchange" not in plan(found)
    assert {r[:2]: r[2] for r in rows(found)} == true(crowd, 0.3)


def test_rare_items_still_meet_by_keys(spark, monkeypatch):
    """A sparse table is not compared block by block."""
    monkeypatch.setattr(similarity, "SPARSE", 64)
    table = spark.createDataFrame([(u, i) for u in range(300) for i in (u, u + 1)], "user_id long, item long")
    found = similarity.exact_jaccard(table, least=0.3)
    assert "CartesianProduct" not in plan(found)
    assert rows(found) == [(u, u + 1, 0.333333) for u in range(299)]


def test_similar_candidates_of_a_crowd(crowd, sets):
    """candidates and similarities in one pass of the blocks."""
    near, want = banded(similarity.signatures(sets)), true(crowd, 0.3)
    found = similarity.similar_pairs(sets, 0.3)
    assert "CartesianProduct" in plan(found)
    assert {r[:2]: r[2] for r in rows(found)} == {p: s for p, s in want.items() if p in near}


def test_agreement_of_a_crowd(crowd, sets):
    """signature entries are compared where the pairs are."""
    of, want = {r["user_id"]: r["sig"] for r in similarity.signatures(sets).collect()}, true(crowd, 0.3)
    found = similarity.similar_agreement(sets, 0.3)
    assert "CartesianProduct" in plan(found)
    got = {r[:2]: r[2] for r in rows(found)}
    assert got == {(a, b): pytest.approx(sum(x == y for x, y in zip(of[a], of[b])) / 100 - s, abs=2e-6) for (a, b), s in want.items()}


def test_quality_of_a_crowd_is_counted_in_place(crowd, sets):
    """three counts leave a task, not its pairs."""
    near, want = banded(similarity.signatures(sets)), true(crowd, 0.3)
    hit = len(near & {*want})
    got = similarity.lsh_quality(sets, 0.3).first()
    assert (got["precision"], got["recall"]) == (round(hit / len(near), 6), round(hit / len(want), 6))
    assert rows(blocks.counts(_signed_rows(sets), 2, 0.3)) == [(len(near), len([p for p in want if 41 not in p]), len([p for p in near if p in want and 41 not in p]))]


def _signed_rows(sets):
    return similarity._prepared(sets, 0.0)[3]


def _rated(spark, seed, businesses):
    draw = random.Random(seed)
    cells = {(f"u{u:02}", f"b{b:02}"): draw.randint(2, 10) / 2 for u in range(30) for b in draw.sample(range(businesses), draw.randint(1, 9))}
    return cells, spark.createDataFrame([(u, b, s) for (u, b), s in cells.items()], "user_id string, business_id string, stars double")


def test_co_rated_pairs_are_summed_where_they_are_made(spark, monkeypatch):
    """many groups of businesses give the sums of all pairs, and no pair is shuffled."""
    monkeypatch.setattr(recommend, "PART", 20)
    monkeypatch.setattr(session, "PART", 20)
    cells, medians = _rated(spark, 3, 14)
    found = recommend.pearson_model(medians, 1, -1.0)
    assert "hashpartitioning(g" in plan(found) and "hashpartitioning(b1" not in plan(found)
    names = sorted({b for _, b in cells})
    both = {(a, b): k for a in names for b in names if a <= b and (k := sum((u, a) in cells and (u, b) in cells for u in {u for u, _ in cells}))}
    assert {r[:2]: r[3] for r in rows(found)} == both
    for a, b, sim, _ in rows(found):
        xy = [(s, cells[u, b]) for (u, own), s in cells.items() if own == a and (u, b) in cells]
        x, y = zip(*xy)
        mx, my = sum(x) / len(x), sum(y) / len(y)
        size = sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y)
        assert sim == pytest.approx(sum((v - mx) * (w - my) for v, w in xy) / size**0.5 if size > 1e-9 else 0.0, abs=2e-6)


def test_sets_are_counted_in_lots(spark, monkeypatch):
    """F13 to F18: a task counts lots of baskets, many of them where rows are many."""
    monkeypatch.setattr(session, "PART", 10)
    monkeypatch.setattr(itemsets, "PART", 10)
    table = spark.createDataFrame([(b, i) for b in range(40) for i in range(b % 5)], "basket long, item long")
    found = itemsets.frequent(table, 10, 2)
    assert "hashpartitioning(lot" in plan(found)
    assert rows(found) == [(0, 1, 24), (0, 2, 16), (1, 2, 16)]


def test_words_multiply_where_users_are(spark):
    """a user's words are made distinct where its businesses have met, without a shuffle by user and word."""
    reviews = spark.createDataFrame([("r", "X", "good"), ("s", "X", "pizza"), ("s", "Y", "sushi"), ("t", "Y", "!")], "user_id string, business_id string, text string")
    owned = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "b")], "business_id string, word string")
    found = profiles.user_profiles(reviews, owned)
    assert "word#" not in " ".join(x for x in plan(found).splitlines() if "Exchange hashpartitioning(user_id" in x)
    assert rows(found) == [("r", "a"), ("r", "b"), ("s", "a"), ("s", "b")]


def _bought(spark, monkeypatch, part=60):
    """Baskets with an item in all of them and sets of more rows than a part has, one basket long, and rows without a key."""
    monkeypatch.setattr(session, "PART", part)
    monkeypatch.setattr(itemsets, "PART", part)
    draw = random.Random(5)
    held = {b: {"a", *(x for x in "bcdefgh" if draw.random() < 0.5)} for b in range(90)} | {90: {*"abcdefghijklmnopqr"}}
    return held, spark.createDataFrame([(b, i) for b, own in held.items() for i in sorted(own)] + [(None, "a"), (None, "b"), (1, None)], "basket long, item string")


def _enumerated(held, k, least, of=lambda b: True):
    found = {}
    for own in (own for b, own in held.items() if of(b)):
        for names in combinations(sorted(own), k):
            found[names] = found.get(names, 0) + 1
    return {names: n for names, n in found.items() if n >= least}


def _unnumbered(text, usual=4):
    """The shuffles of sets that have as many partitions as the session names, however many the rows are."""
    return [x for x in re.findall(rf"hashpartitioning\(([^)]*), {usual}\), ENSURE_REQUIREMENTS", text) if "i2#" in x or "lot#" in x]


def _seen(monkeypatch):
    """The plans of what is checkpointed from now on."""
    plans, old = [], itemsets.cut
    monkeypatch.setattr(itemsets, "cut", lambda df: (plans.append(plan(df)), old(df))[1])
    return plans


def test_triples_are_counted_in_numbered_partitions(spark, monkeypatch):
    """each shuffle of sets has partitions by its rows, and a crowded set is in several of them."""
    held, table = _bought(spark, monkeypatch)
    plans = _seen(monkeypatch)
    found = itemsets.frequent(table, 10, 3)
    assert not _unnumbered("".join([*plans, plan(found)]))
    assert {r[:3]: r[3] for r in rows(found)} == _enumerated(held, 3, 10)


def test_frequent_pairs_are_counted_in_numbered_partitions(spark, monkeypatch):
    """where the session names more partitions than the rows need, too; a long basket's pairs are dealt over more lots."""
    held, table = _bought(spark, monkeypatch, 1000)
    long = {1000: {f"x{j:02}" for j in range(80)}, 1001: {f"x{j:02}" for j in range(1, 81)}}
    held |= long
    table = table.dropna().union(spark.createDataFrame([(b, i) for b, own in long.items() for i in sorted(own)], "basket long, item string"))
    plans = _seen(monkeypatch)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        found = rows(itemsets.frequent_sets(table, 2, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not _unnumbered("".join(plans), 16)
    assert found == sorted((k, ",".join(names), n) for k in (1, 2) for names, n in _enumerated(held, k, 2).items())


def test_all_frequent_sets_are_counted_in_numbered_partitions(spark, monkeypatch):
    """F16: sets of every size, each size counted once."""
    held, table = _bought(spark, monkeypatch)
    plans = _seen(monkeypatch)
    found = itemsets.frequent_sets(table.dropna(), 20)
    assert not _unnumbered("".join(plans))
    want = [(k, ",".join(names), n) for k in range(1, 9) for names, n in _enumerated(held, k, 20).items()]
    assert rows(found) == sorted(want) and max(want)[0] >= 3
    assert len([p for p in plans if "REPARTITION_BY_NUM" in p and "sum(n" in p]) == max(want)[0]  # sizes from 2 to the one that has none


def test_candidates_are_counted_in_numbered_partitions(spark, monkeypatch):
    """what a partition of the baskets finds frequent, too."""
    held, table = _bought(spark, monkeypatch)
    plans = _seen(monkeypatch)
    found = itemsets.candidate_counts(table.dropna(), 40, 2, 2)
    assert not _unnumbered("".join(plans))
    for k, n_candidates, n_frequent in rows(found):
        own = [sum(b % 2 == p for b in held) for p in (0, 1)]
        there = {names for p in (0, 1) for names in _enumerated(held, k, 40 * own[p] / len(held), lambda b, p=p: b % 2 == p)}
        assert (n_candidates, n_frequent) == (len(there), len(_enumerated(held, k, 40)))
