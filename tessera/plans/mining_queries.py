"""Frequent itemsets and similar sets over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import itemsets, similarity
from tessera.sources import tables
from tessera.sources.tables import BASKETS_SQL, RATINGS_SQL, URL_SETS_SQL

YEAR = 1998
PAIRS, TRIPLES, SHARDS = 30, 5, 4  #: thresholds of pairs and triples, and partitions of the candidates
LARGE = 5
SIMILAR = 0.3
ZERO = "1"  #: the rate that counts as none in the conditional baskets, as no rating here is 0


def _sets(spark, sf_dir):
    return tables.url_sets(spark, sf_dir)


def _signed(spark, sf_dir):
    return similarity.signatures(_sets(spark, sf_dir))


def _conditional(spark, sf_dir):
    """Ratings as string rows with rate and year, as a header-only CSV reader gives them."""
    rows = tables.ratings(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in ("user_id", "business_id")], F.col("stars").cast("int").cast("string").alias("rate"), F.year("date").cast("string").alias("year"))
    return itemsets.conditional_baskets(rows, str(YEAR), ZERO)


QUERIES = {
    "baskets_case1": lambda s, d: itemsets.user_baskets(tables.ratings(s, d), YEAR),
    "baskets_case2": lambda s, d: itemsets.business_baskets(tables.ratings(s, d), YEAR),
    "baskets_min_size": lambda s, d: itemsets.larger_baskets(tables.baskets(s, d), LARGE),
    "frequent_k1": lambda s, d: itemsets.frequent(tables.baskets(s, d), PAIRS, 1),
    "frequent_k2": lambda s, d: itemsets.frequent(tables.baskets(s, d), PAIRS, 2),
    "frequent_k3": lambda s, d: itemsets.frequent(tables.baskets(s, d), TRIPLES, 3),
    "frequent_sets": lambda s, d: itemsets.frequent_sets(tables.baskets(s, d), PAIRS, 2).groupBy("k").agg(F.count("*").alias("n"), F.sum("support").alias("support")),
    "frequent_sets_all": lambda s, d: itemsets.frequent_sets(tables.baskets(s, d), PAIRS).groupBy("k").agg(F.count("*").alias("n"), F.sum("support").alias("support")),
    "son_candidates_k1": lambda s, d: itemsets.candidates(tables.baskets(s, d), PAIRS, 1, SHARDS),
    "son_candidates_k2": lambda s, d: itemsets.candidates(tables.baskets(s, d), PAIRS, 2, SHARDS),
    "son_candidate_counts": lambda s, d: itemsets.candidate_counts(tables.baskets(s, d), PAIRS, 2, SHARDS),
    "frequent_fpgrowth": lambda s, d: itemsets.fpgrowth(tables.baskets(s, d), PAIRS, 2),
    "frequent_fpgrowth_all": lambda s, d: itemsets.fpgrowth(tables.baskets(s, d), PAIRS),
    "dense_index": lambda s, d: similarity.dense_index(_sets(s, d), "item"),
    "minhash_signatures": lambda s, d: _signed(s, d).select("user_id", F.posexplode("sig").alias("i", "h")),
    "lsh_candidates": lambda s, d: similarity.band_candidates(_signed(s, d)),
    "lsh_similar_pairs": lambda s, d: similarity.similar_pairs(_sets(s, d), SIMILAR),
    "exact_jaccard_pairs": lambda s, d: similarity.exact_jaccard(_sets(s, d), least=SIMILAR),
    "signature_agreement": lambda s, d: similarity.similar_agreement(_sets(s, d), SIMILAR),
    "baskets_conditional": _conditional,
    "lsh_quality": lambda s, d: similarity.lsh_quality(_sets(s, d), SIMILAR),
}

_ONE = f"SELECT item FROM ({BASKETS_SQL}) GROUP BY item HAVING count(*) >= {{t}}"
_SHARES = f"SELECT basket % {SHARDS} AS pid, count(DISTINCT basket) AS own, sum(count(DISTINCT basket)) OVER () AS total FROM ({BASKETS_SQL}) GROUP BY 1"
_C1 = f"WITH b AS ({BASKETS_SQL}), shares AS ({_SHARES}) SELECT DISTINCT i1 FROM (SELECT basket % {SHARDS} AS pid, item AS i1, count(*) AS n FROM b GROUP BY ALL) JOIN shares USING (pid) WHERE n * total >= {PAIRS} * own"
_C2 = f"WITH b AS ({BASKETS_SQL}), shares AS ({_SHARES}) SELECT DISTINCT i1, i2 FROM (SELECT x.basket % {SHARDS} AS pid, x.item AS i1, y.item AS i2, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL) JOIN shares USING (pid) WHERE n * total >= {PAIRS} * own"
_F1 = f"SELECT item AS i1, count(*) AS support FROM ({BASKETS_SQL}) GROUP BY item HAVING count(*) >= {PAIRS}"
_F2 = f"WITH b AS ({BASKETS_SQL}) SELECT x.item AS i1, y.item AS i2, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL HAVING count(*) >= {PAIRS}"
#: every frequent set as its items in order, grown until a size has none
_ALL = f"""WITH RECURSIVE b AS ({BASKETS_SQL}), one AS ({_F1}), level(k, items, baskets) AS (
SELECT 1, [item], list(basket) FROM b WHERE item IN (SELECT i1 FROM one) GROUP BY item
UNION ALL
SELECT level.k + 1, list_append(level.items, o.item), list_intersect(level.baskets, o.own) FROM level JOIN (SELECT item, list(basket) AS own FROM b WHERE item IN (SELECT i1 FROM one) GROUP BY item) o ON o.item > level.items[-1]
WHERE len(list_intersect(level.baskets, o.own)) >= {PAIRS})
SELECT CAST(k AS INTEGER) AS k, array_to_string(items, ',') AS items, len(baskets) AS support FROM level"""
_COEF = ", ".join(f"({i}, {a1}::BIGINT, {b1}::BIGINT, {a2}::BIGINT, {b2}::BIGINT)" for i, (a1, b1, a2, b2) in enumerate(similarity.coefficients()))
_INDEX = f"SELECT item, row_number() OVER (ORDER BY encode(item)) - 1 AS index FROM (SELECT DISTINCT item FROM ({URL_SETS_SQL}))"
_SIGS = f"""
WITH sets AS ({URL_SETS_SQL}), idx AS ({_INDEX}), m AS (SELECT count(*) AS size FROM idx),
coef(i, a1, b1, a2, b2) AS (VALUES {_COEF}),
hashed AS (SELECT item, i, (((a1 * (index + 1) + b1) % {similarity.PRIME}) + ((a2 * (index + 1) + b2) % {similarity.PRIME}) * (i + 1)) % size AS h FROM idx, coef, m)
SELECT user_id, CAST(i AS INTEGER) AS i, CAST(min(h) AS BIGINT) AS h FROM sets JOIN hashed USING (item) GROUP BY user_id, i"""
_CANDIDATES = f"WITH sig AS ({_SIGS}), bands AS (SELECT user_id, i // 2 AS band, max(CASE WHEN i % 2 = 0 THEN h END) AS h0, max(CASE WHEN i % 2 = 1 THEN h END) AS h1 FROM sig GROUP BY user_id, i // 2) SELECT DISTINCT x.user_id AS u1, y.user_id AS u2 FROM bands x JOIN bands y ON x.band = y.band AND x.h0 = y.h0 AND x.h1 = y.h1 AND x.user_id < y.user_id"
_JACCARD = f"WITH sets AS ({URL_SETS_SQL}), n AS (SELECT user_id, count(*) AS n FROM sets GROUP BY user_id) SELECT u1, u2, round(both_n / (a.n + b.n - both_n), 6) AS sim FROM (SELECT x.user_id AS u1, y.user_id AS u2, count(*) AS both_n FROM sets x JOIN sets y ON x.item = y.item AND x.user_id < y.user_id GROUP BY ALL) JOIN n a ON a.user_id = u1 JOIN n b ON b.user_id = u2"
_TRUE = f"SELECT * FROM ({_JACCARD}) WHERE sim >= {SIMILAR}"

ORACLES = {
    "baskets_case1": f"SELECT DISTINCT user_id AS basket, business_id AS item FROM ({RATINGS_SQL}) WHERE year(date) = {YEAR} AND stars <> 0",
    "baskets_case2": f"SELECT DISTINCT business_id AS basket, user_id AS item FROM ({RATINGS_SQL}) WHERE year(date) = {YEAR} AND stars <> 0",
    "baskets_min_size": f"SELECT basket, item FROM ({BASKETS_SQL}) WHERE basket IN (SELECT basket FROM ({BASKETS_SQL}) GROUP BY basket HAVING count(*) > {LARGE})",
    "frequent_k1": _F1,
    "frequent_k2": _F2,
    "frequent_k3": f"WITH b AS (SELECT basket, item FROM ({BASKETS_SQL}) WHERE item IN ({_ONE.format(t=TRIPLES)})) SELECT x.item AS i1, y.item AS i2, z.item AS i3, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = y.basket AND y.item < z.item GROUP BY ALL HAVING count(*) >= {TRIPLES}",
    "frequent_sets": f"SELECT CAST(1 AS INTEGER) AS k, count(*) AS n, CAST(sum(support) AS BIGINT) AS support FROM ({_F1}) HAVING count(*) > 0 UNION ALL SELECT 2, count(*), CAST(sum(support) AS BIGINT) FROM ({_F2}) HAVING count(*) > 0",
    "frequent_sets_all": f"SELECT k, count(*) AS n, CAST(sum(support) AS BIGINT) AS support FROM ({_ALL}) GROUP BY k",
    "son_candidates_k1": _C1,
    "son_candidates_k2": _C2,
    "son_candidate_counts": f"SELECT CAST(1 AS INTEGER) AS k, (SELECT count(*) FROM ({_C1})) AS n_candidates, (SELECT count(*) FROM ({_F1})) AS n_frequent UNION ALL SELECT 2, (SELECT count(*) FROM ({_C2})), (SELECT count(*) FROM ({_F2}))",
    "frequent_fpgrowth": f"SELECT CAST(i1 AS VARCHAR) AS items, support FROM ({_F1}) UNION ALL SELECT i1 || ',' || i2, support FROM ({_F2})",
    "frequent_fpgrowth_all": f"SELECT items, support FROM ({_ALL})",
    "dense_index": _INDEX,
    "minhash_signatures": _SIGS,
    "lsh_candidates": _CANDIDATES,
    "lsh_similar_pairs": f"SELECT u1, u2, sim FROM ({_TRUE}) SEMI JOIN ({_CANDIDATES}) USING (u1, u2)",
    "exact_jaccard_pairs": _TRUE,
    "signature_agreement": f"WITH sig AS ({_SIGS}) SELECT u1, u2, round(same / {similarity.HASHES} - sim, 6) AS diff FROM (SELECT u1, u2, sim, count(*) FILTER (x.h = y.h) AS same FROM ({_TRUE}) JOIN sig x ON x.user_id = u1 JOIN sig y ON y.user_id = u2 AND y.i = x.i GROUP BY ALL)",
    "baskets_conditional": f"SELECT DISTINCT CAST(user_id AS VARCHAR) AS basket, CAST(business_id AS VARCHAR) AS item FROM ({RATINGS_SQL}) WHERE year(date) = {YEAR} AND CAST(CAST(stars AS INTEGER) AS VARCHAR) <> '{ZERO}'",
    "lsh_quality": f"WITH found AS ({_CANDIDATES}), truth AS ({_TRUE}), c AS (SELECT (SELECT count(*) FROM found) AS f, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM found SEMI JOIN truth USING (u1, u2)) AS hit) SELECT round(hit / nullif(f, 0), 6) AS precision, round(hit / nullif(t, 0), 6) AS recall, round(2.0 / (nullif(f, 0) / nullif(hit, 0) + nullif(t, 0) / nullif(hit, 0)), 6) AS f1 FROM c",
}
