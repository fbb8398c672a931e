"""Frequent itemsets: exact supports, and the candidates of partition-local mining.

A basket table is long: (basket, item), each pair once. Itemsets of size k are columns
i1 < ... < ik. A set is a candidate exactly if some partition holds it at least threshold *
baskets there / all baskets times; as its subsets are then held as often there, candidates are
found level by level in all partitions at once, like frequent sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import PART, cut, dealt, stored

TREE, READ = 20_000, 100_000  #: rows of baskets for each part of the prefix trees, and of a task that sends them there


def user_baskets(ratings: DataFrame, year: int | None = None, rated: str = "stars") -> DataFrame:
    """(basket, item): the businesses of each user; with a year, only of its ratings other than 0."""
    return _baskets(ratings, "user_id", "business_id", year, rated)


def business_baskets(ratings: DataFrame, year: int | None = None, rated: str = "stars") -> DataFrame:
    """(basket, item): the users of each business."""
    return _baskets(ratings, "business_id", "user_id", year, rated)


def _baskets(ratings: DataFrame, basket: str, item: str, year: int | None, rated: str) -> DataFrame:
    if year is not None:
        own = F.year("date") if "date" in ratings.columns else F.col("year").cast("int")
        ratings = ratings.filter((own == year) & (F.col(rated).cast("double") != 0))
    return ratings.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()


def conditional_baskets(rows: DataFrame, year: str = "2016", zero: str = "0") -> DataFrame:
    """User baskets of string rows; filtered by year and rate only if the table has both columns."""
    if {"rate", "year"} <= {*rows.columns}:
        rows = rows.filter((F.col("year") == year) & (F.col("rate") != zero))
    return rows.select(F.col("user_id").alias("basket"), F.col("business_id").alias("item")).distinct()


def larger_baskets(baskets: DataFrame, more_than: int) -> DataFrame:
    """Baskets of more than `more_than` items."""
    large = baskets.groupBy("basket").agg(F.count("*").alias("n")).filter(F.col("n") > more_than).select("basket")
    return baskets.join(large, "basket", "left_semi")


def _names(k: int) -> list[str]:
    return [f"i{j}" for j in range(1, k + 1)]


def _lotted(baskets: DataFrame, n: int) -> DataFrame:
    """(lot, ...) of baskets that are dealt into lots, which grow in number with the `n` rows, not in size."""
    return baskets.select(F.pmod(F.xxhash64("basket"), F.lit(max(1, math.ceil(n * 16 / PART)))).alias("lot"), "*")


def _pruned(held: DataFrame, kept: DataFrame, names: list[str], n: float) -> DataFrame:
    """The rows of `held` whose set is in `kept` (names, n: its rows), and their part, in partitions for `n` rows.

    A set of more than PART rows is in several parts, by lots. Only kept sets are built in memory, rows stream.
    """
    parts = F.ceil(F.col("n") / PART)
    crowded = kept.filter(F.col("n") > PART).select(*names, parts.alias("parts"))  # at most one row for PART rows of `held`
    rows = held.join(F.broadcast(crowded), names, "left").withColumn("part", F.pmod("lot", F.coalesce("parts", F.lit(1)))).drop("parts")
    there = kept.select(*names, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    keys = [*names, "part"]
    return dealt(rows, n, *keys).join(dealt(there, n, *keys).hint("shuffle_hash"), keys, "left_semi")


def _gathered(items: DataFrame, also: list[str], n: int) -> DataFrame:
    """(lot, also, rest) from `n` or fewer rows (lot, basket, also, i1): the items of a basket in order."""
    rows = items.filter(F.col("basket").isNotNull()).select("lot", "basket", *also, "i1")
    return cut(dealt(rows, n * 4, "lot").groupBy("lot", "basket", *also).agg(F.sort_array(F.collect_list("i1")).alias("rest")).drop("basket"))


def _made(held: DataFrame, *sizes: tuple[int, int]) -> list[float]:
    """For each (size, less): how many choices of `size` items there are in the rests, `less` items of each left out."""
    sums = []
    for size, less in sizes:
        chosen = F.lit(1.0)
        for j in range(size):
            chosen = chosen * F.greatest(F.size("rest") - (less + j), F.lit(0)) / (j + 1)
        sums.append(F.sum(chosen))
    return [n or 0.0 for n in held.agg(*sums).first()]


def _grown(held: DataFrame, names: list[str], k: int) -> DataFrame:
    """The sets (names) that `held` has, each with an item of its rest as i`k`; the rest is what comes after that."""
    wider = held.select("lot", *names, "rest", F.posexplode("rest").alias("at", f"i{k}"))
    if k > 1:
        wider = wider.filter(F.col(f"i{k}") > F.col(f"i{k - 1}"))
    return wider.select("lot", *names, f"i{k}", F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))


def _counted(grown: DataFrame, also: list[str], names: list[str], n: float) -> DataFrame:
    """(also, names, n): the rows of each set, counted in each lot and then over `n` rows' worth of partitions."""
    there = grown.groupBy("lot", *also, *names).agg(F.count("*").alias("n"))
    return dealt(there, n, *names).groupBy(*also, *names).agg(F.sum("n").alias("n"))


def _sets(items: DataFrame, also: list[str], n: int, often: Callable[[DataFrame], DataFrame], last: int | None) -> Iterator[DataFrame]:
    """(also, i1..ik, n) of the sets of size k = 2, 3, ... whose counts `often` keeps, from `n` or fewer rows (lot, basket, also, i1).

    A set travels with the later items of its basket, so that it grows where it is. A size below
    `last` is checkpointed, as the next one needs it.
    """
    held, more = _gathered(items, also, n), 2
    for size in count(2):
        names = _names(size)
        single, made, longer, next_made = _made(held, (1, 0), (more, 0), (more, 1), (more + 1, 0))
        before = [*also, *names[:-1]] if size > 2 else []

        def grow(rows: DataFrame) -> DataFrame:
            return _grown(rows, before, size) if before else _grown(_grown(rows, also, 1), [*also, "i1"], 2)

        lots = held
        if size == 2 and made > single * 4:  # long baskets: a lot would make more than it is meant to
            lots = held.withColumn("lot", F.pmod(F.xxhash64("lot", "rest"), F.lit(math.ceil(made * 4 / PART))))
        found = often(_counted(grow(dealt(lots, made, "lot", *before)), also, names, made))
        if last is None or size < last:
            found = cut(found)
        yield found
        kept = _pruned(grow(held).filter(F.size("rest") > 0), found, [*also, *names], max(longer, next_made))
        held, more = cut(kept.drop("lot").withColumnRenamed("part", "lot")), 1


def _levels(baskets: DataFrame, threshold: int, last: int | None = None) -> Iterator[DataFrame]:
    """(i1..ik, support) of the sets of size k = 1, 2, ... in at least `threshold` baskets; sizes below `last` are checkpointed.

    Level by level, as a set's subsets are as frequent: only items that are frequent alone, and
    sets whose first part is frequent, are counted. A set in `threshold` baskets has `threshold`
    baskets in some partition's share, so this is what partition-local mining ends with too.
    """
    baskets = stored(baskets, "baskets")
    one = baskets.groupBy(F.col("item").alias("i1")).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    if last is None or last > 1:
        one = cut(one)
    yield one.withColumnRenamed("n", "support")
    n = baskets.count()
    items = _pruned(_lotted(baskets, n).withColumnRenamed("item", "i1"), one, ["i1"], n)
    for found in _sets(items, [], n, lambda counted: counted.filter(F.col("n") >= threshold), last):
        yield found.withColumnRenamed("n", "support")


def frequent(baskets: DataFrame, threshold: int, k: int) -> DataFrame:
    """(i1..ik, support) of the sets of size k in at least `threshold` baskets."""
    return next(islice(_levels(baskets, threshold, k), k - 1, None))


def frequent_sets(baskets: DataFrame, threshold: int, most: int | None = None) -> DataFrame:
    """(k, items, support) of all frequent sets, until a size has none; items joined by commas. `most` caps the size."""
    out = None
    for k, level in enumerate(_levels(baskets, threshold, most), 1):
        found = cut(level) if k == most else level
        if found.isEmpty():
            break
        rows = found.select(F.lit(k).alias("k"), F.concat_ws(",", *[F.col(c).cast("string") for c in _names(k)]).alias("items"), "support")
        out = rows if out is None else out.unionByName(rows)
        if k == most:
            break
    return out if out is not None else baskets.sparkSession.createDataFrame([], "k int, items string, support long")


def _local_levels(baskets: DataFrame, threshold: int, partitions: int, last: int | None = None) -> Iterator[DataFrame]:
    """(pid, i1..ik) of the sets of size k = 1, 2, ... that a partition finds frequent in its share; sizes below `last` are checkpointed.

    Only items that are frequent in the partition, and sets whose first part is, are counted there.
    """
    baskets = stored(baskets, "baskets")
    n = baskets.count()
    pid = F.pmod("basket", F.lit(partitions)).alias("pid")
    sizes = dealt(baskets, n, "basket").select("basket").distinct().groupBy(pid).agg(F.count("*").alias("own"))
    total = sizes.agg(F.sum("own").alias("total"))
    shares = cut(sizes.join(F.broadcast(total)))  # one row for each partition number

    def often(counted: DataFrame) -> DataFrame:
        return counted.join(F.broadcast(shares), "pid").filter(F.col("n") * F.col("total") >= threshold * F.col("own")).drop("own", "total")

    held = _lotted(baskets, n).select("lot", "basket", pid, F.col("item").alias("i1"))
    one = often(held.groupBy("pid", "i1").agg(F.count("*").alias("n")))
    if last is None or last > 1:
        one = cut(one)
    yield one.drop("n")
    for found in _sets(_pruned(held, one, ["pid", "i1"], n), ["pid"], n, often, last):
        yield found.drop("n")


def candidates(baskets: DataFrame, threshold: int, k: int, partitions: int = 4) -> DataFrame:
    """(i1..ik) that some partition, of baskets by number modulo `partitions`, finds frequent in its share."""
    return next(islice(_local_levels(baskets, threshold, partitions, k), k - 1, None)).select(*_names(k)).distinct()


def candidate_counts(baskets: DataFrame, threshold: int, most: int = 2, partitions: int = 4) -> DataFrame:
    """(k, n_candidates, n_frequent) for sizes 1 to `most`; each level is grown once."""
    out = None
    for k, local, exact in zip(range(1, most + 1), _local_levels(baskets, threshold, partitions, most), _levels(baskets, threshold, most)):
        ours = local.select(*_names(k)).distinct().agg(F.count("*").alias("n_candidates"))
        row = cut(ours.join(exact.agg(F.count("*").alias("n_frequent"))).select(F.lit(k).alias("k"), "n_candidates", "n_frequent"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def fpgrowth(baskets: DataFrame, threshold: int, most: int | None = None) -> DataFrame:
    """(items, support) of all frequent sets by FP-growth, items in order and joined by commas. `most` caps the size.

    The threshold is a share there; half a basket less than the threshold keeps rounding out of it.
    The parts of the trees grow in number with the rows, so that none grows in size.
    """
    from pyspark.ml.fpm import FPGrowth

    baskets = stored(baskets, "baskets")
    rows = baskets.count()
    often = baskets.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).select("item")
    sets = stored(dealt(baskets.join(often, "item", "left_semi"), rows, "basket").groupBy("basket").agg(F.collect_set("item").alias("items")), "sets")
    if not rows:
        return baskets.sparkSession.createDataFrame([], "items string, support long")
    held = max(1, sets.count())  # shares are of the sets left, which hold all frequent items
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (threshold - 0.5) / held)), numPartitions=max(1, math.ceil(rows / TREE))).fit(sets.repartition(max(1, math.ceil(rows / READ)))).freqItemsets
    if most is not None:
        found = found.filter(F.size("items") <= most)
    return found.select(F.array_join(F.transform(F.array_sort("items"), lambda i: i.cast("string")), ",").alias("items"), F.col("freq").alias("support"))
