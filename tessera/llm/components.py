"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

TOGETHER = 50_000  #: rows of a round's table that one task may write, about


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """The smallest reachable node of each linked node: (node, root).

    Each round every node takes the smallest label among its own and its neighbours', then the
    label of that label, so labels travel in doubling steps and the rounds grow with the logarithm
    of a component's width. Rounds end when no label changes. Neighbour minima are combined before
    the shuffle, and the joins' hot keys are split by adaptive execution, so a node with very many
    links is no single task's work. Each round is cut by a checkpoint. No edges: no rows.
    """
    # orderable node type; both directions
    both = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct())
    # a round's tables have no more rows than this; few rows need no more than a few checkpoint files
    files = max(1, -(-both.count() // TOGETHER))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")).coalesce(files))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("mid"), F.col("root").alias("was"))
        hooked = cut(hooked.coalesce(files))
        # a root has a label of its own, which may have moved
        jump = hooked.select(F.col("node").alias("mid"), F.col("mid").alias("up"))
        labels = cut(hooked.join(jump, "mid").select("node", F.least("mid", "up").alias("root"), "was").coalesce(files))
        if not labels.filter(F.col("root") != F.col("was")).limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
