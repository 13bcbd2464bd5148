"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rounds by the order of ids, which is enough for stars; then rounds by one of so many hashes in turn (a hash of its own for each
#: round would be compiled anew each time); rounds after which the labels' plan is cut.
PLAIN, HASHES, CUT_LABELS = 2, 4, 4


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component): for every id in a link, the least id that it is connected with.

    In each round every node goes into the neighbour or itself of the least number, and the links are rewritten with that
    map, without loops and repeats. In the first rounds a node's number is its id, then a hash of it. Whatever the
    graph, a chain with rising ids too, that leaves three quarters of the nodes on average, so the rounds are logarithmic in their number.
    All steps are partial aggregates and sort-merge joins on node ids; nothing is gathered per node, and each round ends
    in a checkpoint. An empty link table gives an empty result.
    """
    edges, labels, n = cut(links.select("a", "b").where("a <> b").distinct()), None, 0
    while True:
        drawn = lambda c: F.struct((c if n < PLAIN else F.xxhash64(F.lit(n % HASHES), c)).alias("h"), c.alias("id"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(drawn(F.col("b"))).alias("m"))
        least = cut(least.select(F.col("a").alias("id"), F.least(drawn(F.col("a")), F.col("m"))["id"].alias("to")))
        if labels is None:
            labels = least.select("id", F.col("to").alias("component"))
        else:
            step = least.select(F.col("id").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        a, b = least.select(F.col("id").alias("a"), F.col("to").alias("x")), least.select(F.col("id").alias("b"), F.col("to").alias("y"))
        edges = cut(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        n += 1
        if edges.isEmpty():
            break
        if n % CUT_LABELS == 0:
            labels = cut(labels)
    labels = cut(labels)
    named = labels.groupBy("component").agg(F.min("id").alias("least"))
    return cut(labels.join(named, "component").select("id", F.col("least").alias("component")))
