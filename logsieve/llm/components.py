"""Connected components of links between long ids, by alternating large and small stars.

Every step is a grouped minimum and an equality join, so a hub with any number of links is
combined before the shuffle and its join side can be split. Nothing is collected.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.sources import store


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. Links every larger (large) or smaller neighbour of a node to the node's least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        out = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        near = edges.join(least, "a").where(F.col("b") > F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        out = near.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least id of its component) for all nodes of edges (a, b) but the roots."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b"))
    now, state = store.materialize(ordered.distinct(), "links"), None
    while True:
        new = store.materialize(_stars(_stars(now, True), False), "links")
        row = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        store.release(now)
        now = new
        if tuple(row) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(row)
