"""Connected components by alternating large and small stars.

Every step is an aggregate and a join on a node; no neighbourhood is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemart.llm.tables import stored


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each neighbour that is larger than a node is tied to the node's smallest neighbour."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = pairs.groupBy("b").agg(F.min("a").alias("m"))
    moved = pairs.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` -> ``node``, ``root``, the smallest node reachable.

    Nodes without a link, and NULLs, are not in the result; roots are not their own rows.
    """
    state = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), "links")
    before = None
    while True:
        # The number of pairs and one hash over all of them tell whether anything moved.
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
        state = stored(_small_star(_large_star(state)), "links")
