"""Connected components of a table of links, by alternating star contractions.

Large-star then small-star (Kiveris et al. 2014), as joins and aggregates: every round moves each node's
links to its least neighbour, until the links are stars around each component's least node. Rounds grow
with the logarithm of the components' size; each writes its links to the shared folder, so that lineage
stays short and lost executors cost one round. No component is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog_lake.session import materialise

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Links of each node to its larger neighbours go to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them. Links point from larger a to smaller b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least.hint("merge"), "a")
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component: its component's least node) for the nodes of ``links`` (a, b), of any one type that can be ordered; nodes without links aren't listed."""
    oriented = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, mark = materialise(oriented, "links"), None
    for _ in range(MOST_ROUNDS):
        row = state.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if mark == (row["n"], row["x"]) or row["n"] == 0:
            break
        mark = (row["n"], row["x"])
        state = materialise(_small_star(_large_star(state)), "links")
    else:
        raise RuntimeError(f"no fixpoint after {MOST_ROUNDS} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
