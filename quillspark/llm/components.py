"""Connected components of a graph whose edges are spread over the cluster.

Alternating large-star and small-star rounds (Kiveris et al., 2014).  Each round is two joins on the smallest neighbour; tables
between rounds are written to the shared folder, so that lineage stays short and executors may be lost.  Only a count and a
checksum of the edges come to the driver.  A node with more than one in ``HOT`` of all edges is joined by broadcast: the hub of a large
component is no single task.

Null ends are no edges; loops and repeated edges change nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import HOT, join_hot, written


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _joined(pairs: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    # At most 2 * HOT nodes, as each edge has two ends.
    return join_hot(pairs, least.select("u", "m"), "u", least.where(F.col("n") > edges / HOT).select("u"))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    return _joined(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them.  Edges come as u > v."""
    least = _least(edges)
    return _joined(edges, least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long; any direction, repeats and loops allowed) to (node, root): root is the smallest node of the component.
    Nodes without an edge to another are left out."""
    state = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = written(spark, state, f"{label}-edges")
    before = None
    for _ in range(most_rounds):
        sign = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or tuple(sign) == before:
            break
        before = tuple(sign)
        large = written(spark, large_star(state, sign["n"]), f"{label}-round")
        state = written(spark, small_star(large, sign["n"]), f"{label}-round")
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
