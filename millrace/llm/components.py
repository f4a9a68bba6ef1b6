"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v <> m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) for every node of ``links`` (u, v).

    Each round halves the depth of the trees; the links of a round are written
    to the shared folder, so no plan grows and a lost executor costs one round.
    Self-links and nulls are dropped (a node with self-links alone isn't listed).
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(edges)), "links")
        found = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        edges = after
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.union(edges.select("v", "v").distinct())
