"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize

#: Rounds at most; the number needed grows with the square of a logarithm of the largest component.
ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Nodes are of any ordered type. Each round is written to the shared folder; the driver gets a
    count and a checksum of it only. Null ends and loops are left out. No links give no rows.
    """
    edges = materialize(links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "links")
    seen = None
    for _ in range(ROUNDS):
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen or not mark["n"]:
            break
        seen = (mark["n"], mark["h"])
        last, edges = edges, materialize(_small_star(_large_star(edges)), "stars")
        discard(last)
    else:
        raise RuntimeError(f"components not settled after {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
