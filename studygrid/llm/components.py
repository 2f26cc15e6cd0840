"""Connected components of a link table by alternating large and small stars.

Every round is two grouped minima and two equi-joins. The minima combine on the
map side, and a node with very many links only makes one side of a join large,
which adaptive execution splits. Links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(links: DataFrame):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(src, dst)`` longs -> ``(node, root)`` with root the least node reachable.

    Only nodes that have a link other than to themselves are returned; null ends
    are ignored, repeated and mirrored links count once.
    """
    edges = (
        links.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    edges = materialize(edges, "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every greater neighbour is hung on the least one.
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the node and its smaller neighbours are hung on the least of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
