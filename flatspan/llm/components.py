"""Connected components by alternating star contractions, wholly in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.llm.common import cut_lineage


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of a link, the smallest node that it reaches.

    links: any number of rows, either direction, repeats and self-links allowed; rows with a null end are
    ignored. Each round first joins every larger neighbour to the smallest node seen (large star), then every
    smaller one (small star), until nothing changes. Both group minima are pre-aggregated before their shuffle
    and written out, so that the joins that follow are plain ones on a node, which adaptive execution splits where a
    node is hot.
    Only two numbers a round reach the driver.
    """
    src, dst = F.col("src"), F.col("dst")
    edges = links.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).where(links[a].isNotNull() & links[b].isNotNull() & (links[a] != links[b])).distinct()
    edges = cut_lineage(edges)
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(dst.alias("src"), src.alias("dst")))
        low = cut_lineage(both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")))
        large = both.join(low, "src").where(dst > src).select(dst.alias("src"), F.col("low").alias("dst")).where(src != dst)
        large = large.union(low.where(src != F.col("low")).select("src", F.col("low").alias("dst"))).distinct()
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("src").agg(F.min("dst").alias("low")))
        small = large.join(low, "src").select(dst.alias("src"), F.col("low").alias("dst")).where(src != dst)
        edges = cut_lineage(small.union(low.select("src", F.col("low").alias("dst"))).distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(dst.alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(src.alias("node"), dst.alias("component")).union(tops)


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).first()
    return row["n"], row["x"]
