"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parlance.llm._common import cut, keyed_join


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (id, component) for the vertices of edges (a, b): the smallest id that each can reach.

    Alternates two kinds of star: every vertex's larger neighbours, and then its smaller
    ones, are tied to its smallest neighbour.  Both work on edges alone and sums per
    vertex, so a vertex of any degree needs no list of its neighbours, and the edges of
    vertices with very many are joined apart.  Each round's edges are cut by a checkpoint;
    only their count and a checksum reach the driver.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Large star: from each vertex, neighbours that are larger go to the smallest of its neighbours and itself.
        large = keyed_join(both.where("v > u"), least, ["u"], 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: neighbours that are not larger, and the vertex itself, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = keyed_join(large, low, ["u"], 2 * before[0])
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
