"""Connected components of an edge table, without gathering any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytefacts.llm.common import cut


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge are left out.

    Large-star and small-star steps in turn until the edges are a forest of stars. Each
    step is a partial aggregate for each node's smallest neighbour and a join, so a node with
    very many neighbours is never gathered; each round is cut by a checkpoint. Null or equal
    ends are ignored, repeated edges count once, an empty table gives an empty one.
    """
    a, b = F.col("a"), F.col("b")
    e = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of u goes to the smallest of u's neighbours and u
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(a).agg(F.least(a, F.min(b)).alias("m"))
        large = both.where(b > a).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        # small star: u and every smaller neighbour of u go to the smallest of them
        low = large.groupBy(a).agg(F.min(b).alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = cut(small.where(a != b).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _state(e: DataFrame) -> tuple:
    """Edges and a sum over them; equal before and after a round only if nothing moved."""
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
