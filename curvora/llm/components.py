"""Connected components by alternating large-star and small-star rounds.

Edges stay in a distributed table; each round is a grouped minimum (pre-aggregated, so that a node with very many
neighbours is no hot group) and a join of that small result to the edges.  The grouped minimum is written before it is
joined, which leaves both sides of the join to Spark's skew handling and cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct."""
    pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "cc-least", small=True)
    least = least.select(F.col("u").alias("lu"), F.least("m", "u").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["lu"])
    if large:  # every larger neighbour of u is tied to the least one around u
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours are tied to the least one
        out = joined.select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("lu").alias("u"), F.col("m").alias("v")))
    return materialise(out.where("u != v").distinct(), "cc-edges", small=True)


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges: two long columns src and dst.  Returns (node, component) of every node with an edge to another one.

    The component is its least node.  Loops, nulls, repeated edges and either direction are allowed; no edges, no rows.
    With ``rounds`` the work may end early: nodes of one component value are still connected, but a component may have
    several values.  The result's rows, taken as edges, lead on to the full answer.
    """
    clean = edges.where("src is not null and dst is not null and src != dst")
    edges = materialise(clean.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc-edges", small=True)
    if is_empty(edges):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before, done = state(edges), 0
    while rounds is None or done < rounds:
        wide = _star(edges, large=True)
        after_small = _star(wide, large=False)
        release(edges, wide)
        edges, done = after_small, done + 1
        now = state(after_small)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
