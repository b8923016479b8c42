"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerframe.operators.scale import join_groups
from ledgerframe.session import forget, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round links the neighbours of a node to the smallest node around it, first the larger neighbours, then
    the smaller ones, until no edge moves; rounds grow with the logarithm of a component's size. The smallest
    neighbour comes from an aggregate, and the edges of a node with very many of them meet it where they lie, so no
    task has to take all edges of a hub. Each round is a written table. Null ends and loops are ignored; no edges give
    no rows.
    """
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct(),
        "components",
    )
    before = _digest(now)
    while before[0]:
        edges = before[0]
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both, least, "u", "n", 2 * edges).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_groups(large, least, "u", "n", edges).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "components")
        after = _digest(following)
        forget(large)
        forget(now)
        now = following
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1_000_003)))).first()
    return tuple(row)
