"""Connected components of an undirected graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratamem.session import drop_materialized, materialize


def _minima(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    sym = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.join(_minima(sym), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_minima(down), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its smallest node.

    Alternating large-star and small-star rounds: each is two aggregations with map-side
    combine and joins that adaptive execution can split, so a node with very many
    neighbours never lands in one task as a list. Each round is written to the shared
    folder. Edges with a null end and self-edges are ignored; an empty input gives an
    empty result. Raises if ``max_rounds`` rounds do not settle the components.
    """
    now = materialize(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "cc"
    )
    seen = None
    for _ in range(max_rounds):
        new = materialize(_small_star(_large_star(now)), "cc")
        mark = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_materialized(now)
        now = new
        if mark == seen or not mark["n"]:
            break
        seen = mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
