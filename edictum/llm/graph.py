"""Connected components of an edge table, without gathering anything on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictum.llm.common import done_with, handed_on, saved, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node with an edge to a smaller one has that edge only: all components are stars then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return nodes.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("least") == 0))).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node of ``edges`` (columns u, v; u <> v) that isn't the least of its
    component, with that least node.

    Alternating large-star and small-star rounds until only stars are left; each round's edges
    are written to the shared folder, so lineage stays short, and those of the round before are
    deleted.
    """
    with scratch(edges.sparkSession):
        now = saved(edges.select("u", "v").where("u <> v"), "edges")
        for _ in range(most_rounds):
            before, now = now, saved(_small_star(_large_star(now)), "edges")
            done_with(before)
            if _is_forest(now):
                return handed_on(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
