"""Connected components on DataFrames by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two joins of the edges with one
row for each node; its result is a table in the shared folder. Nothing is collected but one
row of counts for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars_done(edges: DataFrame) -> bool:
    """Whether every node hangs below one root that hangs below none."""
    counts = (
        edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        .union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        .groupBy("x")
        .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    )
    return counts.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Null ends and edges from a node to itself are ignored, repeated edges count once, and no
    edges give no rows. Nodes can be of any type that can be ordered.
    """
    x, y = F.col(a), F.col(b)
    stars = written(
        edges.where(x != y)
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct(),
        "components",
    )
    for _ in range(rounds):
        if _stars_done(stars):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select("v", "v").distinct()
            )
        both = stars.union(stars.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        stars = written(
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", "m"))
            .distinct(),
            "components",
        )
    raise RuntimeError(f"no stars after {rounds} rounds")
