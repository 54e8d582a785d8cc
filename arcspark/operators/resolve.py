"""Transitive dependencies, and the comparison of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def transitive(direct: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(root, coord, depth): everything reachable from a root's direct dependencies, at its least depth.

    direct (root, coord) is depth 0 and taken as it is; edges (parent, child) are followed while the depth is
    under max_depth, without children whose version begins with '$'.  One join against the edges for each
    level; a coordinate once found for a root is never expanded again, so cycles end.
    """
    usable = edges.where(F.col("parent").isNotNull() & F.col("child").isNotNull() & ~F.element_at(F.split("child", ":"), -1).startswith("$")).select("parent", "child").distinct()
    frontier = materialize(direct.where("coord is not null").select("root", "coord").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for depth in range(1, max_depth + 1):
        near = frontier.join(usable, F.col("coord") == F.col("parent")).select("root", F.col("child").alias("coord")).distinct()
        frontier = materialize(near.join(seen, ["root", "coord"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(name, metric, current, baseline, drop_pct): each metric that fell below threshold x its baseline."""
    pair = lambda m: F.struct(F.lit(m).alias("metric"), F.col(f"c.{m}").alias("current"), F.col(f"b.{m}").alias("baseline"))
    rows = current.alias("c").join(baseline.alias("b"), "name").select("name", F.explode(F.array(pair("compress_mbs"), pair("decompress_mbs"))).alias("m")).select("name", "m.*")
    return rows.where(F.col("current") < F.col("baseline") * threshold).withColumn("drop_pct", (1 - F.col("current") / F.col("baseline")) * 100)
