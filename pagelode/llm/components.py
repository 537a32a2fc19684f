"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .storage import discard, materialize


def _counted(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The written pairs, and their number and sum of digests, taken while they are written."""
    seen = Observation()
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
    written = materialize(pairs.observe(seen, F.count(F.lit(1)).alias("n"), digest), "pairs")
    return written, (seen.get["n"], seen.get["digest"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reached.

    Nodes are non-null longs; loops keep single nodes. Each round is two aggregated
    shuffles and is written to the shared folder; rounds grow with the logarithm of
    the longest path. Minima combine on the map side and the joins split skewed keys,
    so a hub's edges need not meet in one task.
    """
    loops = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
    nodes = loops.distinct()
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, last = _counted(pairs)
    for _ in range(most_rounds):
        # large star: larger neighbours of a node point to the smallest of the node and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours of a node, and the node, point to the smallest of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before, (pairs, state) = pairs, _counted(small)
        discard(before)
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    found = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("least", "component").alias("component"))
