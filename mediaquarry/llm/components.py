"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MAX_ROUNDS = 60
#: Edges of one node that go to one task together.
HUB = 100_000


def with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with what least says of u (m; n, its edges). The edges of a hub are dealt to several tasks by v; where there are fewer edges than make a hub, there is none."""
    if total <= HUB:
        return edges.join(least, "u").drop("n")
    # At most a row for each HUB edges.
    hubs = F.broadcast(least.where(F.col("n") > HUB).select("u", F.ceil(F.col("n") / HUB).cast("int").alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1))
    dealt = edges.join(hubs, "u", "left").withColumn("_chunk", F.pmod(F.xxhash64("v"), chunks).cast("int")).drop("_chunks")
    copied = least.join(hubs, "u", "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_chunks", "n")
    return dealt.join(copied, ["u", "_chunk"]).drop("_chunk")


def stars(edges: DataFrame) -> DataFrame:
    """From edges (u, v; any order, repeats allowed) the pairs (node, component), component the smallest node that links reach, for all nodes but those smallest ones.

    Null ends and loops don't count. No round gathers a node's neighbours: a round keeps, for each node, only the minimum, and
    sends it along a hub's edges in several tasks.
    """
    now = checkpointed(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both, least, 2 * state.n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, lowest, 2 * state.n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
