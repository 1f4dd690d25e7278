"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in the order of a seeded hash, form blocks of BLOCK rows. With integer weights w that add up to the
period Q, block j of a source may take a slot from its release floor(j Q / w) on and must have one by its deadline
ceil((j + 1) Q / w). In each slot, earliest-deadline-first takes the released block whose deadline comes first; for unit
blocks on one line that meets every deadline, so at every slot each source is less than one block from its weight's
share. The schedule repeats after Q slots: one period, at most MAX_PERIOD rows, is made on the driver and broadcast, and
every row finds its slot by arithmetic. Once a source has no block left its slots stay empty (in_horizon is false from the
first such slot on) and all other rows keep their order: no row is dropped or repeated.

Rows are numbered within sources by range partitions and their counts, so a source with most of the rows spreads over many
tasks.

Defined cases: a null source is a source of its own; repeated rows each take a place; an empty table gives an empty result;
other columns are kept, whatever their names (columns named like the result's are replaced). At most MAX_PERIOD sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered

BLOCK = 16
PERIOD = 1000
MAX_PERIOD = 20_000
#: Without given weights, a source of n rows weighs n to this power.
TEMPER = 0.7

PLACED = ("block", "release", "deadline", "slot", "place", "in_horizon")


def integer_weights(targets: Mapping[str | None, float]) -> dict[str | None, int]:
    """Weights of at least 1 that add up to the period, by largest remainders."""
    names = sorted((k for k, v in targets.items() if v > 0), key=lambda k: (k is not None, k or ""))
    if len(names) > MAX_PERIOD:
        raise ValueError(f"at most {MAX_PERIOD} sources can be mixed")
    period = max(PERIOD, min(MAX_PERIOD, 4 * len(names))) if names else 0
    total = sum(targets[k] for k in names)
    exact = {k: targets[k] / total * (period - len(names)) for k in names}
    out = {k: 1 + int(exact[k]) for k in names}
    for k in sorted(names, key=lambda k: (int(exact[k]) - exact[k], names.index(k)))[: period - sum(out.values())]:
        out[k] += 1
    return out


def schedule(weights: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """One period by slot: (source, its block, release, deadline, slot)."""
    period = sum(weights.values())
    names = list(weights)
    releases: dict[int, list[tuple[int, int, int]]] = {}
    for i, name in enumerate(names):
        w = weights[name]
        for j in range(w):
            releases.setdefault(j * period // w, []).append((-(-(j + 1) * period // w), i, j))
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        for job in releases.get(slot, ()):
            heapq.heappush(ready, job)
        deadline, i, j = heapq.heappop(ready)
        out.append((names[i], j, j * period // weights[names[i]], deadline, slot))
    return out


def mix(docs: DataFrame, targets: Mapping[str | None, float] | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, ...) with block, release, deadline, slot, place in the block and in_horizon; the order of the mix is by slot and place."""
    spark = docs.sparkSession
    rows = docs.drop(*PLACED)
    counts = {r.source: r.n for r in rows.groupBy("source").agg(F.count("*").alias("n")).limit(MAX_PERIOD + 1).collect()}
    targets = {k: v for k, v in targets.items() if k in counts} if targets else {k: n**TEMPER for k, n in counts.items()}
    targets |= {k: min(targets.values(), default=1.0) for k in counts if targets.get(k, 0) <= 0}  # a source that isn't named still keeps its rows
    weights = integer_weights(targets)
    period = sum(weights.values())
    plan = schedule(weights)
    slot_of = {(name, j): slot for name, j, _, _, slot in plan}
    horizon = min((-(-n // block) // weights[k] * period + slot_of[k, -(-n // block) % weights[k]] for k, n in counts.items()), default=0)

    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_j", T.LongType()), T.StructField("_release", T.LongType()), T.StructField("_deadline", T.LongType()), T.StructField("_slot", T.LongType()), T.StructField("_w", T.LongType())])
    table = spark.createDataFrame([(*x, weights[x[0]]) for x in plan], schema)
    ones = table.select(F.col("_source").alias("_s"), F.col("_w").alias("_weight")).distinct()

    packed = rows.select("doc_id", "source", F.struct(*rows.columns).alias("_row"))  # whatever the columns' names
    ordered = numbered(packed.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")), "source", "_h", "doc_id")
    blocks = ordered.join(F.broadcast(ones), F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.expr(f"number div {block}"))
    turn = F.expr("block div _weight") * period
    placed = blocks.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") % F.col("_weight") == F.col("_j")))
    return placed.select(
        "_row.*", "block", (turn + F.col("_release")).alias("release"), (turn + F.col("_deadline")).alias("deadline"),
        (turn + F.col("_slot")).alias("slot"), (F.col("number") % block).alias("place"), (turn + F.col("_slot") < horizon).alias("in_horizon"),
    )


def in_mixed_order(docs: DataFrame, targets: Mapping[str | None, float] | None = None) -> DataFrame:
    """The rows and columns of docs, range-partitioned and sorted in the order of the mix: written files keep it, part by part."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_all"))
    return mix(packed, targets).repartitionByRange(parts, "slot", "place").sortWithinPartitions("slot", "place").select("_all.*")
