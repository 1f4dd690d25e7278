"""Folds along time whose groups may be of any size: each group is cut into blocks that many tasks work on.

A block's effect on the state that comes in is small enough to be put together by one task for a group: a weighted sum for
averages, a step function for thinning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import tables

#: Rows of a block of averages; spans of time of a block of thinned times, in least distances.
BLOCK_ROWS, BLOCK_SPANS = 10_000, 1000


def smoothed(samples: DataFrame, by: str, weight: float = 0.3, block: int = BLOCK_ROWS) -> DataFrame:
    """The moving average e = (1 - weight) e + weight x of each group (rows by, t, event_id, x) along t and event_id, seeded by the first x.

    The last average is a sum of all x with weights that fall by 1 - weight at each step. Rows are numbered by ranges, and
    blocks of them summed relative to their last row, groups relative to their last block.
    """
    keep = 1 - weight
    # Groups follow one another, so that numbers within a group go up by one.
    rows = tables.numbered(samples.select(by, "t", "event_id", "x"), [F.col(by), F.col("t"), F.col("event_id")], "_number").withColumn("_block", F.expr(f"_number div {block}"))
    top = F.max("_number").over(W.partitionBy(by, "_block"))
    sums = rows.withColumn("_top", top).groupBy(by, "_block", "_top").agg(F.sum(weight * F.pow(F.lit(keep), F.col("_top") - F.col("_number")) * F.col("x")).alias("_sum"), F.min(F.struct("_number", "x")).alias("_first"))
    ends = sums.groupBy(by).agg(F.max("_top").alias("_end"), F.min("_first").alias("_first"))
    whole = sums.drop("_first").join(ends, by).groupBy(by, "_end", "_first").agg(F.sum(F.col("_sum") * F.pow(F.lit(keep), F.col("_end") - F.col("_top"))).alias("_sum"))
    # The first x counts in full: weight of it is in the sum, the rest comes here.
    return whole.select(by, (F.col("_sum") + F.pow(F.lit(keep), F.col("_end") - F.col("_first._number") + 1) * F.col("_first.x")).alias("rate"))


def _next(t: np.ndarray, least: int) -> np.ndarray:
    """For each of sorted times the place of the first that is far enough on."""
    return np.searchsorted(t, t + least, "left")


def thinned(frames: DataFrame, by: str, least_ms: int = 3000, spans: int = BLOCK_SPANS) -> DataFrame:
    """Frames (by, t) at least least_ms after the last one kept, the first of each group included.

    Blocks are spans of time. Which times of a block are kept follows from the first one, and that from the last one kept
    before: each block tells for every time that may come first which would be kept last (equal answers are one step, and
    they soon are), one task a group goes along the blocks' steps, and the blocks keep theirs.
    """
    width = least_ms * spans
    times = tables.stored(frames.where(F.col("t").isNotNull()).select(by, F.col("t").cast("long").alias("t")).distinct().withColumn("_block", F.floor(F.col("t") / width)), "thinned")
    kind = times.schema[by].dataType.simpleString()

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf.t.to_numpy())
        following, last = _next(t, least_ms), t.copy()
        for i in range(len(t) - 1, -1, -1):
            if following[i] < len(t):
                last[i] = last[following[i]]
        # A time kept before is less than the block's first, so the first kept here is less than least_ms after that one, or the next.
        n = min(int(np.searchsorted(t, t[0] + least_ms, "left")) + 1, len(t))
        ends = np.append(np.flatnonzero(last[: n - 1] != last[1:n]), n - 1)
        return pd.DataFrame({by: pdf[by].iloc[0], "_block": pdf._block.iloc[0], "upto": t[ends], "last": last[ends]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_block", "upto"])
        out, before = [], None
        for block, part in pdf.groupby("_block", sort=False):
            out.append((block, before))
            upto, last = part.upto.to_numpy(), part["last"].to_numpy()
            i = 0 if before is None else int(np.searchsorted(upto, before + least_ms, "left"))
            if i < len(upto):  # else the block keeps nothing
                before = int(last[i])
        return pd.DataFrame({by: pdf[by].iloc[0], "_block": [b for b, _ in out], "before": pd.array([x for _, x in out], "Int64")})

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf.t.to_numpy())
        before = pdf.before.iloc[0]
        i = 0 if pd.isna(before) else int(np.searchsorted(t, int(before) + least_ms, "left"))
        following, out = _next(t, least_ms), []
        while i < len(t):
            out.append(t[i])
            i = following[i]
        return pd.DataFrame({by: pdf[by].iloc[0], "t": np.array(out, np.int64)})

    stepped = times.groupBy(by, "_block").applyInPandas(steps, f"`{by}` {kind}, _block long, upto long, last long")
    entered = stepped.groupBy(by).applyInPandas(along, f"`{by}` {kind}, _block long, before long")
    return times.join(entered, [by, "_block"]).groupBy(by, "_block").applyInPandas(kept, f"`{by}` {kind}, t long")


def saved_positions(reports: DataFrame, moved_sec: float = 5.0) -> DataFrame:
    """Of a player's reports (key, at, sec, forced) those that are written: forced, or that far from the last one written (0 at first), by at, sec and forced.

    A key's reports are read in order, as they come; what a task holds is the last position.
    """
    rows = reports.select("key", "at", "sec", "forced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, begun = None, 0.0, False
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (k, sec, forced) in enumerate(zip(batch.column("key").to_pylist(), batch.column("sec").to_pylist(), batch.column("forced").to_pylist(), strict=True)):
                if not begun or k != key:
                    key, last, begun = k, 0.0, True
                if forced or (sec is not None and abs(sec - last) >= moved_sec):
                    keep[i], last = True, sec if sec is not None else last
            yield batch.filter(pa.array(keep)).select(["key", "at", "sec"])

    return rows.repartition("key").sortWithinPartitions("key", "at", "sec", "forced").mapInArrow(run, T.StructType([rows.schema[c] for c in ("key", "at", "sec")]))
