"""Approximate nearest neighbours: shifted space-filling curves.

CURVES times, the vectors are projected at random to DIMS dimensions, put on a grid of equal shares (quantiles of at most
about SAMPLE rows; every row is indexed), shifted at random and ordered by their place on a Hilbert curve. Spark
range-partitions each ordering and numbers its rows; consecutive rows form cells, and a query meets the cells within
reach of its own. Each meeting keeps a query's best, the windows of all curves are merged, and the ranking is by
the inner product of the original vectors in double precision, summed from the first number to the last.

How many curves are used and how wide their windows are is measured on each table, whatever its size: a blocked scan of
all rows finds the true nearest of about PROBES queries, and of the choices that hold HOLD of those the one that sends
and compares the fewest rows is taken. Where vectors have structure, windows of some dozen rows do. Among vectors without any, in 64
dimensions, the nearest 20 stand out so little that a recall of 0.9 asks for windows of a large part of the table; they
are then that wide (figures: README). Equal vectors are one class, of which the TOP + 1 smallest ids are kept, since no
query can use more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers and rows without vec_id take no part,
neither as queries nor as candidates; vectors of different lengths don't meet; equal scores go by vec_id, and a score
that isn't a number (sums of infinities) counts as the lowest; a query's own row is no candidate, other rows with its
vec_id are, equal or not; with fewer than TOP candidates a query gets all; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cap_filters import usable
from .common import by_groups, checkpointed, flat, numbered, stored

TOP = 20
CURVES = 16
DIMS = 10
BITS = 6
#: Bound of the rows that the grids are fitted on.
SAMPLE = 8192
#: Queries that a scan answers to set the windows, and the share of their nearest that these must hold (0.9 and a margin for the draw).
PROBES, HOLD = 256, 0.93
#: Numbers of curves that are tried.
TRIED = (4, 8, 16)
#: Queries of a cell that are scored at the same time.
QUERIES_AT_ONCE = 1024
#: Rows of a cell.
LEAST_CELL, MOST_CELL = 16, 1024
SEED = 31

Grids = dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def hilbert_place(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows x dims, each under 2^bits): Gray-code rotations undone from the top bit, then bits interleaved."""
    axes = [np.array(c, np.int64) for c in grid.T]
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for c in axes:
            inverted = (c & half) != 0
            swapped = np.where(inverted, 0, (axes[0] ^ c) & low)
            axes[0] ^= np.where(inverted, low, swapped)
            if c is not axes[0]:
                c ^= swapped
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    flips = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(axes[-1] >> level & 1, (1 << level) - 1, 0)
    place = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for c in axes:
            place = place << 1 | (c ^ flips) >> level & 1
    return place


@lru_cache(maxsize=64)
def projection(dimension: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """A random projection to DIMS and a shift in [0, 1)."""
    rng = np.random.default_rng([SEED, curve, dimension])
    basis = np.linalg.qr(rng.normal(size=(dimension, min(DIMS, dimension))))[0]
    return basis, rng.random(basis.shape[1])


def fitted_grids(sample: dict[int, np.ndarray]) -> dict[int, list[np.ndarray]]:
    """For each length of vectors and each curve, quantiles of the projected numbers."""
    at = np.linspace(0, 1, 129)
    return {dim: [np.quantile(x @ projection(dim, c)[0], at, axis=0) for c in range(CURVES)] for dim, x in sample.items()}


def places(vectors: np.ndarray, grids: list[np.ndarray], curve: int) -> np.ndarray:
    basis, shift = projection(vectors.shape[1], curve)
    projected = vectors @ basis
    share = np.stack([np.interp(projected[:, d], grids[curve][:, d], np.linspace(0, 1, len(grids[curve]))) for d in range(projected.shape[1])], axis=1)
    grid = ((share + shift) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_place(np.clip(grid, 0, (1 << BITS) - 1), BITS)


def met(table: pa.Table, cuts: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    """Of each cell: for each query that reaches it, its best candidates there, equals included, and their scores."""
    rep, low, is_query = (np.asarray(table.column(x)) for x in ("rep", "low", "is_query"))
    numbers, ends = flat(table, "embedding")
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        x, asks = numbers[ends[a] : ends[b]].reshape(b - a, -1).astype(np.float64), is_query[a:b]
        candidates = x[~asks]
        if not len(candidates):
            continue
        for at in range(0, int(asks.sum()), QUERIES_AT_ONCE):
            queries = x[asks][at : at + QUERIES_AT_ONCE]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = queries @ candidates.T
                scores[np.isnan(scores)] = -np.inf
                k = min(top, scores.shape[1])
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
                q, c = np.nonzero(scores >= np.where(np.isfinite(least), least - 1e-9 * np.maximum(1, np.abs(least)), least))
                exact = np.zeros(len(q))
                for d in range(x.shape[1]):
                    exact += queries[q, d] * candidates[c, d]
                exact[np.isnan(exact)] = -np.inf
            out.append((rep[a:b][asks][at + q], rep[a:b][~asks][c], low[a:b][~asks][c], exact))
    columns = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["query", "rep", "low", "score"])


def scanned(classes: DataFrame, probes: dict[int, tuple[np.ndarray, np.ndarray]], top: int) -> DataFrame:
    """The true nearest classes of the probes (by length: rep, embedding), themselves left out: query, rep; each task keeps its best."""
    sent = classes.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: (np.zeros((len(reps), 0), np.int64), np.zeros((len(reps), 0))) for dim, (reps, _) in sent.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = np.asarray(batch.column("dim"))
                for dim, (reps, asked) in sent.value.items():
                    rows = batch.filter(pa.array(dims == dim))
                    if not len(rows):
                        continue
                    ids = np.asarray(rows.column("rep"))
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = asked @ np.asarray(rows.column("embedding").flatten(), np.float64).reshape(len(rows), -1).T
                    scores[np.isnan(scores)] = -np.inf
                    scores[reps[:, None] == ids] = -np.inf
                    held, numbers = best[dim]
                    held, numbers = np.hstack([held, np.broadcast_to(ids, scores.shape)]), np.hstack([numbers, scores])
                    keep = np.argpartition(-numbers, min(top, numbers.shape[1]) - 1, axis=1)[:, :top]
                    best[dim] = np.take_along_axis(held, keep, 1), np.take_along_axis(numbers, keep, 1)
        for dim, (held, numbers) in best.items():
            q, k = np.nonzero(numbers > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[dim][0][q]), pa.array(held[q, k]), pa.array(numbers[q, k])], names=["query", "rep", "score"])

    found = classes.select("rep", "dim", "embedding").mapInArrow(run, "query long, rep long, score double")
    return found.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("_n") <= top).select("query", "rep")


def distances(placed: DataFrame, truth: DataFrame) -> np.ndarray:
    """For each pair (query, rep) of truth, a bounded number, how many rows they are apart on each curve: pairs x CURVES."""
    truth = F.broadcast(checkpointed(truth))
    asked = placed.join(F.broadcast(truth.select("query").distinct()), F.col("rep") == F.col("query")).select("query", "dim", "curve", F.col("number").alias("_from"))
    pairs = placed.select("dim", "curve", "rep", "number").join(truth, "rep").join(asked, ["query", "dim", "curve"])
    apart = pairs.groupBy("query", "rep").agg(F.sort_array(F.collect_list(F.struct("curve", F.abs(F.col("number") - F.col("_from")).alias("n")))).alias("x"))
    found = [[y.n for y in r.x] for r in apart.collect()]
    return np.array(found, np.int64).reshape(len(found), CURVES)


class Windows(NamedTuple):
    curves: int
    cell: int  # rows
    reach: int  # cells on either side of a query's own

    @property
    def rows(self) -> int:
        return (2 * self.reach + 1) * self.cell * self.curves


def chosen_windows(apart: np.ndarray, n: int, n_queries: int, hold: float = HOLD) -> Windows:
    """Of the windows that hold a share of the pairs, those for which the fewest rows are sent and, at half the weight, compared."""
    choices = []
    for curves in TRIED:
        nearest = np.sort(apart[:, :curves].min(axis=1))
        half = max(1, int(nearest[min(len(nearest) - 1, math.ceil(hold * len(nearest)) - 1)])) if len(nearest) else 1
        cell = min(MOST_CELL, max(LEAST_CELL, -(-half // 2)))
        made = Windows(curves, cell, -(-half // cell))
        choices.append((curves * (n + n_queries * (2 * made.reach + 1)) + made.rows * n_queries / 2, made))
    return min(choices)[1]


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """For each row of vectors (vec_id, embedding) where is_query holds: query_id, rank from 1, vec_id, score of its nearest found."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(SEED), "embedding"), "dim": F.size("embedding")})
    same = ["k1", "k2", "dim"]
    first = good.withColumn("_n", F.row_number().over(W.partitionBy(*same).orderBy("vec_id"))).where(F.col("_n") <= top + 1)
    asked = good.groupBy(*same).agg(F.max("asks").alias("asks"))
    members = first.groupBy(*same).agg(F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("embedding").alias("embedding"))
    # rep numbers the classes: an id may stand for several vectors.
    classes, _ = stored(members.join(asked, same).withColumns({"rep": F.monotonically_increasing_id(), "low": F.col("members")[0]}), "curve-classes")

    n, n_asked = classes.agg(F.count("*"), F.count_if("asks")).first()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "k1"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 20))
    sample: dict[int, list[np.ndarray]] = {}
    for r in classes.where(draw).select("embedding").limit(2 * SAMPLE).toLocalIterator():
        sample.setdefault(len(r.embedding), []).append(np.array(r.embedding, np.float64))
    grids = fitted_grids({dim: np.stack(x) for dim, x in sample.items()})
    grids_sent = spark.sparkContext.broadcast(grids)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                dims = np.asarray(batch.column("dim"))
                for dim in np.unique(dims):
                    rows = batch.filter(pa.array(dims == dim))
                    x = np.asarray(rows.column("embedding").flatten(), np.float64).reshape(len(rows), -1)
                    fitted = grids_sent.value.get(int(dim)) or fitted_grids({int(dim): np.eye(int(dim))})[int(dim)]
                    for c in range(CURVES):
                        yield pa.RecordBatch.from_arrays([pa.array([f"{dim}/{c}"] * len(rows)), rows.column("dim"), pa.array([c] * len(rows), pa.int32()), pa.array(places(x, fitted, c)), rows.column("rep"), rows.column("asks")], names=["line", "dim", "curve", "place", "rep", "asks"])

    lines = classes.select("rep", "dim", "asks", "embedding").mapInArrow(orders, "line string, dim int, curve int, place long, rep long, asks boolean")
    placed = numbered(lines, "line", "place", "rep")
    chance = F.pmod(F.xxhash64(F.lit(SEED + 1), "k1"), F.lit(1 << 30)) < int(min(1.0, PROBES / max(1, n_asked)) * (1 << 30))
    drawn: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in classes.where("asks").where(chance).select("rep", "embedding").limit(2 * PROBES).toLocalIterator():
        drawn.setdefault(len(r.embedding), []).append((r.rep, np.array(r.embedding, np.float64)))
    probes = {dim: (np.array([v for v, _ in x]), np.stack([y for _, y in x])) for dim, x in drawn.items()}
    apart = distances(placed, scanned(classes, probes, top)) if probes else np.empty((0, CURVES), np.int64)
    windows = chosen_windows(apart, n, n_asked)

    cells = placed.where(F.col("curve") < windows.curves).select("dim", "curve", "rep", "asks", F.expr(f"number div {windows.cell}").alias("cell"))
    asking = cells.where("asks").select("dim", "curve", "rep", F.explode(F.sequence(F.col("cell") - windows.reach, F.col("cell") + windows.reach)).alias("cell"), F.lit(True).alias("is_query"))
    meetings = cells.select("dim", "curve", "rep", "cell", F.lit(False).alias("is_query")).unionByName(asking).join(classes.select("rep", "low", "embedding"), "rep")
    found = by_groups(meetings, ["dim", "curve", "cell"], lambda table, cuts: met(table, cuts, top + 1), "query long, rep long, low long, score double")

    merged = found.groupBy("query", "rep").agg(F.max("score").alias("score"), F.first("low").alias("low"))
    best = merged.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "low"))).where(F.col("_n") <= top + 1).drop("_n")
    by_score = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "rep")
    listed = best.join(classes.select("rep", F.explode("members").alias("vec_id")), "rep").withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= top + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score", "rep"))).alias("best"))
    by_class = lists.join(classes.select(F.col("rep").alias("query"), *same), "query")
    answers = good.where("asks").select(F.col("vec_id").alias("query_id"), *same).join(by_class, same)
    own = F.array_position(F.transform("best", lambda x: (x["rep"] == F.col("query")) & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("best", lambda x, i: i + 1 != own), 1, top)
    return answers.select("query_id", F.posexplode(others).alias("_at", "x")).select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
