"""Embedding near-dedup: spherical-cap filters from random product codes, a join on filters, and a check of each pair.

A code rotates vectors at random, cuts them into blocks and has a book of random directions for each block; a filter is
a tuple with one direction from each book, and its score for a vector is the sum of the blocks' inner products. A vector
exceeds a filter if that is at least the cap's height; list decoding finds all filters that it exceeds, book by book,
dropping what can't reach the height any more. Books grow with the table, so that a filter holds few rows, and the height
follows so that a random vector exceeds LIST filters on average. The number of codes is set by what pairs at the
threshold need: for random ones of the same dimension, against these very books, the share that one code misses is
measured, and as many codes are used as leave under 1 - RECALL of them (a pair's chance depends on its angle alone, since
rotations and directions are drawn without one that is favoured). Rows with the same label meet where they share a
filter: first with vectors rounded to bytes, which rule out nearly all that don't link and none that do; what is left is
checked by its cosine in double precision, so nothing below the threshold is linked.

Equal vectors of a label are one class from the start. A pair of classes counts in the first filter that both have, so
links are counted without writing pairs; for reaching, each group of a filter gives only a star for each of its
components. Groups over GROUP rows are cut into pairs of chunks, each a task's work of bounded size.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null label or
vec_id, link with nothing (n_links 0, component_id = vec_id, kept true); vectors of different lengths don't link; repeated
rows are copies of one another; rows that share a vec_id with different vectors are classes of their own; an empty table gives an empty result; other columns play no part.
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

from .common import by_groups, discard, flat, stored
from .components import stars

THRESHOLD = 0.93
#: Filters that a random vector exceeds in one code, on average.
LIST = 8
RECALL = 0.999
#: Filters in a code for each class of vectors, and bounds of a book's directions.
PER_CLASS, LEAST_BOOK, MOST_BOOK = 8, 64, 4096
MOST_CODES = 20
#: Random vectors that the height, and pairs that the number of codes is measured on.
DRAWN, PAIRS = 256, 4000
GROUP = 512
SEED = 20

COUNTED = "rep long, links long, parent long"
LISTED = "rep long, label string, dim int, filters array<long>, short binary, scale double, slack double"
#: Where a class meets others.
PLACED = ["label", "dim", "filter", "c1", "c2", "chunk", "rep"]


class Shape(NamedTuple):
    """What makes a code: the dimension, its blocks and the directions in each book."""

    dimension: int
    blocks: int
    directions: int


def shape_for(dimension: int, classes: int) -> Shape:
    """Blocks have eight numbers at least; there are two, or more where books of MOST_BOOK directions would be too few."""
    most, wanted = max(1, dimension // 8), PER_CLASS * max(1, classes)
    blocks = min(most, max(2, math.ceil(math.log(wanted) / math.log(MOST_BOOK))))
    return Shape(dimension, blocks, max(LEAST_BOOK, min(MOST_BOOK, math.ceil(wanted ** (1 / blocks)))))


def usable(embedding: Column) -> Column:
    """Neither null nor empty nor zero, with finite numbers only."""
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=32)
def code(shape: Shape, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of the padded space and the books of unit directions (in one dimension there are but two)."""
    part = -(-shape.dimension // shape.blocks)
    rng = np.random.default_rng([SEED, seed, shape.dimension])
    rotation = np.linalg.qr(rng.normal(size=(part * shape.blocks, part * shape.blocks)))[0]
    books = [rng.normal(size=(shape.directions, part)) if part > 1 else np.array([[1.0], [-1.0]]) for _ in range(shape.blocks)]
    return rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in books]


def scores_of(vectors: np.ndarray, shape: Shape, seed: int) -> list[np.ndarray]:
    """By block, the inner products of vectors (rows) and directions."""
    rotation, books = code(shape, seed)
    turned = np.pad(vectors, ((0, 0), (0, len(rotation) - shape.dimension))) @ rotation
    return [part @ book.T for part, book in zip(np.split(turned, shape.blocks, axis=1), books)]


def random_units(n: int, dimension: int, seed: int) -> np.ndarray:
    x = np.random.default_rng([SEED, 99, seed]).normal(size=(n, dimension))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(maxsize=32)
def height(shape: Shape) -> float:
    """The caps' height at which DRAWN random vectors exceed LIST filters on average."""
    best = np.zeros((DRAWN, 1))
    for scores in scores_of(random_units(DRAWN, shape.dimension, 0), shape, 0):
        few = min(scores.shape[1], 32 * LIST)
        top = -np.partition(-scores, few - 1, axis=1)[:, :few]
        best = (best[:, :, None] + top[:, None, :]).reshape(DRAWN, -1)
        few = min(best.shape[1], 32 * LIST)
        best = -np.partition(-best, few - 1, axis=1)[:, :few]
    wanted = min(best.size, LIST * DRAWN)
    return float(-np.partition(-best.ravel(), wanted - 1)[wanted - 1])


def exceeded(vectors: np.ndarray, shape: Shape, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters of a code that unit vectors exceed, by row."""
    books, least = scores_of(vectors, shape, seed), height(shape)
    tops = [scores.max(axis=1) for scores in books]
    ahead = np.sum(tops, axis=0)  # the most that the books still to come can add
    row, ids, total = np.arange(len(vectors)), np.full(len(vectors), seed, np.int64), np.zeros(len(vectors))
    for scores, top in zip(books, tops):
        others = np.sum(tops, axis=0) - top
        ahead = ahead - top
        r, d = np.nonzero(scores >= (least - others)[:, None])
        n = np.bincount(r, minlength=len(vectors))
        each = n[row]
        prefix = np.repeat(np.arange(len(row)), each)
        entry = (np.cumsum(n) - n)[row][prefix] + np.arange(len(prefix)) - np.repeat(np.cumsum(each) - each, each)
        more = total[prefix] + scores[r[entry], d[entry]]
        keep = more + ahead[row[prefix]] >= least
        row, ids, total = row[prefix][keep], (ids[prefix] * scores.shape[1] + d[entry])[keep], more[keep]
    return row, ids


def filters_of(vectors: np.ndarray, shape: Shape, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters that unit vectors exceed in all codes, ascending, and where each vector's begin and end."""
    found = [exceeded(vectors, shape, c) for c in range(codes)]
    row, ids = (np.concatenate([f[i] for f in found]) for i in range(2))
    order = np.lexsort((ids, row))
    return ids[order], np.searchsorted(row[order], np.arange(len(vectors) + 1))


@lru_cache(maxsize=32)
def codes_needed(shape: Shape, threshold: float = THRESHOLD) -> int:
    """Codes for pairs at the threshold, by the share of PAIRS random ones that one code misses."""
    missed = 0
    for at in range(0, PAIRS, 500):
        x, y = random_units(500, shape.dimension, at + 1), random_units(500, shape.dimension, at + 2)
        if shape.dimension > 1:
            y -= (x * y).sum(axis=1, keepdims=True) * x
            y = threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * y / np.linalg.norm(y, axis=1, keepdims=True)
        else:
            y = x
        a, b = exceeded(x, shape, 0), exceeded(y, shape, 0)
        met = np.intersect1d(*(np.char.add(np.char.add(row.astype(str), "/"), ids.astype(str)) for row, ids in (a, b)))
        missed += 500 - len({int(m.split("/")[0]) for m in met.tolist()})
    share = min(max(missed, 1), PAIRS - 1) / PAIRS
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(share)))


def fitted(dimension: int, classes: int, threshold: float = THRESHOLD) -> tuple[Shape, int]:
    """The shape for so many classes and its number of codes; books are smaller where pairs at the threshold would need over MOST_CODES, as in few dimensions."""
    shape = shape_for(dimension, classes)
    while shape.directions > LEAST_BOOK and (codes := codes_needed(shape, threshold)) > MOST_CODES:
        smaller = shape._replace(directions=max(LEAST_BOOK, shape.directions // 2))
        if codes_needed(smaller, threshold) >= codes < PAIRS:  # no gain; with more codes than that next to no pair met
            break
        shape = smaller
    return shape, codes_needed(shape, threshold)


def unit_rows(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as unit vectors in double precision."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rounded(units: np.ndarray) -> list[pa.Array]:
    """Unit vectors with a byte for each number: short, the scale of its numbers, and slack, the length of what rounding took."""
    scale = np.abs(units).max(axis=1, keepdims=True) / 127
    short = np.rint(units / scale)
    slack = np.sqrt(((units - short * scale) ** 2).sum(axis=1))
    return [pa.array([x.tobytes() for x in short.astype(np.int8)], pa.binary()), pa.array(scale[:, 0]), pa.array(slack)]


def possible(table: pa.Table, cuts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each filter's group, or pair of its chunks: the rows that may link to another there.

    A cosine differs from that of the rounded vectors by less than e + f + 3ef, e and f their slacks (products of lengths; a rounded
    vector is at most 1 + e long), so no link is lost.
    """
    chunk, dim, scale, slack, c1, c2 = (np.asarray(table.column(x)) for x in ("chunk", "dim", "scale", "slack", "c1", "c2"))
    numbers = np.frombuffer(b"".join(table.column("short").to_pylist()), np.int8)
    ends = np.concatenate(([0], np.cumsum(dim, dtype=np.int64)))
    keep = np.zeros(table.num_rows, bool)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        x = numbers[ends[a] : ends[b]].reshape(b - a, -1).astype(np.float64) * scale[a:b, None]
        e = slack[a:b]
        may = x @ x.T + (e[:, None] + e + 3 * e[:, None] * e) >= threshold - 1e-9
        np.fill_diagonal(may, False)
        if c1[a] != c2[a]:
            may &= chunk[a:b, None] != chunk[None, a:b]
        keep[a:b] = may.any(axis=1)
    yield from table.filter(pa.array(keep)).select(PLACED).combine_chunks().to_batches()


def listed(batches: Iterator[pa.RecordBatch], shapes: dict[int, tuple[Shape, int]]) -> Iterator[pa.RecordBatch]:
    """(rep, label, dim, filters) of classes, and their vectors as rounded."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                ids, ends = filters_of(unit_rows(rows.column("embedding")), *shapes[int(dim)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                shorts = rounded(unit_rows(rows.column("embedding")))
                yield pa.RecordBatch.from_arrays([rows.column("rep"), rows.column("label"), rows.column("dim"), lists, *shorts], names=["rep", "label", "dim", "filters", "short", "scale", "slack"])


def checked(table: pa.Table, cuts: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each filter's group, or pair of its chunks: for each row that links here the copies it links to, and its star."""
    rep, n, chunk, filters, c1, c2 = (np.asarray(table.column(x)) for x in ("rep", "n", "chunk", "filter", "c1", "c2"))
    numbers, ends = flat(table, "embedding")
    lists, list_ends = flat(table, "filters")
    numbers = numbers.astype(np.float64)
    lengths = np.diff(ends)
    numbers /= np.repeat(np.maximum.reduceat(np.abs(numbers), ends[:-1]), lengths)
    numbers /= np.repeat(np.sqrt(np.add.reduceat(numbers * numbers, ends[:-1])), lengths)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        x = numbers[ends[a] : ends[b]].reshape(b - a, -1)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if c1[a] != c2[a]:  # within a chunk, the chunk's own group counts
            linked &= chunk[a:b, None] != chunk[None, a:b]
        if not linked.any():
            continue
        mine = lists[list_ends[a] : list_ends[b]]
        earlier = mine < filters[a]
        once = linked
        if earlier.any():  # pairs that share an earlier filter count there
            owner = np.repeat(np.arange(b - a), np.diff(list_ends[a : b + 1]))
            values, place = np.unique(mine[earlier], return_inverse=True)
            has = np.zeros((b - a, len(values)), np.float32)
            has[owner[earlier], place] = 1
            once = linked & ~(has @ has.T > 0)
        order = np.argsort(rep[a:b], kind="stable")
        low = np.empty(b - a, np.int64)
        low[order] = np.arange(b - a)
        while True:  # the smallest row that links reach, by its rank
            lower = np.minimum(low, np.where(linked, low[None, :], b - a).min(axis=1))
            lower = np.minimum(lower, lower[order[lower]])
            if (lower == low).all():
                break
            low = lower
        some = linked.any(axis=1)
        found.append((rep[a:b][some], (once @ n[a:b])[some], rep[a:b][order[low]][some]))
    columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["rep", "links", "parent"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(SEED), "embedding"), "dim": F.size("embedding")})
    grouped = good.groupBy("label", "k1", "k2", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # rep numbers the classes in the order of their smallest ids: an id may stand for several vectors.
    ordered = grouped.repartitionByRange("low", "k1", "label").sortWithinPartitions("low", "k1", "label")
    classes, at_classes = stored(ordered.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    # A row for each length of vectors.
    codes = {r.dim: fitted(r.dim, r.n, threshold) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    made = classes.select("rep", "label", "dim", "embedding").mapInArrow(lambda batches: listed(batches, codes), LISTED)
    lists, at_lists = stored(made, "filter-lists")
    places = lists.select("rep", "label", "dim", F.explode("filters").alias("filter"))
    sizes = places.groupBy("label", "dim", "filter").agg(F.count("*").alias("size")).where(F.col("size") > 1).withColumn("chunks", F.ceil(F.col("size") / GROUP).cast("int"))
    met = places.join(sizes, ["label", "dim", "filter"]).select("rep", "label", "dim", "filter", "chunks")
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    spread = met.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = spread.select("label", "dim", "filter", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "rep")
    # All filters get rounded vectors; whole ones, and lists, go only where something may link.
    rough = placed.join(lists.select("rep", "short", "scale", "slack"), "rep")
    kinds = "label string, dim int, filter long, c1 int, c2 int, chunk int, rep long"
    keys = ["label", "dim", "filter", "c1", "c2"]
    left = by_groups(rough, keys, lambda table, cuts: possible(table, cuts, threshold), kinds)
    full = classes.select("rep", "n", "embedding").join(lists.select("rep", "filters"), "rep")
    counted, at_links = stored(by_groups(left.join(full, "rep"), keys, lambda table, cuts: checked(table, cuts, threshold), COUNTED), "filter-links")
    discard(spark, at_lists)
    components = stars(counted.select(F.col("rep").alias("u"), F.col("parent").alias("v")))
    links = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    lows = components.join(classes.select(F.col("rep").alias("component"), F.col("low").alias("component_low")), "component").select(F.col("node").alias("rep"), "component_low")
    found = classes.select("label", "k1", "k2", "dim", "rep", "n", "low").join(links, "rep", "left").join(lows, "rep", "left")
    by_class = found.select("label", "k1", "k2", "dim", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    done, _ = stored(by_class, "vector-results")
    discard(spark, at_classes)
    discard(spark, at_links)
    member = good.select("vec_id", "label", "k1", "k2", "dim").join(done, ["label", "k1", "k2", "dim"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
