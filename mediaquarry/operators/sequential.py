"""Operators whose every step depends on the steps before.

Clusters and scenes read rows in order and hold what the next step needs; timelines and boxes are grouped by file or frame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.vectors import SAME_PERSON, l2_unit, unit
from . import faces, tables

SMALLEST, MOST_CLUSTERS = 3, 30


def distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows.astype(np.float64, copy=False) @ one.astype(np.float64))))


def mean_unit(total: np.ndarray, n: int) -> np.ndarray:
    mean = (total / np.float32(n)).astype(np.float32)
    return (mean / np.float32(np.sqrt((mean.astype(np.float64) ** 2).sum()) + 1e-12)).astype(np.float32)


def merged_clusters(totals: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """For each cluster, of a sum and a number of vectors, the first that it ends up in: the first close pair merges into its first, again and again. After a merge only pairs with the moved centre are looked at anew."""
    totals, counts = totals.copy(), counts.copy()
    centres = np.array([mean_unit(t, n) for t, n in zip(totals, counts)])
    owner, alive, a = np.arange(len(counts)), np.ones(len(counts), bool), 0
    while a < len(counts):
        close = a + 1 + np.flatnonzero(alive[a + 1 :] & (distances(centres[a + 1 :], centres[a]) < threshold)) if alive[a] else ()
        if not len(close):
            a += 1
            continue
        b = int(close[0])
        totals[a], counts[a], owner[b], alive[b] = totals[a] + totals[b], counts[a] + counts[b], a, False
        centres[a] = mean_unit(totals[a], int(counts[a]))
        earlier = np.flatnonzero(alive[:a] & (distances(centres[:a], centres[a]) < threshold))
        a = int(earlier[0]) if len(earlier) else a
    while (owner[owner] != owner).any():
        owner = owner[owner]
    return owner


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1)


def joined(rows: DataFrame, order: list[Column], threshold: float, moving: bool) -> DataFrame:
    """rows (file, embedding and others; neither null) with cluster: file by file in order, a row joins the nearest of its file's centres so far, within the threshold, or starts one with the next number.

    Centres move with what joins them, or stay at their first row. A task reads its rows in order and holds the centres of one
    file, not its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        totals = centres = counts = np.empty(0)
        for batch in batches:
            found = np.empty(batch.num_rows, np.int64)
            for i, (file, v) in enumerate(zip(batch.column("file").to_pylist(), vectors_of(batch.column("embedding")) if batch.num_rows else ())):
                if file != now:
                    now, n = file, 0
                    totals, centres, counts = np.empty((16, len(v)), np.float32), np.empty((16, len(v))), np.zeros(16, np.int64)
                d = distances(centres[:n], v)
                k = int(d.argmin()) if n and d.min() < threshold else n
                if k == n:
                    if n == len(counts):  # room for as many again
                        totals, centres, counts = np.concatenate([totals, totals]), np.concatenate([centres, centres]), np.concatenate([counts, counts])
                    totals[k], counts[k], n = v, 1, n + 1
                    centres[k] = mean_unit(v, 1) if moving else v
                elif moving:
                    totals[k], counts[k] = totals[k] + v, counts[k] + 1
                    centres[k] = mean_unit(totals[k], int(counts[k]))
                found[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cluster"])

    return rows.repartition("file").sortWithinPartitions("file", *order).mapInArrow(run, StructType([*rows.schema.fields, StructField("cluster", LongType())]))


def totals_of(rows: DataFrame) -> DataFrame:
    """(file, cluster, n, total): how many vectors each cluster has, and their sum; summed batch by batch before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                file, cluster = np.array(batch.column("file").to_pylist(), object), np.asarray(batch.column("cluster"))
                starts = np.flatnonzero(np.concatenate(([True], (file[1:] != file[:-1]) | (cluster[1:] != cluster[:-1]))))
                sums = np.add.reduceat(vectors_of(batch.column("embedding")).astype(np.float64), starts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("file").take(pa.array(starts)), pa.array(cluster[starts]), pa.array(np.diff(np.append(starts, batch.num_rows))), pa.array(list(sums), pa.list_(pa.float64())),
                ], names=["file", "cluster", "n", "total"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"file": [pdf.file.iloc[0]], "cluster": [pdf.cluster.iloc[0]], "n": [pdf.n.sum()], "total": [np.stack(pdf.total.to_numpy()).sum(axis=0)]})

    schema = f"file {rows.schema['file'].dataType.simpleString()}, cluster long, n long, total array<double>"
    parts = rows.select("file", "cluster", "embedding").sortWithinPartitions("file", "cluster").mapInArrow(run, schema)
    return parts.groupBy("file", "cluster").applyInPandas(summed, schema)


def by_file(df: DataFrame, file: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(file).applyInPandas(work, schema)


def clustered(found: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """Faces (file, t, idx, embedding), in order of t and idx, with cluster (null: pruned, or without a file or an embedding), numbered by size, largest first.

    Faces join moving centres in order; those far from their cluster's medoid, the face nearest to its mean, leave; close clusters
    merge. Only the first step reads a file in one task, row by row; the next are joins and sums, and merging sees sums of clusters.
    """
    rows = found.select("file", "t", "idx", "embedding")
    whole = F.col("file").isNotNull() & F.col("embedding").isNotNull()
    placed = tables.stored(joined(rows.where(whole), [F.col("t"), F.col("idx")], threshold, True), "faces-joined")
    means = totals_of(placed).select("file", "cluster", unit(F.transform("total", lambda x: (x / F.col("n")).cast("float"))).cast("array<float>").alias("centre"))
    apart = placed.join(means, ["file", "cluster"]).withColumn("d", l2_unit(F.col("embedding"), F.col("centre")))
    medoids = apart.groupBy("file", "cluster").agg(F.min_by("embedding", F.struct("d", "t", "idx")).alias("medoid"))
    near = placed.join(medoids, ["file", "cluster"]).withColumn("near", l2_unit(F.col("embedding"), F.col("medoid")) < threshold)
    kept = tables.stored(near.select("file", "t", "idx", "cluster", "near", F.when(F.col("near"), F.col("embedding")).alias("embedding")), "faces-kept")

    def numbers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster").reset_index(drop=True)
        owner = merged_clusters(np.stack(pdf.total.to_numpy()).astype(np.float32), pdf.n.to_numpy(), threshold)
        sizes = pdf.n.groupby(owner).sum()
        place = {k: n for n, k in enumerate(sorted(sizes.index, key=lambda k: (-sizes[k], k)))}
        return pd.DataFrame({"file": pdf.file, "cluster": pdf.cluster, "number": [place[k] for k in owner]})

    kind = rows.schema["file"].dataType.simpleString()
    numbered = by_file(totals_of(kept.where("near")), "file", numbers, f"file {kind}, cluster long, number long")
    out = kept.join(numbered, ["file", "cluster"], "left").select("file", "t", "idx", F.when(F.col("near"), F.col("number")).alias("cluster"))
    return out.unionAll(rows.where(~whole).select("file", "t", "idx", F.lit(None).cast("long")))


def extracted(found: DataFrame, threshold: float = SAME_PERSON, blacklist: DataFrame | None = None) -> DataFrame:
    """Characters of clustered faces (…, area): clusters of at least SMALLEST faces that no blacklisted face (key, embedding) is near, each shown by its largest face; the MOST_CLUSTERS largest of a file, numbered by size."""
    rows = found.join(clustered(found, threshold), ["file", "t", "idx"]).where(F.col("cluster").isNotNull())
    shown = F.max_by(F.struct("t", "idx", "embedding"), F.struct("area", -F.col("t"), -F.col("idx")))
    out = rows.groupBy("file", "cluster").agg(F.count("*").alias("memberCount"), shown.alias("s"), F.sort_array(F.collect_list("t")).alias("times")).where(F.col("memberCount") >= SMALLEST)
    out = out.withColumn("key", F.concat_ws("#", "file", F.col("cluster").cast("string")))
    if blacklist is not None:
        near = faces.theta_nearest(out.select("key", F.col("s.embedding").alias("embedding")), blacklist, threshold)
        out = out.join(near.select("key"), "key", "left_anti")
    ranked = out.withColumn("characterIdx", (F.row_number().over(W.partitionBy("file").orderBy(F.desc("memberCount"), "cluster")) - 1).cast("long")).where(F.col("characterIdx") < MOST_CLUSTERS)
    return ranked.select("file", "characterIdx", "memberCount", F.col("s.t").alias("bestT"), F.col("s.idx").alias("bestIdx"), "times")


def merged_faces(characters: DataFrame, threshold: float = SAME_PERSON, least_faces: int = 1, blacklist: DataFrame | None = None) -> DataFrame:
    """Characters of a file, without those that a blacklisted face is near, that are one person: best first, each joins the nearest group by its first face, or starts one; no chains. fileKey, characterIdx, groupId, representative."""
    if blacklist is not None:
        characters = faces.without_blacklisted(characters, blacklist, threshold)
    rows = characters.where(F.col("fileKey").isNotNull() & F.col("bestFaceEmbedding").isNotNull() & (F.col("memberCount") >= least_faces))
    rows = rows.select(F.col("fileKey").alias("file"), "characterIdx", "memberCount", "bestFaceScore", F.col("bestFaceEmbedding").alias("embedding"))
    best = [F.desc("bestFaceScore"), F.desc("memberCount"), F.asc("characterIdx")]
    placed = tables.stored(joined(rows, best, threshold, False).drop("embedding"), "characters-joined")
    # A row for each group of a file; the first of a group started it.
    first = F.min_by("characterIdx", F.struct(-F.col("bestFaceScore"), -F.col("memberCount"), "characterIdx"))
    groups = placed.groupBy("file", "cluster").agg(first.alias("representative"), F.min("characterIdx").alias("low"))
    numbered = groups.withColumn("groupId", (F.row_number().over(W.partitionBy("file").orderBy("low", "cluster")) - 1).cast("int"))
    return placed.join(numbered, ["file", "cluster"]).select(F.col("file").alias("fileKey"), "characterIdx", "groupId", "representative")


def _section_scenes(rows: Iterator[tuple[int, str, int | None]], gap: int, after: int | None, end: int) -> Iterator[tuple]:
    """Scenes (first, last, start, end, groups) of a section's rows (t, grp, the nearest time before) in order. Held are the rows that wait, all within a gap of the scene's last."""
    first = last = start = None
    groups: set[str] = set()
    waiting: list[tuple[int, str, int | None]] = []

    def closed(following: int | None) -> tuple:
        later = next((t for t, _, _ in waiting if t > last), following)
        return first, last, start or 0, max(end, last) if later is None else later, sorted(groups)

    todo: deque[tuple[int, str, int | None]] = deque()
    while True:
        if not todo:
            if (row := next(rows, None)) is not None:
                todo.append(row)
            elif first is None:
                return
            else:  # those that waited come again
                yield closed(after)
                todo, waiting, first, groups = deque(waiting), [], None, set()
                continue
        t, grp, before = todo.popleft()
        if first is not None and t - last > gap:
            yield closed(t)
            todo.appendleft((t, grp, before))
            todo.extendleft(reversed(waiting))
            waiting, first, groups = [], None, set()
        elif first is None:
            first, last, start, groups = t, t, before, {grp}
        elif grp in groups:
            groups.update(g for _, g, _ in waiting)
            waiting, last = [], t
        else:
            waiting.append((t, grp, before))


def scenes(detections: DataFrame, gap_ms: int, duration: str | None = None) -> DataFrame:
    """Scenes of a file from faces (file, grp, t): firstFace, lastFace, start, end, groups.

    A scene goes on while one of its faces returns within the gap; other faces wait, and join it when that happens; if it doesn't,
    the next scene starts at the first that waits. Scenes reach out to the detections around them, or to 0 and the file's end.
    A gap that no face bridges ends all scenes, so files are cut there into sections, which tasks read row by row.
    """
    length = F.col(duration).cast("long") if duration else F.lit(0).cast("long")
    rows = tables.sectioned(detections.select("file", F.col("grp").cast("string").alias("grp"), F.col("t").cast("long").alias("t"), length.alias("duration")), "file", "t", gap_ms, ["grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", names["file"]), ("firstFace", pa.int64()), ("lastFace", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("groups", pa.list_(pa.string()))])

        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("section", "file", "t", "grp", "before", "after", "duration")), strict=True)

        def timed(own: Iterator[tuple], nearest: int | None) -> Iterator[tuple[int, str, int | None]]:
            now = None
            for _, _, t, grp, _, _, _ in own:
                if now is not None and t > now:
                    nearest = now
                now = t
                yield t, grp, nearest

        found: list[tuple] = []
        for _, own in groupby(flat(), key=lambda r: r[0]):
            head = next(own)
            for scene in _section_scenes(timed(chain([head], own), head[4]), gap_ms, head[5], head[6] or 0):
                found.append((head[1], *scene))
                if len(found) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    kind = rows.schema["file"].dataType
    names = {"file": to_arrow_type(kind)}
    ordered = rows.repartition("section").sortWithinPartitions("section", "t", "grp")
    return ordered.mapInArrow(run, f"file {kind.simpleString()}, firstFace long, lastFace long, start long, end long, groups array<string>")


def touches(starts: np.ndarray, furthest: np.ndarray, spans: np.ndarray) -> bool:
    """Whether one of some spans meets one of those by start, of which the furthest end so far is known: of those that begin before a span's end, one reaches its start."""
    n = np.searchsorted(starts, spans[:, 1], "right")
    return bool(((n > 0) & (furthest[np.maximum(n, 1) - 1] >= spans[:, 0])).any())


def packed(segments: DataFrame) -> DataFrame:
    """A row for each group of a file's timeline: groups (file, grp, start, end, points; members, if there) by appearances, then members, then grp, each in the first row where nothing touches it."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = sorted(((-int(x.points.sum()), -int(x.members.max()), name, x[["start", "end"]].to_numpy()) for name, x in pdf.groupby("grp")), key=lambda x: x[:3])
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each row the spans by start, and the furthest end up to each, and the spans
        out = []
        for minus, _, name, spans in groups:
            fits = next((i for i, (starts, furthest, _) in enumerate(rows) if not touches(starts, furthest, spans)), len(rows))
            held = np.vstack([rows[fits][2], spans]) if fits < len(rows) else spans
            held = held[np.argsort(held[:, 0], kind="stable")]
            rows[fits : fits + 1] = [(held[:, 0], np.maximum.accumulate(held[:, 1]), held)]
            out.append((pdf.file.iloc[0], name, fits, -minus))
        return pd.DataFrame(out, columns=["file", "grp", "row", "appearances"])

    members = F.col("members") if "members" in segments.columns else F.lit(0)
    rows = segments.select("file", "grp", "start", "end", "points", members.alias("members"))
    return by_file(rows, "file", work, f"file {rows.schema['file'].dataType.simpleString()}, grp string, row int, appearances long")


def top_rows(packed_rows: DataFrame, rows: int) -> DataFrame:
    """The first rows of a timeline."""
    return packed_rows.where(F.col("row") < rows)


def suppressed(boxes: DataFrame, overlap: float = 0.4) -> DataFrame:
    """Boxes (file, frame, idx, x1, y1, x2, y2, score) of a frame that no better one kept covers by more than the share."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "idx"], ascending=[False, True], kind="stable").reset_index(drop=True)
        x1, y1, x2, y2 = (pdf[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        area, kept = (x2 - x1) * (y2 - y1), []
        for i in range(len(pdf)):
            k = np.array(kept, int)
            both = np.maximum(0, np.minimum(x2[i], x2[k]) - np.maximum(x1[i], x1[k])) * np.maximum(0, np.minimum(y2[i], y2[k]) - np.maximum(y1[i], y1[k]))
            if not (both / np.maximum(area[i] + area[k] - both, 1e-12) > overlap).any():
                kept.append(i)
        return pdf.loc[kept, ["file", "frame", "idx"]]

    return boxes.groupBy("file", "frame").applyInPandas(work, "file string, frame long, idx long")
