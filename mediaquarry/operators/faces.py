"""Faces: nearest characters, frames, blacklists, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import parent_of
from ..functions.vectors import SAME_PERSON, doubles, l2_unit, unit
from . import tables


def below(distance: Column, threshold: float, closed: bool) -> Column:
    return distance <= threshold if closed else distance < threshold


def nearest_by_file(characters: DataFrame, query: Column) -> DataFrame:
    """For each file its nearest character: distance, characterIdx, memberCount; one pass, ties by characterIdx."""
    rows = characters.where(F.col("bestFaceEmbedding").isNotNull()).withColumn("distance", l2_unit(F.col("bestFaceEmbedding"), query))
    best = F.min_by(F.struct("distance", "characterIdx", "memberCount"), F.struct("distance", "characterIdx"))
    return rows.groupBy("fileKey").agg(best.alias("b")).select("fileKey", "b.*")


def person_search(characters: DataFrame, query: Column, threshold: float = SAME_PERSON, closed: bool = True, by: str = "count") -> DataFrame:
    """All characters near the query with place: those with most members first, then the nearest (by count), or the other way round (by distance); ties by key."""
    rows = characters.withColumn("distance", l2_unit(F.col("bestFaceEmbedding"), query))
    return rows.where(below(F.col("distance"), threshold, closed)).orderBy(*face_order(by))


def face_order(by: str) -> list[Column]:
    keys = [F.desc("memberCount"), F.asc("distance")]
    return [*(keys if by == "count" else keys[::-1]), F.asc("key")]


def ranked_in_file(characters: DataFrame, query: Column) -> DataFrame:
    """Each file's characters by distance, with place from 0; those without a vector are infinitely far and come last, by characterIdx."""
    distance = F.coalesce(l2_unit(F.col("bestFaceEmbedding"), query), F.lit(float("inf")))
    return characters.withColumn("distance", distance).withColumn("place", F.row_number().over(W.partitionBy("fileKey").orderBy("distance", "characterIdx")) - 1)


def by_series(matches: DataFrame, series: DataFrame) -> DataFrame:
    """Matches (fileKey, memberCount), of which two and more in the folder of a series (folder) become one: kind, key, matches, appearances."""
    folder = parent_of(F.col("fileKey"))
    inside = matches.withColumn("folder", folder).join(series.select("folder", F.lit(True).alias("_s")), "folder", "left").withColumn("folder", F.when(F.col("_s"), F.col("folder")))
    counts = inside.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("matches"), F.sum("memberCount").cast("long").alias("appearances")).where(F.col("matches") >= 2)
    alone = inside.join(counts.select("folder"), "folder", "left_anti")
    return counts.select(F.lit("series").alias("kind"), F.col("folder").alias("key"), "matches", "appearances").unionByName(alone.select(F.lit("video").alias("kind"), F.col("fileKey").alias("key"), F.lit(1).cast("long").alias("matches"), F.col("memberCount").cast("long").alias("appearances")))


def unpacked(frames: DataFrame, dim: int) -> DataFrame:
    """A row for each packed vector: key, frame, time, embedding."""
    n = F.size("embeddings") / dim
    parts = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.slice("embeddings", (i - 1) * dim + 1, dim))
    rows = frames.where(F.size("embeddings") >= dim).select("key", F.posexplode(F.arrays_zip(parts.alias("embedding"), F.col("frameTimes").alias("time"))).alias("frame", "x"))
    return rows.select("key", "frame", "x.time", "x.embedding")


def best_frames(frames: DataFrame, matched: DataFrame, query: Column, dim: int, top: int = 3) -> DataFrame:
    """Of each matched source (key) the frames nearest to the query. The heavy table meets the matches before it is unpacked."""
    rows = unpacked(frames.join(matched.select("key"), "key", "left_semi"), dim).withColumn("distance", l2_unit(F.col("embedding"), query))
    w = W.partitionBy("key").orderBy("distance", "frame")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("key", "frame", "time", "distance", "rank")


def theta_nearest(left: DataFrame, right: DataFrame, threshold: float = SAME_PERSON, closed: bool = False, most: int = 10_000) -> DataFrame:
    """For each row of left (key, embedding) the nearest row of right (key, embedding) under the threshold: key, other, distance; ties by key.

    right is counted before its vectors, at most `most`, are sent to all tasks; more go by blocks of that size, one after another,
    whose nearest are stored. Rows without a vector match nothing; all vectors are of one length.
    """
    rows = left.where(F.col("embedding").isNotNull()).select(F.col("key").cast("string").alias("key"), doubles(F.col("embedding")).alias("embedding"))
    other = right.where(F.col("embedding").isNotNull()).select(F.col("key").cast("string").alias("other"), doubles(F.col("embedding")).alias("_e"))
    if other.limit(most + 1).count() <= most:
        return nearest_other(rows, other, threshold, closed)
    spark = left.sparkSession
    rows, path = tables.stored(rows, "theta-left"), tables.new_path(spark, "theta-nearest")
    for block in tables.in_blocks(other, most, "theta-right"):
        best = nearest_other(rows, block, threshold, closed)
        best.write.mode("append").parquet(path)
    found = spark.read.schema(best.schema).parquet(path)
    return found.groupBy("key").agg(F.min_by(F.struct("other", "distance"), F.struct("distance", "other")).alias("b")).select("key", "b.*")


#: Rows of the left side that meet all vectors of a block at the same time.
ROWS_AT_ONCE = 512


def nearest_other(rows: DataFrame, other: DataFrame, threshold: float, closed: bool) -> DataFrame:
    """For each row (key, embedding) the nearest of a few vectors (other, _e), which the caller has counted, under the threshold: key, other, distance. One product of matrices for some rows at a time."""
    few = other.orderBy("other").collect()
    sent = rows.sparkSession.sparkContext.broadcast(([r.other for r in few], np.array([r._e for r in few], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows if names else 0, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                x = np.asarray(batch.column("embedding").flatten()).reshape(batch.num_rows, -1)
                distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ vectors.T)))
                nearest = distance.argmin(axis=1)
                least = distance[np.arange(len(x)), nearest]
                near = np.flatnonzero(least <= threshold if closed else least < threshold)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(near)), pa.array([names[i] for i in nearest[near]], pa.string()), pa.array(least[near])], names=["key", "other", "distance"])

    return rows.mapInArrow(run, "key string, other string, distance double")


def without_blacklisted(characters: DataFrame, blacklist: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """characters that no blacklisted face (key, embedding) is near."""
    near = theta_nearest(characters.select("key", F.col("bestFaceEmbedding").alias("embedding")), blacklist, threshold)
    return characters.join(near.select("key"), "key", "left_anti")


def blacklisted(characters: DataFrame, frames: DataFrame, blacklist: DataFrame, key: str, at: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a character goes to the blacklist: its vector is copied, its rows are deleted."""
    copied = characters.where(F.col("key") == key).select("key", F.col("bestFaceEmbedding").alias("embedding"), "fileKey", F.lit(at).cast("long").alias("blacklistedAt"))
    return characters.where(F.col("key") != key), frames.where(F.col("key") != key), blacklist.where(F.col("key") != key).unionByName(copied)


def pardoned(blacklist: DataFrame, key: str) -> DataFrame:
    """The blacklist without one face; its rows come back with the next scan."""
    return blacklist.where(F.col("key") != key)


def centroids(rows: DataFrame, by: str, embedding: str = "embedding") -> DataFrame:
    """Unit mean vector of each group, number by number: sums are combined before the shuffle."""
    each = rows.select(by, F.posexplode(doubles(F.col(embedding))).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p")).select(by, unit(F.transform("p", lambda p: p["x"])).alias("centroid"))


def medoids(rows: DataFrame, by: str, key: str, embedding: str = "embedding") -> DataFrame:
    """The row of each group nearest to its centroid; ties by key."""
    d = rows.join(centroids(rows, by, embedding), by).withColumn("distance", l2_unit(F.col(embedding), F.col("centroid")))
    return d.groupBy(by).agg(F.min_by(F.struct(F.col(key).alias("medoid"), "distance"), F.struct("distance", key)).alias("b")).select(by, "b.*")


def against_best(characters: DataFrame) -> DataFrame:
    """A file's characters by distance to its best-scored one (place 0)."""
    best = characters.groupBy("fileKey").agg(F.max_by(F.struct(F.col("key").alias("bestKey"), F.col("bestFaceEmbedding").alias("_e")), F.struct("bestFaceScore", -F.col("characterIdx"))).alias("b")).select("fileKey", "b.*")
    rows = characters.join(best, "fileKey").withColumn("distance", F.when(F.col("key") == F.col("bestKey"), 0.0).otherwise(l2_unit(F.col("bestFaceEmbedding"), F.col("_e"))))
    w = W.partitionBy("fileKey").orderBy(F.when(F.col("key") == F.col("bestKey"), 0).otherwise(1), "distance", "characterIdx")
    return rows.select("fileKey", "key", "bestKey", "distance", (F.row_number().over(w) - 1).alias("place"))


def poster(candidates: DataFrame, siblings: DataFrame | None = None, picked: DataFrame | None = None, least_px: int = 128, after: float = 0.3, series_from: int = 5) -> DataFrame:
    """For each file the face (fileKey, cluster, t, w, h, duration) that stands for it: the largest of its first character, or of its second in folders of series_from videos (siblings: fileKey, siblings), wide enough and late enough (a share of the runtime, or of the character's last time where that is unknown); ties by time. Files whose picture a user picked get none."""
    rows = candidates if siblings is None else candidates.join(siblings.select("fileKey", "siblings"), "fileKey", "left")
    if picked is not None:
        rows = rows.join(picked.select("fileKey"), "fileKey", "left_anti")
    second = F.lit(False) if siblings is None else F.coalesce(F.col("siblings") >= series_from, F.lit(False))
    best = W.partitionBy("fileKey")
    wanted = F.when(second & (F.max("cluster").over(best) >= 1), 1).otherwise(0)
    mine = rows.withColumn("_wanted", wanted).where(F.col("cluster") == F.col("_wanted"))
    end = F.when(F.col("duration") > 0, F.col("duration")).otherwise(F.max("t").over(best))
    fine = mine.withColumn("_end", end).where((F.col("t") >= after * F.col("_end")) & (F.col("w") >= least_px))
    return fine.groupBy("fileKey").agg(F.max_by(F.struct("t", "w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("t"))).alias("b")).select("fileKey", "b.*")


def merged_groups(merged: DataFrame, characters: DataFrame, frames: DataFrame) -> DataFrame:
    """People of each file from merged characters (fileKey, characterIdx, groupId, representative): charKeys, repCharKey, memberCount, times in order (frames: key, frameTimes)."""
    rows = merged.join(characters.select("fileKey", "characterIdx", "key", "memberCount"), ["fileKey", "characterIdx"]).join(frames.select("key", "frameTimes"), "key", "left")
    rep = F.max(F.when(F.col("characterIdx") == F.col("representative"), F.col("key")))
    return rows.groupBy("fileKey", "groupId").agg(F.array_sort(F.collect_list("key")).alias("charKeys"), rep.alias("repCharKey"), F.sum("memberCount").alias("memberCount"), F.array_sort(F.flatten(F.collect_list(F.coalesce("frameTimes", F.array().cast(frames.schema["frameTimes"].dataType))))).alias("times"))


def same_series(sources: DataFrame, foldered: DataFrame, series: DataFrame) -> DataFrame:
    """sources (fileKey, …) with target: the file itself and all others directly in its folder, if that is a series (folder)."""
    inside = foldered.select(F.col("key").alias("target"), parent_of(F.col("key")).alias("folder")).join(series.select("folder"), "folder", "left_semi")  # a series has a bounded number of files
    others = sources.withColumn("folder", parent_of(F.col("fileKey"))).join(inside, "folder").where(F.col("target") != F.col("fileKey")).drop("folder")
    return sources.withColumn("target", F.col("fileKey")).unionByName(others.select(*sources.columns, "target"))


def people_groups(sources: DataFrame, groups: DataFrame, threshold: float = SAME_PERSON) -> DataFrame:
    """The group (fileKey, groupId, repEmbedding) of a target file that each source (charKey, target, embedding) is: the nearest at most that far; ties by groupId: fileKey, charKey, groupId, distance."""
    met = sources.select("charKey", F.col("target").alias("fileKey"), "embedding").join(groups, "fileKey").withColumn("distance", l2_unit(F.col("embedding"), F.col("repEmbedding")))
    best = met.groupBy("fileKey", "charKey").agg(F.min_by(F.struct("groupId", "distance"), F.struct("distance", "groupId")).alias("b"))
    return best.select("fileKey", "charKey", "b.*").where(F.col("distance") <= threshold)


def scenes_of(scenes: DataFrame, people: DataFrame) -> DataFrame:
    """scenes (file, groups) with one of the people's groups (fileKey, groupId)."""
    wanted = people.groupBy(F.col("fileKey").alias("file")).agg(F.collect_set("groupId").alias("_wanted"))
    return scenes.join(wanted, "file").where(F.arrays_overlap("groups", "_wanted")).drop("_wanted")
