"""Series: folders that hold enough videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import base_of, collated, depth_of, parent_of
from . import tables

SERIES_MIN, SERIES_MAX = 5, 100


def with_folder(files: DataFrame, path: str = "relativePath") -> DataFrame:
    """files with folder: where each counts for series. From the deepest level up, a video alone in its folder moves to the folder above, but never to the root; videos at the root have null.

    The levels work on a table of folders and their counts, stored after each, so that plans don't grow with the depth; files
    are joined to it once, and a folder's videos never meet in one task.
    """
    direct = files.groupBy(parent_of(F.col(path)).alias("_from")).agg(F.count("*").alias("_n")).where(F.col("_from").isNotNull())
    state = tables.stored(direct.withColumn("folder", F.col("_from")), "folders")
    deepest = state.agg(F.max(depth_of(F.col("folder")))).first()[0] or 0
    for depth in range(deepest, 1, -1):
        here = state.where(depth_of(F.col("folder")) == depth)
        lone = here.groupBy("folder").agg(F.sum("_n").alias("_all")).where(F.col("_all") == 1).select("folder", F.lit(True).alias("_lone"))
        moved = state.join(lone, "folder", "left").withColumn("folder", F.when(F.col("_lone"), parent_of(F.col("folder"))).otherwise(F.col("folder"))).drop("_lone")
        state = tables.stored(moved, "folders") if depth > 2 else moved
    return files.withColumn("_from", parent_of(F.col(path))).join(state.select("_from", "folder"), "_from", "left").drop("_from")


def series_of(foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """folder, folderName, videos of each series, from with_folder's result."""
    counts = foldered.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("videos")).where(F.col("videos").between(least, most))
    return counts.withColumn("folderName", base_of(F.col("folder")))


def members(foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """Videos of series with their place, and those before and after; names in reading order, equal ones by key."""
    order = W.partitionBy("folder").orderBy(collated(F.col("name")), "key")
    inside = foldered.join(series_of(foldered, least, most), "folder")  # a series has at most `most` videos
    return inside.withColumns({"episode": F.row_number().over(order) - 1, "previousKey": F.lag("key").over(order), "nextKey": F.lead("key").over(order)})


def last_played(foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """For each series that was played: the member played last (ties: first by name), when, and how far."""
    rows = members(foldered, least, most).where(F.col("positionUpdatedAt") > 0)
    best = F.max_by(F.struct("key", "positionUpdatedAt", "positionSec", "durationSec"), F.struct("positionUpdatedAt", -F.col("episode")))
    return rows.groupBy("folder").agg(best.alias("m")).select("folder", F.col("m.key").alias("key"), F.col("m.positionUpdatedAt").alias("at"), "m.positionSec", "m.durationSec")


def siblings(files: DataFrame) -> DataFrame:
    """files with the number of videos directly in their folder."""
    counts = files.groupBy("parent").agg(F.count("*").alias("siblings"))
    return files.join(counts, files.parent.eqNullSafe(counts.parent), "left").drop(counts.parent)


def expanded(selected: DataFrame, foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """Keys of selected (key) and of all videos in their series."""
    wanted = foldered.join(selected.select("key"), "key", "left_semi").join(series_of(foldered, least, most), "folder", "left_semi").select("folder").distinct()
    return foldered.join(wanted, "folder", "left_semi").select("key").union(selected.select("key")).distinct()


def alphabetical(found: DataFrame) -> DataFrame:
    """Series in reading order of their whole paths, with place."""
    return tables.numbered(found, [collated(F.col("folder")), F.col("folder")], "place")


def last_plays(foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """When something of each series was last played: key (its folder), played."""
    inside = foldered.join(series_of(foldered, least, most).select("folder"), "folder", "left_semi")
    return inside.groupBy(F.col("folder").alias("key")).agg(F.max("positionUpdatedAt").alias("played"))


def display_thumbs(foldered: DataFrame, least: int = SERIES_MIN, most: int = SERIES_MAX) -> DataFrame:
    """For each series the video whose picture it shows: the first whose picture a user picked (userThumb), else the one played last, else the first."""
    rows = members(foldered, least, most)
    picked = F.min_by(F.when(F.col("userThumb"), F.col("key")), F.when(F.col("userThumb"), F.col("episode")))
    played = F.max_by(F.when(F.col("positionUpdatedAt") > 0, F.col("key")), F.when(F.col("positionUpdatedAt") > 0, F.struct("positionUpdatedAt", -F.col("episode"))))
    return rows.groupBy("folder").agg(F.coalesce(picked, played, F.min_by("key", "episode")).alias("key"))
