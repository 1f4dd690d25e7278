"""Walks of a library's folders, over listings of their entries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.formats import is_video_name
from ..functions.text import base_of, parent_of
from . import folders, tables

FILE_BUDGET, VIDEO_BONUS, MAX_DEPTH, MAX_FOLDERS = 10_000, 100, 20, 100_000
# Folders that an offline walk never enters.
JUNK = ("node_modules", ".git", ".svn", ".hg")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and size of all files there, without reading them; the reader leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    return files.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").split(":")[-1].lstrip("/") + "/", "").alias("path"), "size")


class Walk(NamedTuple):
    files: DataFrame  # path, folder, video: what the walk saw
    folders: DataFrame  # folder, files, videos: directly in each folder that it entered, also where that is none
    summary: DataFrame  # one row: folders, files, videos, and truncated: something was left out for a limit


def folder_table(files: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """All folders (folder, parts, depth; the root is "") that hold files (path) at any depth, and those of empty (folder) with all above them."""
    own = files.select(F.coalesce(parent_of(F.col("path")), F.lit("")).alias("folder"))
    named = (own if empty is None else own.unionByName(empty.select("folder"))).distinct()
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    each = named.select(parts.alias("_p")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("_p")), lambda n: F.slice(F.col("_p"), 1, n))).alias("parts"))
    root = each.sparkSession.range(1).select(F.array().cast("array<string>").alias("parts"))
    return each.unionByName(root).distinct().select(F.array_join("parts", "/").alias("folder"), "parts", F.size("parts").alias("depth"))


def walk(files: DataFrame, ignored: DataFrame | None = None, empty: DataFrame | None = None, budget: int = FILE_BUDGET, bonus: int = VIDEO_BONUS, depth: int = MAX_DEPTH, most_folders: int = MAX_FOLDERS, block: int = 100_000) -> Walk:
    """What a walk in breadth sees of files (path) and of folders without any (empty: folder).

    Folders go by depth, then by their parts' names, files by name. Each folder directly below the root has a budget of
    files; a video adds to it, and where it is used up the walk of that folder ends: no later entry of it is seen and no
    later folder entered. Folders that are too deep, beyond the number allowed (the root and those without files count; a
    folder that a budget closes keeps its place), or ignored (key) aren't entered. The budget is a running sum over ranges of the
    order, in which a folder stands before its files, so that no task holds a whole subtree.
    """
    rows = files.select("path", F.coalesce(parent_of(F.col("path")), F.lit("")).alias("folder"), base_of(F.col("path")).alias("name"))
    table = folder_table(files, empty)
    if ignored is not None:
        table = folders.outside(table.withColumn("key", F.concat("folder", F.lit("/x"))), ignored, "folder").drop("key")
    table = tables.stored(table, "folders")
    within = table.where(F.col("depth") <= depth)
    ranked = tables.numbered(within, [F.col("depth"), F.col("parts")], "_rank")
    entered = ranked.where(F.col("_rank") < most_folders)
    # A folder isn't entered without the one above it, which goes before it in the order.
    inside = rows.join(entered.select("folder", "parts", "depth"), "folder")
    starts = entered.select(F.lit(None).cast("string").alias("path"), "folder", F.lit("").alias("name"), "parts", "depth")
    both = inside.select("path", "folder", "name", "parts", "depth").unionByName(starts)
    both = both.withColumns({"top": F.coalesce(F.get("parts", F.lit(0)), F.lit("")), "is_file": F.col("path").isNotNull(), "video": F.col("path").isNotNull() & is_video_name(F.col("name"))})
    ordered = tables.numbered(both, [F.col("top"), F.col("depth"), F.col("parts"), F.col("is_file"), F.col("name")]).withColumn("_block", F.expr(f"position div {block}"))
    change = F.when(F.col("video"), bonus - 1).when(F.col("is_file"), -1).otherwise(0)
    in_block = W.partitionBy("top", "_block").orderBy("position")
    summed = ordered.withColumn("_sum", F.coalesce(F.sum(change).over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    summed = summed.withColumn("_least", F.min("_sum").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    # At most a row for each block and one more for each top folder.
    before = W.partitionBy("top").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = summed.groupBy("top", "_block").agg(F.sum(change).alias("_change"), F.min("_sum").alias("_low")).withColumn("_base", F.coalesce(F.sum("_change").over(before), F.lit(0)))
    blocks = blocks.withColumn("_before", F.min(F.col("_base") + F.col("_low")).over(before)).select("top", "_block", "_base", "_before")
    left = budget + F.least(F.col("_base") + F.col("_least"), F.coalesce("_before", F.col("_base") + F.col("_least")))
    placed = summed.join(blocks, ["top", "_block"]).where((F.col("top") == "") | (left > 0))
    used_up = (F.col("top") != "") & (budget + F.col("_base") + F.col("_sum") + change <= 0)
    seen = tables.stored(placed.select("path", "folder", "video", "is_file", used_up.alias("used_up")), "walk")

    each = seen.groupBy("folder").agg(F.count_if("is_file").alias("files"), F.count_if("video").alias("videos"))
    cut = table.agg((F.count_if(F.col("depth") > depth) > 0).alias("_deep"), (F.count_if(F.col("depth") <= depth) > most_folders).alias("_many"))
    whole = seen.agg(F.count_if(~F.col("is_file")).alias("folders"), F.count_if("is_file").alias("files"), F.count_if("video").alias("videos"), F.coalesce(F.bool_or("used_up"), F.lit(False)).alias("_used"))
    return Walk(seen.where("is_file").select("path", "folder", "video"), each, whole.crossJoin(cut).select("folders", "files", "videos", (F.col("_used") | F.col("_deep") | F.col("_many")).alias("truncated")))


def walked(files: DataFrame, ignored: DataFrame | None = None, budget: int = FILE_BUDGET, bonus: int = VIDEO_BONUS, depth: int = MAX_DEPTH, most_folders: int = MAX_FOLDERS, block: int = 100_000) -> DataFrame:
    """The files that walk() sees: path, folder, video."""
    return walk(files, ignored, None, budget, bonus, depth, most_folders, block).files


def offline(files: DataFrame, ignored: DataFrame, removed: DataFrame, batch: int = 500) -> DataFrame:
    """The videos (path) that an offline walk adds, in batches: no hidden entries, junk folders, ignored folders or removed files (key)."""
    parts = F.split("path", "/")
    clean = files.where(~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*JUNK)) & is_video_name(F.col("path")))
    kept = folders.outside(clean.withColumn("key", F.col("path")), ignored, "path").join(removed.select("key"), "key", "left_anti")
    return tables.numbered(kept, [F.col("key")]).select("key", F.expr(f"position div {batch}").alias("batch"))


def file_ranges(rows: DataFrame, file: str = "file", key: str = "key", at: str = "at") -> DataFrame:
    """Where each file's rows lie: first and last time, and on scales from 0 to 1 where its times and its keys begin (Left) and how far they reach (Width).

    The scale of keys goes from the smallest of all keys to the largest, by rank. Where there is one key or one time only, files lie on the whole scale.
    """
    keys = tables.numbered(rows.select(key).distinct(), [F.col(key)], "rank")
    whole = rows.agg(F.min(at).alias("_t0"), (F.max(at) - F.min(at)).alias("_span")).crossJoin(keys.agg(F.max("rank").alias("_top")))
    each = rows.join(keys, key).groupBy(file).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"), F.count("*").alias("rows"))
    share = lambda n, of, otherwise: F.when(F.col(of) > 0, n / F.col(of)).otherwise(F.lit(otherwise))
    return each.crossJoin(F.broadcast(whole)).select(
        file, "first", "last", share(F.col("first") - F.col("_t0"), "_span", 0.0).alias("timeLeft"), share(F.col("last") - F.col("first"), "_span", 1.0).alias("timeWidth"),
        share(F.col("_lo"), "_top", 0.0).alias("keyLeft"), share(F.col("_hi") - F.col("_lo"), "_top", 1.0).alias("keyWidth"), "rows",
    )
