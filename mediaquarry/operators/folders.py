"""Roll-ups of a tree given by paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import parent_of, prefixes_of


def ancestors(files: DataFrame, path: str = "path") -> DataFrame:
    """Videos under each folder, at any depth."""
    return files.select(F.explode(prefixes_of(F.col(path))).alias("folder")).groupBy("folder").agg(F.count("*").alias("videos"))


def tree(files: DataFrame, path: str = "path", size: str = "size", measures: tuple[str, ...] = ()) -> DataFrame:
    """Each folder with what is in it and below: files, bytes, folders below, and sums of more measures. Folders without files of their own are there too."""
    rows = files.select(size, *measures, F.explode(prefixes_of(F.col(path))).alias("folder"))
    totals = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), *(F.sum(m).alias(m) for m in measures))
    below = totals.select(F.explode(prefixes_of(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("folders"))
    return totals.join(below, "folder", "left").select("folder", "files", "bytes", F.coalesce("folders", F.lit(0)).alias("folders"), *measures)


def shares(folders: DataFrame, metric: str = "bytes") -> DataFrame:
    """Each folder's share of the metric among its siblings, and its place: most first, then by name."""
    rows = folders.withColumn("above", F.coalesce(parent_of(F.col("folder")), F.lit("")))
    totals = rows.groupBy("above").agg(F.sum(metric).alias("_all"))
    order = W.partitionBy("above").orderBy(F.desc(metric), "folder")
    return rows.withColumn("place", F.row_number().over(order)).join(totals, "above").select("folder", "above", metric, F.when(F.col("_all") > 0, F.col(metric) / F.col("_all")).otherwise(0.0).alias("share"), "place")


def outside(files: DataFrame, ignored: DataFrame, path: str = "relativePath") -> DataFrame:
    """files that no ignored folder (key) holds: an anti-join on each folder above, not on prefixes."""
    above = files.select("key", F.explode(prefixes_of(F.col(path))).alias("folder"))
    inside = above.join(ignored.select(F.col("key").alias("folder")), "folder", "left_semi").select("key").distinct()
    return files.join(inside, "key", "left_anti")
