"""The library's tables, made from the tables of a data directory by plain projections and joins.

files: from part, lineitem and events. characters, face_frames: from embeddings. lists, memberships: from orders. detections: from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import epoch_ms, padded, parent_of

#: The version that extracted data carry now.
VERSION = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes and states that need no join."""
    part = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    name = F.concat(n.cast("string"), F.lit(" "), "p_name", F.lit(".mkv"))
    path = F.concat_ws("/", "p_brand", "p_type", name)
    message = F.concat(F.lit("decoder error at 0x"), F.lower(F.hex(n * 7919)), F.lit(" in "), path, F.lit(" after "), (n * 13).cast("string"), F.lit(" ms"))
    return part.select(
        path.alias("key"), name.alias("name"), path.alias("relativePath"), parent_of(path).alias("parent"), n.alias("n"), F.col("p_size").cast("long").alias("size"),
        F.col("p_retailprice").alias("durationSec"), (n % 4).cast("int").alias("characterCount"), F.when(n % 10 == 3, message).when(n % 10 == 4, "").alias("extractionError"),
        F.when(n % 5 == 0, VERSION - 1).otherwise(VERSION).alias("metadataVersion"), F.when(n % 3 == 0, VERSION).when(n % 3 == 1, VERSION - 1).alias("keyframesVersion"),
        (n % 9).cast("int").alias("facesVersion"), (n % 11 == 0).alias("scanBlacklisted"), F.when(n % 17 == 0, n).alias("scanPriority"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bare_files with the times of the last change, addition and play, and the position."""
    changed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("n")).agg(epoch_ms(F.max("l_shipdate")).alias("fileModifiedAt"))
    played = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(epoch_ms(F.max("ts")).alias("positionUpdatedAt"), F.max("value").alias("positionSec"))
    all_files = bare_files(spark, sf_dir).join(changed, "n", "left").withColumn("u", F.col("n") % 1000)
    return all_files.join(played, "u", "left").drop("u").withColumn("addedAt", F.col("fileModifiedAt") + 3_600_000 * (F.col("n") % 48))


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's characters: file = label, one character for each vector."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "embeddings")
    idx = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    file = F.concat(F.lit("show#"), F.col("label").cast("string"))
    return rows.withColumn("characterIdx", idx).select(
        F.concat_ws("#", file, padded(F.col("characterIdx"))).alias("key"), file.alias("fileKey"), "characterIdx", F.col("embedding").alias("bestFaceEmbedding"),
        (1 + F.col("vec_id") % 20).cast("int").alias("memberCount"), ((F.col("vec_id") * 37 % 101) / 100.0).alias("bestFaceScore"), "vec_id",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces seen: file = user, group = event type, t in ms."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("grp"), epoch_ms(F.col("ts")).alias("t"), "event_id", "value")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List = order priority, item = customer; one row for a pair, the latest; some are ranked."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("listKey"), F.col("o_custkey").alias("itemKey"))
    out = rows.agg(epoch_ms(F.max("o_orderdate")).alias("addedAt"), F.min(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey"))).alias("rank"))
    return out.select(F.concat_ws("#", "listKey", "itemKey").alias("key"), "listKey", "itemKey", "addedAt", "rank")


def pages_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files in a deep tree: host on top, query dropped."""
    path = F.regexp_replace(F.regexp_replace(F.col("url"), "^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), path.alias("path"), F.length("html").cast("long").alias("size"))
