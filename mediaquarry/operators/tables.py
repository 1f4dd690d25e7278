"""Tables in the folder that all executors share, for what later jobs read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a table in spark.checkpoint.dir, or, on one machine where that is unset, in a folder of our own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="mediaquarry-")
        sc.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The rows of df, stored, in blocks of `most` rows and one of what is left: rows are numbered by tasks and their counts."""
    spark = df.sparkSession
    kept = stored(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), name)
    first, offsets = 0, []
    for part, n in sorted(kept.groupBy("_part").count().collect()):
        offsets.append((part, first))
        first += n
    starts = spark.createDataFrame(offsets, "_part int, _first long")
    path = new_path(spark, f"{name}-blocks")
    numbered = kept.join(F.broadcast(starts), "_part").withColumn("_block", F.expr(f"(_first + _at) div {most}")).drop("_part", "_at", "_first")
    numbered.write.partitionBy("_block").parquet(path)
    return [spark.read.schema(df.schema).parquet(f"{path}/_block={b}") for b in range(-(-first // most))]


def numbered(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """df with its rows' places from 0 by keys (which tell all rows apart): range partitions are sorted, stored and counted, so that no task holds all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kept = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    n = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    first = n.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_first"))  # a row for each part
    return kept.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def sectioned(df: DataFrame, by: str, at: str, gap: int, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """df (rows without at are left out) with section: a number that goes up wherever a group ends or two neighbours along at are more than gap apart, and before and after: the nearest values of at outside the section, in its group.

    Rows are sorted by ranges; sections that go on over a border are joined by what each range ends with, so that no task
    holds a group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(at).isNotNull())
    dealt = rows.repartitionByRange(parts, by, at, *ties).sortWithinPartitions(by, at, *ties)
    kept = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sections")
    along = W.partitionBy("_part").orderBy("_at")
    here = F.struct(F.col(by).alias("g"), F.col(at).alias("v"))
    # One row for each range: its last row, and so the one before the next range's first.
    ends = kept.groupBy("_part").agg(F.max_by(here, "_at").alias("_last"))
    before = ends.select(F.col("_part").alias("_p"), F.lag("_last").over(W.orderBy("_part")).alias("_earlier"))
    linked = kept.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("_previous", F.coalesce(F.lag(here).over(along), F.col("_earlier")))
    same = F.col("_previous").isNotNull() & F.col("_previous.g").eqNullSafe(F.col(by))
    new = F.when(same & (F.col(at) - F.col("_previous.v") <= gap), 0).otherwise(1)
    counted = stored(linked.withColumns({"_new": new, "_same": same, "_local": F.sum(new).over(along)}).drop("_p", "_earlier"), "sections")
    totals = counted.groupBy("_part").agg(F.sum("_new").alias("_n"))
    first = totals.select(F.col("_part").alias("_p"), (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_first"))
    numbered = counted.join(F.broadcast(first), F.col("_part") == F.col("_p")).withColumn("section", F.col("_first") + F.col("_local"))
    about = numbered.groupBy("section").agg(F.min(at).alias("_low"), F.max(F.when((F.col("_new") == 1) & F.col("_same"), F.col("_previous.v"))).alias("before"), F.max(F.col("_new") * F.col("_same").cast("int")).alias("_goes_on"))
    following = about.where("_goes_on = 1").select((F.col("section") - 1).alias("section"), F.col("_low").alias("after"))
    around = about.select("section", "before").join(following, "section", "left")
    return numbered.join(around, "section").select(*df.columns, "section", "before", "after")
