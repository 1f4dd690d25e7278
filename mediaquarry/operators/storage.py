"""What a library's Parquet files take, from their footers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ranges import opened

FOOTERS = "path string, file_bytes long, row_group int, rows long, column string, bytes long, plain_bytes long, nulls long"


def files_of(table: DataFrame) -> DataFrame:
    """path of each file that a table is read from, without reading its columns."""
    return table.select(F.col("_metadata.file_path").alias("path")).distinct()


def footers(files: DataFrame) -> DataFrame:
    """A row for each column chunk of Parquet files (path): the file's bytes, row group and its rows, the column's path, its bytes as stored and before compression, and its nulls (null where the file doesn't say). Only footers are read, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    size, about = file.size(), pq.ParquetFile(file).metadata
                    for i in range(about.num_row_groups):
                        group = about.row_group(i)
                        chunks = [group.column(j) for j in range(group.num_columns)]
                        n = len(chunks)
                        nulls = [c.statistics.null_count if c.statistics is not None and c.statistics.has_null_count else None for c in chunks]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([path] * n), pa.array([size] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([group.num_rows] * n, pa.int64()), pa.array([c.path_in_schema for c in chunks]),
                                pa.array([c.total_compressed_size for c in chunks], pa.int64()), pa.array([c.total_uncompressed_size for c in chunks], pa.int64()), pa.array(nulls, pa.int64()),
                            ],
                            names=["path", "file_bytes", "row_group", "rows", "column", "bytes", "plain_bytes", "nulls"],
                        )

    return files.select("path").mapInArrow(run, FOOTERS)


def column_sizes(footers: DataFrame) -> DataFrame:
    """A row for each column, the largest first: bytes, plain_bytes, rows, nulls and place. Parts of a nested column count for it."""
    own = footers.withColumn("column", F.substring_index("column", ".", 1))
    parts = own.groupBy("path", "row_group", "column").agg(F.sum("bytes").alias("bytes"), F.sum("plain_bytes").alias("plain_bytes"), F.max("rows").alias("rows"), F.max("nulls").alias("nulls"))
    each = parts.groupBy("column").agg(*(F.sum(c).alias(c) for c in ("bytes", "plain_bytes", "rows", "nulls")))
    return each.orderBy(F.desc("bytes"), "column")


def totals(footers: DataFrame, table: DataFrame, key: str, uncompacted: Column) -> DataFrame:
    """One row: rows, columns, files, bytes, duplicates (the share of rows whose key another row has already), and the bytes and share of files that uncompacted (a test of path and file_bytes) is true of."""
    files = footers.groupBy("path", "file_bytes").agg(F.max("row_group").alias("_g"))
    loose = F.coalesce(F.sum(F.when(uncompacted, F.col("file_bytes"))), F.lit(0))
    all_files = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_bytes"), F.lit(0)).alias("bytes"), loose.alias("looseBytes")).withColumn("looseShare", F.when(F.col("bytes") > 0, F.col("looseBytes") / F.col("bytes")))
    columns = footers.agg(F.count_distinct(F.substring_index("column", ".", 1)).alias("columns"))
    groups = footers.select("path", "row_group", "rows").distinct().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    keys = table.groupBy(key).agg(F.count("*").alias("_n")).agg((F.sum(F.col("_n") - 1) / F.sum("_n")).alias("duplicates"))
    return groups.crossJoin(columns).crossJoin(all_files).crossJoin(keys)
