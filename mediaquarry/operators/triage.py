"""Triage of files that failed: an ordered list of rules, and groups of like failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import error_signature

UNSORTED = "uncategorized"

#: What a probe says of a file, as a struct.
PROBE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("hasVideo", T.BooleanType()), T.StructField("container", T.StringType()), T.StructField("primaryVideo", T.StringType())])

# Codecs that have a category of their own, in order.
CODECS = (("mpeg2", "mpeg2video"), ("vc1", "vc1"), ("mpeg4-part2", "mpeg4"), ("mpeg1", "mpeg1video"), ("hevc", "hevc"), ("h264-browser-refused", "h264"))
# Categories of what can't be helped and of what is to be looked into; all others work offline.
UNSUPPORTED = ("file-missing", "corrupt-container", "no-real-video")
INVESTIGATE = ("browser-undecodable-unprobed", "timeout-unprobed")


def category(exists: Column, ext: Column, error: Column, probe: Column) -> Column:
    """The first rule that holds of a failed file; probe is a struct like PROBE, or null."""
    ok, video, codec = F.coalesce(probe["ok"], F.lit(False)), F.coalesce(probe["hasVideo"], F.lit(False)), probe["primaryVideo"]
    probed, avi = probe.isNotNull(), ext == "avi"
    out = F.when(~exists, "file-missing").when(probed & ~ok, "corrupt-container").when(ok & ~video, "no-real-video")
    for name, known in CODECS:
        holds = F.coalesce(codec == known, F.lit(False))
        out = out.when(holds | (avi & (~probed | ok)) if name == "mpeg4-part2" else holds, name)
    out = out.when(video, "other-readable-video").when(avi & ~probed, "avi-unprobed")
    out = out.when(~probed & error.rlike(r"(?i)cannot be decoded by this browser|decod(er|ing) error|unrecognizable format"), "browser-undecodable-unprobed")
    return out.when(~probed & error.rlike("(?i)timed out"), "timeout-unprobed").otherwise(UNSORTED)


def support(name: Column) -> Column:
    return F.when(name.isin(*UNSUPPORTED), "unsupported").when(name.isin(*INVESTIGATE), "investigate").when(name == UNSORTED, UNSORTED).otherwise("offline")


def categorized(records: DataFrame) -> DataFrame:
    """records (exists, ext, extractionError, probe) with category and support."""
    rows = records.withColumn("category", category(F.col("exists"), F.col("ext"), F.col("extractionError"), F.col("probe")))
    return rows.withColumn("support", support(F.col("category")))


def summary(rows: DataFrame) -> DataFrame:
    """Counts by support, and by support and category; category is null in the former."""
    return rows.rollup("support", "category").agg(F.count("*").alias("records")).where(F.col("support").isNotNull())


def signatures(rows: DataFrame) -> DataFrame:
    """Like messages: how many, and the first example by path."""
    sig = error_signature(F.col("extractionError"), F.col("relativePath"))
    return rows.withColumn("signature", sig).groupBy("signature").agg(F.count("*").alias("records"), F.min_by("extractionError", "relativePath").alias("example"))


def selected(rows: DataFrame, what: str) -> DataFrame:
    """Rows of a category, or else those whose path or error holds the text."""
    text = F.lit(what.lower())
    return rows.where((F.col("category") == what) | F.contains(F.lower("relativePath"), text) | F.contains(F.lower("extractionError"), text))


def like(rows: DataFrame, shape: Column) -> DataFrame:
    """Groups of rows alike in shape: how many, and the first by path."""
    return rows.withColumn("shape", shape).groupBy("shape").agg(F.count("*").alias("records"), F.min("relativePath").alias("example"))


def probe_shapes(rows: DataFrame) -> DataFrame:
    """Groups by what a probe (container, video, audio, ffError) found: container and codecs, or why it couldn't be read."""
    p = F.col("probe")
    listed = lambda codecs: F.coalesce(F.nullif(F.array_join(codecs, ","), F.lit("")), F.lit("none"))
    found = F.concat(F.coalesce(p["container"], F.lit("?")), F.lit(" | v="), listed(p["video"]), F.lit(" a="), listed(p["audio"]))
    return like(rows, F.when(p.isNull(), "(unprobed)").when(~p["ok"], F.concat(F.lit("UNREADABLE: "), F.coalesce(p["ffError"], F.lit("?")))).otherwise(found))


def decode_shapes(rows: DataFrame) -> DataFrame:
    """Groups of files that are there by how a trial decoding (ok, timedOut, stderr) ended: OK, TIMEOUT, or the last line of its complaints."""
    last = F.left(F.element_at(F.split(F.coalesce("stderr", F.lit("FAIL")), "\n"), -1), F.lit(120))
    return like(rows.where("exists"), F.when(F.col("ok"), "OK").when(F.col("timedOut"), "TIMEOUT").otherwise(last))


def assembled(errors: DataFrame, paths: DataFrame, **columns: DataFrame) -> DataFrame:
    """Error records from columns that are kept apart (key, value each): every key that has an error (not empty) and a path, what else is known of it, and ext, what follows the path's last dot (lower-case)."""
    rows = errors.where(F.coalesce("value", F.lit("")) != "").select("key", F.col("value").alias("extractionError"))
    rows = rows.join(paths.where(F.col("value").isNotNull()).select("key", F.col("value").alias("relativePath")), "key")
    for name, column in columns.items():
        rows = rows.join(column.select("key", F.col("value").alias(name)), "key", "left")
    return rows.withColumn("ext", F.lower(F.regexp_extract("relativePath", r"\.([^.]*)$", 1)))


def probed(records: DataFrame, cache: DataFrame, read: Column, force: bool = False) -> DataFrame:
    """records (key, size; exists, if there) with probe: the cache's (key, size, probe) where its size is right and it isn't to be read anyway, else read anew, a column that gives such a struct; files that don't exist can't be opened, whatever the cache holds."""
    held = cache.select("key", F.col("size").alias("_size"), F.col("probe").alias("_held"))
    rows = records.join(held, "key", "left")
    right = F.lit(not force) & F.col("_held").isNotNull() & F.col("_size").eqNullSafe(F.col("size"))
    probe = F.when(right, F.col("_held")).otherwise(read)
    if "exists" in records.columns:
        known = {"ok": F.lit(False), "hasVideo": F.lit(False), "ffError": F.lit("file missing on disk"), "video": F.array().cast("array<string>"), "audio": F.array().cast("array<string>")}
        missing = F.struct(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cache.schema["probe"].dataType.fields))
        probe = F.when(F.col("exists"), probe).otherwise(missing)
    return rows.withColumn("probe", probe).drop("_size", "_held")


def haystack(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose name, key, error or state words hold the text."""
    words = F.concat_ws(" ", "name", "key", "extractionError", F.when(F.coalesce("extractionError", F.lit("")) != "", "error failed"), F.when(F.col("scanBlacklisted"), "blacklisted skipped"), F.when(F.col("metadataVersion") == 7, "scanned").otherwise("unscanned pending"))
    return rows.where(F.contains(F.lower(words), F.lit(text.strip().lower())))
