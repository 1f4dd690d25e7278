"""The catalogue over time: merges by column, reconciling with a walk, and choosing work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_of
from ..sources.adapters import VERSION

DAY = 86_400_000
MAX_ATTEMPTS = 3


def upsert(table: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """table with rows merged by key: columns that rows has take its values, null included; the others keep theirs; new keys are added."""
    had, sent = table.withColumn("_had", F.lit(True)).alias("o"), rows.withColumn("_sent", F.lit(True)).alias("n")
    both = had.join(sent, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.when(F.col("n._sent"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in rows.columns else F.col(f"o.{c}")
    return both.select(*(F.coalesce(f"n.{key}", f"o.{key}").alias(c) if c == key else pick(c).alias(c) for c in table.columns))


def update(table: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """Like upsert, but keys that table lacks are not added."""
    return upsert(table, rows.join(table.select(key), key, "left_semi"), key)


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def seen(files: DataFrame, walk: DataFrame, now: int) -> DataFrame:
    """files after a walk found keys (key, size): seen now, no longer missing; new ones are added now."""
    both = files.alias("o").join(walk.select("key", F.col("size").alias("_size"), F.lit(True).alias("_w")), "key", "full_outer")
    found = F.coalesce("_w", F.lit(False))
    return both.select(
        "key", F.coalesce("_size", "size").alias("size"), F.when(found, F.lit(now)).otherwise(F.col("seenAt")).cast("long").alias("seenAt"),
        F.when(F.col("o.seenAt").isNull() & found, F.coalesce("addedAt", F.lit(now))).otherwise(F.col("addedAt")).cast("long").alias("addedAt"),
        F.when(~found, F.col("missingSinceMs")).cast("long").alias("missingSinceMs"),
    )


def reconcile(files: DataFrame, walked: DataFrame, now: int, ttl_days: int = 3, whole: bool = True) -> DataFrame:
    """files after a walk that saw keys: unseen ones are marked missing, those marked for longer than the TTL go. A partial walk changes nothing."""
    if not whole:
        return files
    rows = files.join(walked.select("key", F.lit(True).alias("_seen")).distinct(), "key", "left")
    since = F.when(F.col("_seen"), F.lit(None)).otherwise(F.coalesce("missingSinceMs", F.lit(now))).cast("long")
    return rows.withColumn("missingSinceMs", since).where(F.col("missingSinceMs").isNull() | (now - F.col("missingSinceMs") <= ttl_days * DAY)).drop("_seen")


def mirrored(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """What makes held (key) like wanted (key): key and change, set or clear."""
    both = wanted.select("key", F.lit(True).alias("_w")).join(held.select("key", F.lit(True).alias("_h")), "key", "full_outer")
    return both.where(F.col("_w").isNull() | F.col("_h").isNull()).select("key", F.when(F.col("_w"), "set").otherwise("clear").alias("change"))


def removed(files: DataFrame, tombstones: DataFrame, hits: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Both tables after all hits (key) are removed: the tombstones are written first."""
    marks = tombstones.unionByName(hits.select("key", F.lit(now).cast("long").alias("removedAt")))
    return delete(files, hits), marks.groupBy("key").agg(F.max("removedAt").alias("removedAt"))


def in_work_order(path: str = "key") -> list[Column]:
    """Largest priority first, then shallow folders, then the path."""
    return [F.desc_nulls_last("scanPriority"), F.size(F.split(path, "/")), F.col(path)]


def in_name_order(path: str = "key") -> list[Column]:
    """By the name without its folders, whatever its case and accents, then by path."""
    return [F.collate(base_of(F.col(path)), "UNICODE_CI_AI"), F.col(path)]


def skipped(files: DataFrame, keys: DataFrame) -> DataFrame:
    """files with some taken out of all later scans."""
    rows = files.join(keys.select("key", F.lit(True).alias("_skip")).distinct(), "key", "left")
    return rows.withColumn("scanBlacklisted", F.coalesce("_skip", "scanBlacklisted")).drop("_skip")


def metadata_work(files: DataFrame, mode: str = "auto") -> DataFrame:
    """auto: another version than now; missing: no thumbnail; force: all. Blacklisted files never."""
    stale = ~F.col("metadataVersion").eqNullSafe(F.lit(VERSION))
    return files.where(~F.coalesce("scanBlacklisted", F.lit(False)) & {"auto": stale, "missing": F.col("thumbW").isNull() if "thumbW" in files.columns else F.lit(True), "force": F.lit(True)}[mode])


def keyframe_work(files: DataFrame) -> DataFrame:
    """Metadata done and not failed, keyframes not of this version."""
    return files.where(~F.coalesce("scanBlacklisted", F.lit(False)) & (F.col("metadataVersion") == VERSION) & ~F.col("keyframesVersion").eqNullSafe(F.lit(VERSION)) & (F.coalesce("extractionError", F.lit("")) == ""))


def face_work(files: DataFrame, characters: DataFrame, frames: DataFrame, newer_redone: bool = False) -> DataFrame:
    """Files (gates as for keyframes, and those done) whose faces are to be found.

    newer_redone: any other version counts, else only older ones, and also files whose rows are missing in either table, unless they are known to have no faces.
    """
    ready = files.where(~F.coalesce("scanBlacklisted", F.lit(False)) & (F.col("keyframesVersion") == VERSION) & (F.coalesce("extractionError", F.lit("")) == ""))
    version = F.coalesce("facesVersion", F.lit(0))
    if newer_redone:
        return ready.where(version != VERSION)
    both = characters.select("fileKey").distinct().join(frames.select("fileKey").distinct(), "fileKey").select(F.col("fileKey").alias("key"), F.lit(True).alias("_rows"))
    lost = F.col("_rows").isNull() & ~F.coalesce("facesEmpty", F.lit(False)) & (version == VERSION)
    return ready.join(both, "key", "left").where((version < VERSION) | lost).drop("_rows")


def attempted(files: DataFrame, working: DataFrame, counter: str = "metaAttempts") -> DataFrame:
    """files with one more attempt for those worked on, and gaveUp where there were too many."""
    rows = files.join(working.select("key", F.lit(1).alias("_try")), "key", "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_try", F.lit(0))).drop("_try")
    return rows.withColumn("gaveUp", F.col(counter) > MAX_ATTEMPTS)


def forced(files: DataFrame, keys: DataFrame, priority: int) -> DataFrame:
    """files with the versions of some taken away and those first in the queue, so that all work is done again."""
    rows = files.join(keys.select("key", F.lit(True).alias("_again")), "key", "left")
    again = F.coalesce("_again", F.lit(False))
    cleared = {c: F.when(~again, F.col(c)) for c in ("metadataVersion", "keyframesVersion", "facesVersion")}
    return rows.withColumns(cleared | {"scanPriority": F.when(again, F.lit(priority).cast("long")).otherwise(F.col("scanPriority")), "scanBlacklisted": F.when(again, False).otherwise(F.col("scanBlacklisted"))}).drop("_again")


PHASES = ("metadata", "keyframes", "faces")


def phases(changed: Column) -> list[Column]:
    """Settings (columns of the names in PHASES) after the one that changed names: a phase that is off takes the later ones off, one that is on takes the earlier ones on."""
    place, on = F.array_position(F.array(*map(F.lit, PHASES)), changed) - 1, F.element_at(F.map_from_arrays(F.array(*map(F.lit, PHASES)), F.array(*map(F.col, PHASES))), changed)
    return [F.when(on & (i < place), True).when(~on & (i > place), False).otherwise(F.col(p)).alias(p) for i, p in enumerate(PHASES)]


def phase_counts(files: DataFrame) -> DataFrame:
    """One row: totals, what is left of each phase, failures, bytes."""
    done = lambda c: F.count_if(F.col(c) == VERSION)
    return files.agg(F.count("*").alias("total"), F.greatest(F.lit(0), F.count("*") - done("metadataVersion")).alias("metadataLeft"), F.greatest(F.lit(0), F.count("*") - done("keyframesVersion")).alias("keyframesLeft"), F.count_if(F.coalesce("extractionError", F.lit("")) != "").alias("failed"), F.sum("size").alias("bytes"))


def phase_totals(files: DataFrame) -> DataFrame:
    """A row for each phase: files still to do (not blacklisted; for the later phases none that failed), those done without a picture (metadata only), and the time spent."""
    listed, failed = ~F.coalesce("scanBlacklisted", F.lit(False)), F.coalesce("extractionError", F.lit("")) != ""
    todo = lambda c: ~F.coalesce(F.col(c) == VERSION, F.lit(False))
    bare = (F.col("metadataVersion") == VERSION) & ~F.coalesce(F.col("thumbW") > 0, F.lit(False))
    one = files.agg(
        F.count_if(listed & todo("metadataVersion")).alias("l0"), F.count_if(listed & ~failed & todo("keyframesVersion")).alias("l1"), F.count_if(listed & ~failed & todo("facesVersion")).alias("l2"),
        F.count_if(bare).alias("e0"), *(F.coalesce(F.sum(f"{p}Ms"), F.lit(0)).alias(f"m{i}") for i, p in enumerate(("metadata", "keyframes", "faces"))),
    )
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), F.col(f"l{i}").alias("left"), (F.col("e0") if i == 0 else F.lit(None).cast("long")).alias("errored"), F.col(f"m{i}").cast("double").alias("ms")) for i, p in enumerate(("metadata", "keyframes", "faces"))))).alias("x")
    return one.select(each).select("x.*")


def table_stats(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each column: rows that have it and its bytes as text; and for the whole, the share of rows that repeat a key."""
    wide = table.agg(F.count("*").alias("rows"), (1 - F.count_distinct(key) / F.count("*")).alias("duplicates"), *(x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.sum(F.octet_length(F.col(c).cast("string"))).alias(f"b_{c}"))))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("filled"), F.col(f"b_{c}").alias("bytes")) for c in columns))).alias("x")
    return wide.select("rows", "duplicates", each).select("x.*", "rows", "duplicates")
