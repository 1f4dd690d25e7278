"""What a scan does next and how long it takes: picks, logs, gates, guards and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.adapters import VERSION

FRESH_MS = 24 * 3_600_000
KEPT_ERRORS, SHOWN_ERRORS, RECENT = 200, 100, 1000


def unscanned(keyframes: bool = True, faces: bool = True) -> Column:
    """Neither blacklisted nor done with every phase that is on."""
    todo = lambda c: ~F.coalesce(F.col(c) == VERSION, F.lit(False))
    left = todo("metadataVersion")
    for on, column in ((keyframes, "keyframesVersion"), (faces, "facesVersion")):
        left = left | todo(column) if on else left
    return ~F.coalesce("scanBlacklisted", F.lit(False)) & left


def scan_table(files: DataFrame, limit: int = 100) -> DataFrame:
    """Files touched last, then scanned last (ties by key), with their place."""
    keys = [F.desc(F.coalesce("lastTouchedAt", F.lit(0))), F.desc(F.coalesce("lastScanAt", F.lit(0))), F.col("key")]
    return files.orderBy(*keys).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*keys)))


def kept_errors(log: DataFrame, most: int = KEPT_ERRORS) -> DataFrame:
    """The newest entries of a log (key, at): what is left of it after one is added."""
    return log.orderBy(F.desc("at"), F.desc("key")).limit(most)


def shown_errors(log: DataFrame, most: int = SHOWN_ERRORS) -> DataFrame:
    keys = [F.desc("at"), F.desc("key")]
    return log.orderBy(*keys).limit(most).withColumn("place", F.row_number().over(W.orderBy(*keys)))


def recent_keys(views: DataFrame, most: int = RECENT) -> DataFrame:
    """Keys by when they were last in view (key, at): key, place from 1, as many as are remembered."""
    keys = [F.desc("at"), F.col("key")]
    return views.groupBy("key").agg(F.max("at").alias("at")).orderBy(*keys).limit(most).select("key", F.row_number().over(W.orderBy(*keys)).alias("place"))


def next_file(eligible: DataFrame, visible: DataFrame, recent: DataFrame, filtered: DataFrame, timed_out: DataFrame) -> DataFrame:
    """One row: the file to work on. Those that never timed out first; then those in view, seen lately, in the result shown, the rest; by place there, or by key."""
    rows = eligible.select("key")
    for i, tier in enumerate((visible, recent, filtered)):
        rows = rows.join(tier.groupBy("key").agg(F.min("place").alias(f"_p{i}")), "key", "left")
    rows = rows.join(timed_out.select("key", F.lit(1).alias("_late")).distinct(), "key", "left")
    tier = F.when(F.col("_p0").isNotNull(), 0).when(F.col("_p1").isNotNull(), 1).when(F.col("_p2").isNotNull(), 2).otherwise(3)
    place = F.when(tier == 3, 0).otherwise(F.coalesce("_p0", "_p1", "_p2"))
    return rows.select("key", F.coalesce("_late", F.lit(0)).alias("late"), tier.alias("tier"), place.alias("place")).orderBy("late", "tier", "place", "key").limit(1)


def fresh(done: DataFrame, root: str, now: int, age_ms: int = FRESH_MS) -> DataFrame:
    """Phases whose last whole pass (root, phase, at) over this root is young enough not to be done again: phase, fresh."""
    last = done.where(F.col("root") == root).groupBy("phase").agg(F.max("at").alias("at"))
    return last.select("phase", F.coalesce((F.col("at") > 0) & (now - F.col("at") < age_ms), F.lit(False)).alias("fresh"))


def without_info(files: DataFrame) -> DataFrame:
    """Files whose size or time of change is not known yet."""
    return files.where(F.col("size").isNull() | F.col("fileModifiedAt").isNull())


def with_durations(files: DataFrame, played: DataFrame) -> DataFrame:
    """files after players told durations (key, durationMs): written where none is stored or it is a second off."""
    told = played.where(F.col("durationMs") > 0).groupBy("key").agg((F.max("durationMs") / 1000).alias("_d"))
    rows = files.join(told, "key", "left")
    write = F.col("_d").isNotNull() & (F.col("durationSec").isNull() | (F.abs(F.col("durationSec") - F.col("_d")) >= 1))
    return rows.withColumn("durationSec", F.when(write, F.col("_d")).otherwise(F.col("durationSec"))).drop("_d")


def ignored_with_stats(ignored: DataFrame, folders: DataFrame, path: str, now: int) -> DataFrame:
    """ignored (key, …) with one more folder and what is known of it now (folders: folder, files, bytes, folders)."""
    row = folders.where(F.col("folder") == path).select(F.col("folder").alias("key"), F.lit(now).cast("long").alias("ignoredAt"), F.col("files").alias("totalFiles"), F.col("folders").alias("folderCount"))
    return ignored.where(F.col("key") != path).unionByName(row, allowMissingColumns=True)


def media_eta(state: DataFrame, left: DataFrame) -> DataFrame:
    """Estimates of runs (run, elapsedSec, doneSec, filesDone, currentSec, positionMs) with files still to come (run, durationSec or null): run, etaSec, basis.

    By seconds of media a second, unknown durations taken as the mean of what is known (files done, the current one, those to
    come); before any media time is known by files a second; before any file is done there is none.
    """
    known = F.col("durationSec") > 0
    sums = left.groupBy("run").agg(F.sum(F.when(known, F.col("durationSec"))).alias("_sum"), F.count_if(known).alias("_known"), F.count_if(~F.coalesce(known, F.lit(False))).alias("_unknown"))
    rows = state.join(sums, "run", "left").fillna(0, ["_sum", "_known", "_unknown"])
    current = F.coalesce("currentSec", F.lit(0.0))
    raw = F.greatest(F.lit(0.0), F.coalesce("positionMs", F.lit(0.0)) / 1000)
    flight = F.when(current > 0, F.least(raw, current)).otherwise(raw)
    processed = F.col("doneSec") + flight
    count = F.col("filesDone") + F.when(current > 0, 1).otherwise(0) + F.col("_known")
    mean = F.when(count > 0, (F.col("doneSec") + F.when(current > 0, current).otherwise(0.0) + F.col("_sum")) / count).otherwise(0.0)
    remaining = F.greatest(F.lit(0.0), current - flight) + F.col("_sum") + F.col("_unknown") * mean
    files = F.col("_known") + F.col("_unknown") + F.when(current > 0, 1).otherwise(0)
    basis = F.when(F.col("elapsedSec") <= 0, "none").when(processed > 0, "media").when(F.col("filesDone") > 0, "files").otherwise("none")
    eta = F.when(basis == "media", remaining / (processed / F.col("elapsedSec"))).when(basis == "files", files / (F.col("filesDone") / F.col("elapsedSec")))
    return rows.select("run", eta.alias("etaSec"), basis.alias("basis"))


def count_eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left of total files, done of which took so long; null before there is a rate."""
    return F.when((done > 0) & (elapsed > 0), F.greatest(F.lit(0), total - done) / (done / elapsed))


def live_eta(learned: Column, elapsed: Column, fraction: Column, after: Column) -> Column:
    """Milliseconds left, and per file, while one is worked on: a file takes the learned time, or longer if this one already does: etaMs, perItemMs."""
    projected = F.when(fraction > 0.01, elapsed / fraction)
    each = F.greatest(F.coalesce(learned, F.lit(0.0)), F.coalesce(projected, elapsed))
    rest = F.greatest(F.lit(0.0), F.coalesce(projected, each) - elapsed)
    return F.when(each > 0, F.struct((rest + after * each).alias("etaMs"), each.alias("perItemMs")))


def aborted(elapsed: Column, current: Column, duration: Column, backlog: Column, small: int = 10) -> Column:
    """Whether a face scan is given up: over six minutes, or bound for more than 500 s after half a minute; four times as long where little else waits."""
    times = F.when(backlog <= small, 4).otherwise(1)
    projected = F.when((current > 0) & (duration > 0), elapsed * (duration / current))
    return (elapsed > 360_000 * times) | F.coalesce((elapsed > 30_000 * times) & (projected > 500_000 * times), F.lit(False))
