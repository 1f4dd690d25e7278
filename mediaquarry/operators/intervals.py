"""Joins and folds along time. Points and spans are in ms; a file's rows stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _merged(left: DataFrame, right: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """Both tables' rows along time; right's come first (_side 0) where times are equal."""
    a = left.select(by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(by, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    return a.unionByName(b)


def as_of(left: DataFrame, right: DataFrame, by: str, t: str, value: str, out: str) -> DataFrame:
    """left with the value of right's last row at or before its time in the same group (of equal times the largest value); one sort, no join of pairs."""
    w = W.partitionBy(by).orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _merged(left, right, by, t, value).withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return rows.select("_row.*", F.col("_found").alias(out))


def as_of_next(left: DataFrame, right: DataFrame, by: str, t: str, value: str, out: str) -> DataFrame:
    """left with the value of right's first row at or after its time, or else of its last row."""
    after = W.partitionBy(by).orderBy(F.desc("_t"), "_side", F.desc("_v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _merged(left, right, by, t, value).withColumn("_next", F.last("_v", ignorenulls=True).over(after))
    last = right.groupBy(by).agg(F.max_by(value, F.struct(t, value)).alias("_last"))
    return rows.where(F.col("_side") == 1).join(last, by, "left").select("_row.*", F.coalesce("_next", "_last").alias(out))


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, t: str, out: str) -> DataFrame:
    """left with right's time nearest to its own (ties: the earlier)."""
    times = right.select(by, t).withColumn("_x", F.col(t)).drop(t).withColumnRenamed("_x", t)
    before = as_of(left, times.withColumn("_v0", F.col(t)), by, t, "_v0", "_before")
    both = as_of_next(before, times.withColumn("_v1", F.col(t)), by, t, "_v1", "_after")
    pick = F.when(F.col("_before").isNull(), F.col("_after")).when(F.col("_after") - F.col(t) >= F.col(t) - F.col("_before"), F.col("_before")).when(F.col("_after") < F.col(t), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn(out, pick).drop("_before", "_after")


def _level(length: Column, bucket_ms: int) -> Column:
    """The least level whose buckets, twice as wide at each level, are as wide as a span, so that it lies in two of them at most."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)) / bucket_ms)), F.lit(0)).cast("int")


def _levels(*spans: DataFrame) -> list[int]:
    """Levels that some spans have: as many as their lengths have powers of two, some dozens."""
    both = spans[0].select("_l")
    for s in spans[1:]:
        both = both.unionByName(s.select("_l"))
    return sorted(r._l for r in both.distinct().collect())


def _width(level: str, bucket_ms: int) -> Column:
    return F.pow(F.lit(2.0), F.col(level)) * bucket_ms


def containing(points: DataFrame, spans: DataFrame, by: str, bucket_ms: int, early_ms: int = 0, closed: bool = True) -> DataFrame:
    """Pairs of points (by, t) and spans (by, start, end) that hold them; a point counts early_ms before a span's start, its end counts if closed.

    Spans go to buckets of time that are as wide as they are long, so that one of a year has no more copies than one of a
    second; points are looked up in the buckets of every width that there is.
    """
    first = F.col("start") - early_ms
    level = spans.where(F.col("end") >= first).withColumn("_l", _level(F.col("end") - first, bucket_ms))
    cut = level.withColumn("_b", F.explode(F.sequence(F.floor(first / _width("_l", bucket_ms)), F.floor(F.col("end") / _width("_l", bucket_ms)))))
    at = points.withColumn("_l", F.explode(F.array(*map(F.lit, _levels(level))).cast("array<int>"))).withColumn("_b", F.floor(F.col("t") / _width("_l", bucket_ms)))
    inside = (F.col("t") >= first) & ((F.col("t") <= F.col("end")) if closed else (F.col("t") < F.col("end")))
    return at.join(cut, [by, "_l", "_b"]).where(inside).drop("_l", "_b")


def overlapping(a: DataFrame, b: DataFrame, by: str, bucket_ms: int) -> DataFrame:
    """Pairs of spans that touch, ends included; a's columns with suffix 1, b's with 2.

    A span is in two buckets at most of its own width (see containing) and of each greater one that there is; a pair counts
    at the wider one's width, in the first bucket that both have.
    """
    leveled = [x.where("end >= start").withColumn("_l", _level(F.col("end") - F.col("start"), bucket_ms)) for x in (a, b)]
    levels = F.array(*map(F.lit, _levels(*leveled))).cast("array<int>")

    def cut(spans: DataFrame, n: int) -> DataFrame:
        named = spans.select(by, F.col("_l").alias(f"_l{n}"), *(F.col(c).alias(f"{c}{n}") for c in spans.columns if c not in (by, "_l")))
        wide = named.withColumn("_l", F.explode(F.filter(levels, lambda l: l >= F.col(f"_l{n}")))).withColumn(f"_first{n}", F.floor(F.col(f"start{n}") / _width("_l", bucket_ms)))
        return wide.withColumn("_b", F.explode(F.sequence(F.col(f"_first{n}"), F.floor(F.col(f"end{n}") / _width("_l", bucket_ms)))))

    both = cut(leveled[0], 1).join(cut(leveled[1], 2), [by, "_l", "_b"])
    meets = (F.col("start1") <= F.col("end2")) & (F.col("start2") <= F.col("end1")) & (F.col("_l") == F.greatest("_l1", "_l2")) & (F.col("_b") == F.greatest("_first1", "_first2"))
    return both.where(meets).drop("_b", "_l", "_l1", "_l2", "_first1", "_first2")


def bridged(points: DataFrame, by: list[str], fill_ms: int) -> DataFrame:
    """Spans of points (t) that are at most fill_ms apart: start, end, points; a lone point has no width."""
    w = W.partitionBy(*by).orderBy("t")
    new = F.when(F.col("t") - F.lag("t").over(w) <= fill_ms, 0).otherwise(1)
    rows = points.withColumn("_new", new).withColumn("_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_id").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("points")).drop("_id")


def merged_ranges(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (start, end) without empty ones, those that overlap or touch made one."""
    w = W.partitionBy(*by).orderBy("start", "end")
    furthest = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.where(F.col("end") > F.col("start")).withColumn("_new", F.when(F.col("start") <= furthest, 0).otherwise(1))
    rows = rows.withColumn("_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_id").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_id")


def neighbours(points: DataFrame, spans: DataFrame, by: str) -> DataFrame:
    """spans with before, the last point strictly before the start, and after, the first strictly after the end."""
    p = points.select(by, "t").distinct()
    earlier = as_of(spans.withColumn("t", F.col("start") - 1), p.withColumn("_v", F.col("t")).select(by, "t", "_v"), by, "t", "_v", "before")
    later = W.partitionBy(by).orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = _merged(earlier.withColumn("t", F.col("end") + 1), p.withColumn("_v", F.col("t")), by, "t", "_v").withColumn("after", F.last("_v", ignorenulls=True).over(later))
    return rows.where(F.col("_side") == 1).select("_row.*", "after").drop("t")


def filled_ends(cues: DataFrame, by: str, default_ms: int = 5000, longest_ms: int = 15000, least_ms: int = 2000) -> DataFrame:
    """cues (start, duration or null) with end: a duration over 0 as it is, else the next start or default_ms on, but at most longest_ms on; least_ms on if that isn't after the start."""
    following = F.coalesce(F.lead("start").over(W.partitionBy(by).orderBy("start", "idx")), F.col("start") + default_ms)
    end = F.when(F.col("duration") > 0, F.col("start") + F.col("duration")).otherwise(F.least(following, F.col("start") + longest_ms))
    return cues.withColumn("end", F.when(end <= F.col("start"), F.col("start") + least_ms).otherwise(end))


def running_time(deltas: DataFrame, by: str) -> DataFrame:
    """Samples of run-length coded deltas (idx, count, delta) with their number and time, the sum of all deltas before; the sums go over the coded rows."""
    before = W.partitionBy(by).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    sums = {"_samples": F.coalesce(F.sum("count").over(before), F.lit(0)), "_time": F.coalesce(F.sum(F.col("count") * F.col("delta")).over(before), F.lit(0))}
    rows = deltas.where(F.col("count") > 0).withColumns(sums).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return rows.select(by, (F.col("_samples") + F.col("_i")).cast("int").alias("sample"), (F.col("_time") + F.col("_i") * F.col("delta")).alias("time"))


def rolling_rate(reads: DataFrame, by: str, window_ms: int) -> DataFrame:
    """reads (t, amount) with the amount per second over the window that ends there, or over what there is of it."""
    w = W.partitionBy(by).orderBy("t").rangeBetween(-window_ms, 0)
    first = F.min("t").over(W.partitionBy(by))
    spent = F.least(F.lit(float(window_ms)), F.greatest(F.lit(1.0), (F.col("t") - first).cast("double")))
    return reads.withColumn("rate", F.sum("amount").over(w) * 1000.0 / spent).withColumn("slowest", F.max("amount").over(w))


def first_of_each(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of rows alike in by the first by order."""
    others = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("_first")).select(*by, "_first.*")


def extents(boxes: DataFrame, by: str) -> DataFrame:
    """How far right and down the boxes (x, y, w, h) of each group go."""
    return boxes.groupBy(by).agg(F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def first_containing(points: DataFrame, spans: DataFrame, by: str, key: list[str], bucket_ms: int, closed: bool = True) -> DataFrame:
    """For each point (by, t, key) the first of the spans that hold it, by start, then end."""
    held = containing(points, spans, by, bucket_ms, closed=closed)
    return held.groupBy(*key).agg(F.min(F.struct("start", "end")).alias("_s")).select(*key, "_s.*")
