"""Library search: filters, collapse into series tiles, order, pages, and labels along the order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import base_of, collated, duration_bucket, fnv1a, letter_bucket, match_filter, month_bucket
from ..sources.adapters import VERSION
from . import series, tables

UNGROUPED = (1 << 31) - 1


@dataclass(frozen=True)
class Search:
    query: str = ""
    mode: str = "hybrid"  # hybrid, flat, movies, series
    order: str = "date"  # date, name, duration, watched, shuffle
    reverse: bool = False
    seed: str = ""
    min_minutes: float | None = None
    max_minutes: float | None = None
    errors: bool = False
    faces: bool = False
    keyframes: bool = False
    invert: bool = False
    least: int = series.SERIES_MIN
    most: int = series.SERIES_MAX
    lists: Sequence[str] = field(default=())  # lists that the query matches, in display order


def lists_named(lists: DataFrame, query: str) -> DataFrame:
    """Lists (key, name, place in display order) whose name the query matches."""
    return lists.where(match_filter(query, F.col("name")))


def members_of(members: DataFrame, matched: DataFrame) -> DataFrame:
    """members (listKey, itemKey) of matched lists with grp, the list's place: what hits and tiles take as members."""
    return members.join(matched.select(F.col("key").alias("listKey"), F.col("place").cast("int").alias("grp")), "listKey").select("itemKey", "grp")


def tags(search: Search, members: DataFrame | None) -> DataFrame | None:
    """(key, grp): the first of the search's lists that holds an item; None where no lists are searched."""
    if members is None or not (search.lists or "grp" in members.columns):
        return None
    if "grp" not in members.columns:
        place = F.array_position(F.array(*map(F.lit, search.lists)), F.col("listKey")) - 1
        members = members.where(F.col("listKey").isin(*search.lists)).withColumn("grp", place)
    return members.groupBy(F.col("itemKey").alias("key")).agg(F.min("grp").cast("int").alias("grp"))


def hits(files: DataFrame, search: Search, members: DataFrame | None = None) -> DataFrame:
    """Rows that pass all filters, with grp: the first matched list that holds them. members: listKey, itemKey (lists as the search names them), or itemKey, grp (members_of)."""
    rows = files.where(F.col("name").isNotNull() & F.col("relativePath").isNotNull())
    text = match_filter(search.query, F.col("relativePath"))
    tagged = tags(search, members)
    if tagged is not None:
        rows = rows.join(tagged, "key", "left").withColumn("grp", F.coalesce("grp", F.lit(UNGROUPED))).where(text | (F.col("grp") < UNGROUPED))
    else:
        rows = rows.where(text).withColumn("grp", F.lit(UNGROUPED))
    if search.min_minutes is not None or search.max_minutes is not None:
        d = F.col("durationSec")
        rows = rows.where((d > 0) & (d >= 60 * (search.min_minutes or 0)) & (F.lit(search.max_minutes is None) | (d <= 60 * (search.max_minutes or 0))))
    active = []
    if search.errors:
        active.append(F.coalesce("extractionError", F.lit("")) != "")
    if search.faces:
        active.append(F.coalesce("characterCount", F.lit(0)) > 0)
    if search.keyframes:
        active.append(F.coalesce(F.col("keyframesVersion") == VERSION, F.lit(False)))
    for has in active:
        rows = rows.where(has != F.lit(search.invert))
    return rows


def tiles(files: DataFrame, search: Search, members: DataFrame | None = None) -> DataFrame:
    """One row for each tile, series found in the whole library before filtering: key, isSeries, files, and the values it is ordered by."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    values = [zero("fileModifiedAt").alias("modified"), F.coalesce("durationSec", F.lit(0.0)).alias("duration"), zero("positionUpdatedAt").alias("watched"), "grp"]
    if search.mode == "flat":
        return hits(files, search, members).select("key", F.lit(False).alias("isSeries"), F.lit(1).cast("long").alias("files"), "name", *values)
    foldered = series.with_folder(files)
    found = series.series_of(foldered, search.least, search.most).select("folder", F.lit(True).alias("inSeries"))
    rows = hits(foldered, search, members).join(found, "folder", "left").withColumn("inSeries", F.coalesce("inSeries", F.lit(False)))
    single = rows.where(~F.col("inSeries")).select("key", F.lit(False).alias("isSeries"), F.lit(1).cast("long").alias("files"), "name", *values)
    grouped = rows.where("inSeries").select("folder", *values).groupBy("folder").agg(F.count("*").alias("files"), F.max("modified").alias("modified"), F.max("duration").alias("duration"), F.max("watched").alias("watched"), F.min("grp").alias("grp"))
    whole = grouped.select(F.col("folder").alias("key"), F.lit(True).alias("isSeries"), "files", base_of(F.col("folder")).alias("name"), "modified", "duration", "watched", "grp")
    tagged = tags(search, members)
    if tagged is not None and search.mode != "movies":  # a list may hold the series itself
        whole = whole.join(tagged.withColumnRenamed("grp", "own"), "key", "left").withColumn("grp", F.least("grp", F.coalesce("own", F.lit(UNGROUPED)))).drop("own")
    return {"movies": single, "series": whole}.get(search.mode, single.unionByName(whole))


def ordering(search: Search) -> list[Column]:
    """Sort keys of tiles: lists first, then the order with ties by name, all of it turned round if reversed, then the key."""
    first = {"date": [F.col("modified").desc()], "name": [], "duration": [F.col("duration").desc()], "watched": [F.col("watched").desc()], "shuffle": [fnv1a(F.concat("key", F.lit(search.seed))).asc()]}[search.order]
    keys = [*first, collated(F.col("name")).asc()]
    if search.reverse:
        turned = {"date": [F.col("modified").asc()], "name": [], "duration": [F.col("duration").asc()], "watched": [F.col("watched").asc()], "shuffle": [fnv1a(F.concat("key", F.lit(search.seed))).desc()]}[search.order]
        keys = [*turned, collated(F.col("name")).desc()]
    return [F.col("grp").asc(), *keys, F.col("key").desc() if search.reverse else F.col("key").asc()]


def page(found: DataFrame, search: Search, offset: int = 0, limit: int = 100) -> DataFrame:
    """Tiles [offset, offset + limit) of the order with their position. Only that many rows of each task are kept."""
    keys = ordering(search)
    top = found.orderBy(*keys).limit(offset + limit)
    return top.withColumn("position", F.row_number().over(W.orderBy(*keys)) - 1).where(F.col("position") >= offset)


def in_order(found: DataFrame, search: Search) -> DataFrame:
    """All tiles with their position in the order, however many."""
    return tables.numbered(found, ordering(search))


def labels(ordered: DataFrame, order: str, block: int = 100_000) -> DataFrame:
    """Where along positions a new bucket starts: position, label. Rows of lists have no bucket and end one. Blocks of positions are looked at apart, each with the last label of the one before."""
    bucket = {"name": letter_bucket(F.col("name")), "duration": duration_bucket(F.col("duration")), "date": month_bucket(F.col("modified")), "watched": month_bucket(F.col("watched"))}[order]
    rows = ordered.select("position", F.when(F.col("grp") == UNGROUPED, bucket).alias("label"), F.expr(f"position div {block}").alias("block"))
    last = rows.where(F.col("position") % block == block - 1).select((F.col("block") + 1).alias("block"), F.col("label").alias("_last"))
    inside = F.lag("label").over(W.partitionBy("block").orderBy("position"))
    seen = rows.withColumn("before", inside).join(last, "block", "left").withColumn("before", F.when(F.col("position") % block == 0, F.col("_last")).otherwise(F.col("before")))
    return seen.where(F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("before"))).select("position", "label")


def segments(ordered: DataFrame) -> DataFrame:
    """Runs of the same list along positions: grp, start, end (exclusive)."""
    rows = ordered.where(F.col("grp") < UNGROUPED)
    island = F.col("position") - F.row_number().over(W.partitionBy("grp").orderBy("position"))
    return rows.withColumn("island", island).groupBy("grp", "island").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end")).drop("island")


def whole_segments(found: DataFrame) -> DataFrame:
    """segments() of all tiles in order, however many: lists come first in it, so a list starts after all tiles of those before it."""
    counts = found.where(F.col("grp") < UNGROUPED).groupBy("grp").agg(F.count("*").alias("n"))
    end = F.sum("n").over(W.orderBy("grp"))  # a row for each list
    return counts.select("grp", (end - F.col("n")).cast("int").alias("start"), end.cast("int").alias("end"))


def recent(files: DataFrame, limit: int = 20) -> DataFrame:
    """The videos added or played last, valid ones only."""
    rows = files.where(F.col("addedAt").isNotNull() & F.col("name").isNotNull() & F.col("relativePath").isNotNull())
    return rows.select("key", "addedAt", F.greatest("addedAt", F.coalesce("positionUpdatedAt", F.lit(0))).alias("at")).orderBy(F.desc("at"), "key").limit(limit)


def hits_and_series(files: DataFrame, search: Search, cap: int = 20) -> DataFrame:
    """Flat hits by order and the series that hold them, series first in order of first sight: kind, key, idx, totalMatches (of all, shown or not); at most cap of them are shown.

    A series is seen first at its first hit, one row of at most `most`; the order is taken of those and of the hits, cap of each.
    """
    foldered = series.with_folder(files)
    found = tiles(files, Search(**{**search.__dict__, "mode": "flat"}))
    keys = ordering(search)
    inside = found.join(foldered.select("key", "folder"), "key").join(series.series_of(foldered, search.least, search.most).select("folder"), "folder")
    first = inside.withColumn("_n", F.row_number().over(W.partitionBy("folder").orderBy(*keys))).where(F.col("_n") == 1).drop("_n")
    counted = found.agg(F.count("*").alias("_a")).crossJoin(first.agg(F.count("*").alias("_b"))).select((F.col("_a") + F.col("_b")).alias("totalMatches"))

    def shown(rows: DataFrame, kind: str, tier: int, key: str) -> DataFrame:
        top = rows.orderBy(*keys).limit(cap)
        return top.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(tier).alias("tier"), F.row_number().over(W.orderBy(*keys)).alias("place"))

    both = shown(first, "series", 0, "folder").unionByName(shown(found, "video", 1, "key")).orderBy("tier", "place").limit(cap)
    return both.crossJoin(counted).select("kind", "key", (F.row_number().over(W.orderBy("tier", "place")) - 1).alias("idx"), "totalMatches")
