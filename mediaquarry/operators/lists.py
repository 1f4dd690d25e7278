"""Lists: their sizes, order and members, and changes of rank and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import collated, owner_of, slug


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("listKey").agg(F.count("*").alias("items"), F.max("addedAt").alias("lastAdded"))


def display_order(lists: DataFrame, members: DataFrame, recent_key: str = "recent-videos") -> DataFrame:
    """Lists (key, name, createdAt, order, pinned) with place: the built-in one, pinned ones by order, the others by what was added last; ties by name."""
    rows = lists.join(sizes(members).select(F.col("listKey").alias("key"), "lastAdded"), "key", "left")
    pinned = F.coalesce("pinned", F.lit(False))
    by = [F.when(F.col("key") == recent_key, 0).when(pinned, 1).otherwise(2), F.when(pinned, F.col("order")), F.when(~pinned, -F.coalesce("lastAdded", "createdAt")), collated(F.col("name")), F.col("key")]
    return rows.select("key", "name", F.row_number().over(W.orderBy(*by)).alias("place"))


def in_order(members: DataFrame, activity: Column) -> DataFrame:
    """Members with place in their list: ranked ones by rank, then the others by activity, latest first; ties by item."""
    order = W.partitionBy("listKey").orderBy(F.asc_nulls_last("rank"), F.when(F.col("rank").isNull(), -activity), "itemKey")
    return members.withColumn("place", F.row_number().over(order))


def with_activity(members: DataFrame, videos: DataFrame, series: DataFrame) -> DataFrame:
    """members (itemKey, itemType) with activity: when they were added, or last played (videos, series: key, played), whichever is later."""
    played = videos.select(F.lit("video").alias("itemType"), F.col("key").alias("itemKey"), "played").unionByName(series.select(F.lit("series").alias("itemType"), F.col("key").alias("itemKey"), "played"))
    return members.join(played, ["itemType", "itemKey"], "left").withColumn("activity", F.greatest("addedAt", F.coalesce("played", F.lit(0)))).drop("played")


def item_lists(members: DataFrame, ordered_lists: DataFrame, item: object) -> DataFrame:
    """Lists that hold an item, in display order."""
    mine = members.where(F.col("itemKey") == F.lit(item)).select(F.col("listKey").alias("key"))
    return ordered_lists.join(mine, "key", "left_semi")


def completions(lists: DataFrame, text: str) -> DataFrame:
    """Lists whose name holds text: those that begin with it first."""
    t, name = text.strip().lower(), F.lower("name")
    rows = lists.where(F.contains(name, F.lit(t)) & F.lit(bool(t)))
    return rows.select("key", "name", F.row_number().over(W.orderBy(F.when(F.startswith(name, F.lit(t)), 0).otherwise(1), "place", "key")).alias("match"))


def with_rank(members: DataFrame, list_key: str, item: object, rank: int) -> DataFrame:
    """members after item takes rank in a list: who sits there moves on by one, and so on as far as the ranks that follow are taken."""
    mine = F.col("listKey") == list_key
    moved = mine & (F.col("itemKey") == F.lit(item))
    taken = members.where(mine & ~moved & (F.col("rank") >= rank)).select("rank").distinct()
    run = taken.withColumn("island", F.col("rank") - F.row_number().over(W.orderBy("rank"))).where(F.col("island") == rank - 1).select(F.col("rank").alias("_taken"), F.lit(True).alias("_moves"))
    rows = members.join(run, mine & ~moved & (F.col("rank") == F.col("_taken")), "left")
    return rows.withColumn("rank", F.when(moved, F.lit(rank).cast("long")).when(F.col("_moves"), F.col("rank") + 1).otherwise(F.col("rank"))).drop("_taken", "_moves")


def at_position(ordered: DataFrame, key: str, position: int) -> DataFrame:
    """Lists (key, place) after key goes to a place from 1: the new order is ten times the place."""
    n = F.count("*").over(W.partitionBy())
    target = F.greatest(F.lit(1), F.least(F.lit(position), n))
    own = F.max(F.when(F.col("key") == key, F.col("place"))).over(W.partitionBy())
    rows = ordered.withColumns({"_target": target, "_own": own})
    closed = F.col("place") - F.when(F.col("place") > F.col("_own"), 1).otherwise(0)
    place = F.when(F.col("_own").isNull(), F.col("place")).when(F.col("key") == key, F.col("_target")).otherwise(closed + F.when(closed >= F.col("_target"), 1).otherwise(0))
    return rows.select("key", (place * 10).cast("long").alias("order"))


def swapped(ordered: DataFrame, key: str, step: int) -> DataFrame:
    """Pinned lists (key, order) after key changes places with its neighbour, step -1 above or 1 below; none there: nothing changes."""
    w = W.orderBy("order", "key")
    rows = ordered.withColumns({"_up": F.lag(F.struct("key", "order")).over(w), "_down": F.lead(F.struct("key", "order")).over(w)})
    towards, back = ("_up", "_down") if step < 0 else ("_down", "_up")
    moved = F.when(F.col("key") == key, F.coalesce(F.col(towards)["order"], F.col("order"))).when(F.col(back)["key"] == key, F.col(back)["order"]).otherwise(F.col("order"))
    return rows.select("key", moved.alias("order"))


def without_list(lists: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after a list goes."""
    return lists.where(F.col("key") != key), members.where(F.col("listKey") != key)


def without_item(lists: DataFrame, members: DataFrame, list_key: str, item: object) -> tuple[DataFrame, DataFrame]:
    """Both tables after an item leaves a list; a list that this empties goes too."""
    rest = members.where((F.col("listKey") != list_key) | (F.col("itemKey") != F.lit(item)))
    empty = (F.col("key") == list_key) & ~F.col("_held")
    held = rest.where(F.col("listKey") == list_key).select(F.col("listKey").alias("key"), F.lit(True).alias("_held")).distinct()
    return lists.join(held, "key", "left").withColumn("_held", F.coalesce("_held", F.lit(False))).where(~empty).drop("_held"), rest


def picker_order(lists: DataFrame, members: DataFrame, recent_key: str = "recent-videos") -> DataFrame:
    """Lists by when something was added to them, else when they were made, latest first; ties by name; not the built-in one."""
    rows = lists.where(F.col("key") != recent_key).join(sizes(members).select(F.col("listKey").alias("key"), "lastAdded"), "key", "left")
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.coalesce("lastAdded", "createdAt")), collated(F.col("name")), "key")))  # a row for each list


def created(lists: DataFrame, name: str, now: int) -> DataFrame:
    """lists with one more of that name, unless one has it already (case apart). Its key is the name's slug, or list-<now> where nothing is left of it; -2, -3 … where that is taken; it comes last in order."""
    trimmed = name.strip()
    if not trimmed:
        raise ValueError("a list needs a name")
    base = lists.sparkSession.range(1).select(F.coalesce(F.nullif(slug(F.lit(trimmed)), F.lit("")), F.lit(f"list-{now}")).alias("base"))
    taken = lists.crossJoin(base).select(F.when(F.col("key") == F.col("base"), 1).otherwise(F.expr("try_cast(if(startswith(key, base || '-'), substring(key, length(base) + 2), null) AS int)")).alias("k")).where(F.col("k") >= 1).distinct()
    free = taken.withColumn("island", F.col("k") - F.row_number().over(W.orderBy("k"))).agg(F.coalesce(F.max(F.when(F.col("island") == 0, F.col("k"))), F.lit(0)).alias("last"))
    facts = lists.agg(F.coalesce(F.max("order"), F.lit(0.0)).alias("top"), F.coalesce(F.bool_or(F.lower("name") == trimmed.lower()), F.lit(False)).alias("there"))
    key = F.when(F.col("last") == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("last") + 1).cast("string")))
    new = base.crossJoin(free).crossJoin(facts).where(~F.col("there")).select(key.alias("key"), F.lit(trimmed).alias("name"), F.lit(now).cast("long").alias("createdAt"), (F.greatest("top", F.lit(0.0)) + 1).alias("order"), F.lit(False).alias("pinned"))
    return lists.unionByName(new.select(*lists.columns))


def toggled(selection: Column, item: Column) -> Column:
    """A selection (array) without the item, or with it as its last if it isn't there."""
    return F.when(F.array_contains(selection, item), F.array_remove(selection, item)).otherwise(F.array_append(F.array_distinct(selection), item))


def sizes_by_prefix(members: DataFrame, list_key: str) -> DataFrame:
    """How many items a list has, from keys listKey#item alone: the list is what stands before the last #."""
    rows = members.select(owner_of(F.col("key")).alias("listKey")).where(F.col("listKey") == list_key)
    return rows.groupBy("listKey").agg(F.count("*").alias("items"))
