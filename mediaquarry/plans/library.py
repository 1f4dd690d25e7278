"""Queries on search, series, folders and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import folders, lists, search, series
from ..sources import adapters
from .registry import FILES, MEMBERS, query

FLAGSHIP = search.Search(query="widget & !cold", order="duration", min_minutes=15.0, max_minutes=16.5, least=2)

TILES = """
 hit AS (SELECT * FROM foldered WHERE {where}),
 ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN {least} AND 100),
 tile AS (SELECT h.folder AS key, true AS "isSeries", count(*) AS files, regexp_extract(h.folder, '[^/]*$') AS name, max(coalesce("fileModifiedAt",0)) AS modified, max(coalesce("durationSec",0)) AS duration, max(coalesce("positionUpdatedAt",0)) AS watched FROM hit h JOIN ser USING (folder) GROUP BY 1
  UNION ALL SELECT key, false, 1, name, coalesce("fileModifiedAt",0), coalesce("durationSec",0), coalesce("positionUpdatedAt",0) FROM hit WHERE folder NOT IN (SELECT folder FROM ser))
"""
FLAT = """ tile AS (SELECT key, false AS "isSeries", CAST(1 AS BIGINT) AS files, name, coalesce("fileModifiedAt",0) AS modified, coalesce("durationSec",0) AS duration, coalesce("positionUpdatedAt",0) AS watched FROM files WHERE {where}) """
BARE = "regexp_replace(lower(key), '[^a-z0-9]', '', 'g')"
HASH = "list_reduce(list_prepend(2166136261, list_transform(string_split({x}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.tiles(adapters.files(spark, sf_dir), FLAGSHIP)
    return search.page(found, FLAGSHIP, 0, 1000).drop("grp")


def paged(s: search.Search, limit: int = 200, offset: int = 0):
    return lambda spark, sf_dir: search.page(search.tiles(adapters.files(spark, sf_dir), s), s, offset, limit).drop("grp")


def page_sql(tiles: str, order: str, limit: int = 200, offset: int = 0) -> str:
    return f"WITH {FILES}, {tiles} SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS position FROM tile) WHERE position >= {offset} AND position < {offset + limit}"


query(page_sql(TILES.format(where=f"{BARE} LIKE '%widget%' AND {BARE} NOT LIKE '%cold%' AND \"durationSec\" BETWEEN 900 AND 990", least=2), "duration DESC, name, key", 1000), "search_hybrid_duration")(flagship)

for name, s, where, order in (
    ("search_flat_name_reversed", search.Search(query="brand#1 | steel", mode="flat", order="name", reverse=True), f"lower(key) LIKE '%brand#1%' OR {BARE} LIKE '%steel%'", "name DESC, key DESC"),
    ("search_flat_date", search.Search(mode="flat", order="date"), "true", "modified DESC, name, key"),
    ("search_flat_watched_errors", search.Search(mode="flat", order="watched", errors=True), "coalesce(\"extractionError\",'') <> ''", "watched DESC, name, key"),
    ("search_flat_shuffle", search.Search(query="!hot", mode="flat", order="shuffle", seed="2024-01-01"), f"{BARE} NOT LIKE '%hot%'", HASH.format(x="key || '2024-01-01'") + ", name, key"),
    ("search_filters_inverted", search.Search(mode="flat", order="name", faces=True, keyframes=True, invert=True), 'NOT (coalesce("characterCount",0) > 0) AND NOT coalesce("keyframesVersion" = 7, false)', "name, key"),
    ("search_faces_keyframes", search.Search(query="widget|", mode="flat", order="duration", faces=True, keyframes=True, reverse=True), 'coalesce("characterCount",0) > 0 AND coalesce("keyframesVersion" = 7, false)', "duration, name DESC, key DESC"),
):
    query(page_sql(FLAT.format(where=where), order), name)(paged(s))

for mode in ("movies", "series"):
    query(page_sql(TILES.format(where="true", least=6), "name, key").replace("FROM tile)", f"FROM tile WHERE {'NOT ' if mode == 'movies' else ''}\"isSeries\")"), f"search_mode_{mode}")(paged(search.Search(mode=mode, order="name", least=6)))

query(page_sql(FLAT.format(where="true"), "name, key", 25, 50), "search_second_page")(paged(search.Search(mode="flat", order="name"), 25, 50))


def _labels(order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = search.Search(mode="flat", order=order)
        return search.labels(search.in_order(search.tiles(adapters.files(spark, sf_dir), s), s), order)

    return run


for order, by, bucket in (
    ("duration", "duration DESC, name, key", "CASE WHEN duration = 0 THEN '—' WHEN duration >= 3600 THEN floor(duration/3600)::BIGINT||'h' WHEN duration >= 600 THEN floor(duration/600)::BIGINT*10||'m' ELSE '<10m' END"),
    ("date", "modified DESC, name, key", "CASE WHEN modified = 0 THEN '—' ELSE strftime(make_timestamp(modified*1000), '%b %Y') END"),
    ("name", "name, key", "CASE WHEN regexp_matches(upper(left(trim(name),1)), '^[A-Z]$') THEN upper(left(trim(name),1)) ELSE '#' END"),
):
    query(f"WITH {FILES}, {FLAT.format(where='true')}, o AS (SELECT CAST(row_number() OVER (ORDER BY {by}) - 1 AS BIGINT) AS position, {bucket} AS label FROM tile) SELECT position, label FROM (SELECT *, lag(label) OVER (ORDER BY position) AS b FROM o) WHERE b IS DISTINCT FROM label", f"scroll_labels_{order}")(_labels(order))


@query(f"""WITH {FILES}, tag AS (SELECT key, min(g) AS grp FROM (SELECT key, CASE WHEN n % 13 = 0 THEN 0 WHEN n % 7 = 0 THEN 1 END AS g FROM files) WHERE g IS NOT NULL GROUP BY 1),
 o AS (SELECT f.key, coalesce(grp, 2147483647) AS grp, CAST(row_number() OVER (ORDER BY coalesce(grp, 2147483647), name, f.key) - 1 AS INT) AS position FROM files f LEFT JOIN tag USING (key) WHERE {BARE.replace('key', 'f.key')} LIKE '%widget%' OR grp IS NOT NULL)
 SELECT grp, min(position) AS start, max(position) + 1 AS "end" FROM o WHERE grp < 2147483647 GROUP BY 1""")
def list_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    n = F.col("n")
    members = files.select(F.when(n % 13 == 0, "first").when(n % 7 == 0, "second").alias("listKey"), F.col("key").alias("itemKey")).where(F.col("listKey").isNotNull())
    s = search.Search(query="widget", mode="flat", order="name", lists=("first", "second"))
    return search.whole_segments(search.tiles(files, s, members))


@query(f'WITH {FILES} SELECT key, "addedAt", greatest("addedAt", coalesce("positionUpdatedAt", 0)) AS "at" FROM files WHERE "addedAt" IS NOT NULL ORDER BY "at" DESC, key LIMIT 20')
def recent_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(adapters.files(spark, sf_dir))


@query(f"""WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), o AS (SELECT key, folder, row_number() OVER (ORDER BY name, key) - 1 AS p FROM foldered WHERE {BARE} LIKE '%blue%'),
 u AS (SELECT 'series' AS kind, folder AS key, 0 AS tier, min(p) AS p FROM o JOIN ser USING (folder) GROUP BY 2 UNION ALL SELECT 'video', key, 1, p FROM o) SELECT kind, key, CAST(row_number() OVER (ORDER BY tier, p) - 1 AS INT) AS idx, count(*) OVER () AS "totalMatches" FROM u QUALIFY row_number() OVER (ORDER BY tier, p) <= 20""")
def resolve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits_and_series(adapters.files(spark, sf_dir), search.Search(query="blue", order="name", least=2))


@query(f"WITH {FILES} SELECT folder, count(*) AS videos, regexp_extract(folder, '[^/]*$') AS \"folderName\" FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 5 AND 100")
def series_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_of(series.with_folder(adapters.bare_files(spark, sf_dir)))


@query(f"""WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 5 AND 100) SELECT key, folder, CAST(row_number() OVER w - 1 AS INT) AS episode, lag(key) OVER w AS "previousKey", lead(key) OVER w AS "nextKey" FROM foldered JOIN ser USING (folder) WINDOW w AS (PARTITION BY folder ORDER BY name, key)""")
def series_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.members(series.with_folder(adapters.bare_files(spark, sf_dir))).select("key", "folder", "episode", "previousKey", "nextKey")


@query(f"""WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 5 AND 100), m AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY "positionUpdatedAt" DESC, name, key) AS r FROM foldered JOIN ser USING (folder) WHERE "positionUpdatedAt" > 0)
 SELECT folder, key, "positionUpdatedAt" AS "at", CASE WHEN "durationSec" > 0 THEN least(100.0, greatest(0.0, 100.0 * coalesce("positionSec", 0.0) / "durationSec")) ELSE 0.0 END AS percent FROM m WHERE r = 1""")
def series_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.last_played(series.with_folder(adapters.files(spark, sf_dir)))
    return rows.select("folder", "key", "at", text.watched_percent(F.col("positionSec"), F.col("durationSec")).alias("percent"))


@query(f"WITH {FILES} SELECT key, parent, count(*) OVER (PARTITION BY parent) AS siblings FROM bare")
def folder_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.siblings(adapters.bare_files(spark, sf_dir)).select("key", "parent", "siblings")


@query(f"WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100) SELECT DISTINCT key FROM foldered WHERE n % 97 = 0 OR folder IN (SELECT folder FROM foldered JOIN ser USING (folder) WHERE n % 97 = 0)")
def series_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    return series.expanded(files.where(F.col("n") % 97 == 0), series.with_folder(files), least=2)


@query(r"""WITH RECURSIVE pg AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/' || page_id AS key FROM pages), f AS (SELECT key, regexp_extract(key, '^(.*)/[^/]*$', 1) AS folder FROM pg),
 lv AS (SELECT key, folder, (SELECT max(len(string_split(folder, '/'))) FROM f) AS d FROM f UNION ALL SELECT key, CASE WHEN n = 1 AND len(string_split(folder, '/')) = d THEN regexp_extract(folder, '^(.*)/[^/]*$', 1) ELSE folder END, d - 1 FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS n FROM lv WHERE d > 1))
 SELECT folder, count(*) AS videos, regexp_extract(folder, '[^/]*$') AS "folderName" FROM lv WHERE d = 1 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100""")
def series_deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lone pages move up their tree level by level."""
    pages = adapters.pages_tree(spark, sf_dir).select(F.concat("path", F.lit("/"), F.col("n").cast("string")).alias("key")).withColumn("relativePath", F.col("key")).withColumn("name", text.base_of(F.col("key")))
    return series.series_of(series.with_folder(pages), 2)


PAGES = r"pg AS (SELECT page_id AS n, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, CAST(length(html) AS BIGINT) AS size FROM pages), parts AS (SELECT *, string_split(path, '/') AS p FROM pg), pre AS (SELECT n, size, array_to_string(p[1:i], '/') AS folder FROM parts, unnest(range(1, len(p))) AS t(i))"


@query(f"WITH {PAGES} SELECT folder, count(*) AS videos FROM pre GROUP BY 1")
def folder_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.ancestors(adapters.pages_tree(spark, sf_dir))


TREE = f"{PAGES}, tot AS (SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM pre GROUP BY 1), tree AS (SELECT a.folder, any_value(a.files) AS files, any_value(a.bytes) AS bytes, count(b.folder) AS folders FROM tot a LEFT JOIN tot b ON starts_with(b.folder, a.folder || '/') GROUP BY 1)"


@query(f"WITH {TREE} SELECT * FROM tree")
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.tree(adapters.pages_tree(spark, sf_dir))


@query(f"WITH {TREE}, x AS (SELECT folder, bytes, CASE WHEN contains(folder, '/') THEN regexp_extract(folder, '^(.*)/[^/]*$', 1) ELSE '' END AS above FROM tree) SELECT folder, above, bytes, CASE WHEN sum(bytes) OVER (PARTITION BY above) > 0 THEN bytes / CAST(sum(bytes) OVER (PARTITION BY above) AS DOUBLE) ELSE 0.0 END AS share, CAST(row_number() OVER (PARTITION BY above ORDER BY bytes DESC, folder) AS INT) AS place FROM x")
def folder_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.shares(folders.tree(adapters.pages_tree(spark, sf_dir)))


@query(f"WITH {FILES} SELECT key FROM bare WHERE NOT (starts_with(key, 'Brand#12/') OR starts_with(key, 'Brand#3/STEEL/'))")
def walk_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ignored = spark.createDataFrame([("Brand#12",), ("Brand#3/STEEL",)], "key string")
    return folders.outside(adapters.bare_files(spark, sf_dir), ignored).select("key")


@query(f'WITH {MEMBERS} SELECT "listKey", count(*) AS items, max("addedAt") AS "lastAdded" FROM members GROUP BY 1')
def list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.sizes(adapters.memberships(spark, sf_dir))


LISTS = f"{MEMBERS}, lst AS (SELECT \"listKey\" AS key, lower(\"listKey\") AS name, 0 AS created, CASE WHEN \"listKey\" LIKE '1%' THEN 5 WHEN \"listKey\" LIKE '5%' THEN 2 END AS ord, max(\"addedAt\") AS la FROM members GROUP BY 1), shown AS (SELECT key, name, CAST(row_number() OVER (ORDER BY CASE WHEN ord IS NOT NULL THEN 1 ELSE 2 END, ord, CASE WHEN ord IS NULL THEN -la END, name, key) AS INT) AS place FROM lst)"


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = adapters.memberships(spark, sf_dir)
    order = F.when(F.startswith("listKey", F.lit("1")), 5.0).when(F.startswith("listKey", F.lit("5")), 2.0)
    named = members.select("listKey").distinct().select(F.col("listKey").alias("key"), F.lower("listKey").alias("name"), F.lit(0).cast("long").alias("createdAt"), order.alias("order"), order.isNotNull().alias("pinned"))
    return lists.display_order(named, members), members


@query(f"WITH {LISTS} SELECT * FROM shown")
def list_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir)[0]


@query(f'WITH {LISTS} SELECT s.* FROM shown s JOIN members m ON m."listKey" = s.key WHERE m."itemKey" = 7')
def lists_of_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, members = _lists(spark, sf_dir)
    return lists.item_lists(members, shown, 7)


@query(f"WITH {LISTS} SELECT key, name, CAST(row_number() OVER (ORDER BY CASE WHEN starts_with(name, '4') THEN 0 ELSE 1 END, place, key) AS INT) AS match FROM shown WHERE contains(name, '4')")
def list_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.completions(_lists(spark, sf_dir)[0], " 4 ")


@query(f"WITH {LISTS}, c AS (SELECT key, CASE WHEN key LIKE '3%' THEN 2 ELSE place - CASE WHEN place > own THEN 1 ELSE 0 END END AS p, own FROM (SELECT *, max(CASE WHEN key LIKE '3%' THEN place END) OVER () AS own FROM shown)) SELECT key, CAST(10 * CASE WHEN key LIKE '3%' THEN 2 WHEN p >= 2 THEN p + 1 ELSE p END AS BIGINT) AS \"order\" FROM c")
def list_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _lists(spark, sf_dir)[0]
    return lists.at_position(shown, "3-MEDIUM", 2)


@query(f"""WITH {MEMBERS}, act AS (SELECT m.*, greatest("addedAt", coalesce(t, 0)) AS act FROM members m LEFT JOIN (SELECT user_id, epoch_us(max(ts)) // 1000 AS t FROM events GROUP BY 1) ON user_id = "itemKey")
 SELECT "listKey", "itemKey", CAST(row_number() OVER (PARTITION BY "listKey" ORDER BY rank NULLS LAST, CASE WHEN rank IS NULL THEN -act END, "itemKey") AS INT) AS place FROM act""")
def list_members_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    played = adapters.detections(spark, sf_dir).groupBy(F.col("file").alias("itemKey")).agg(F.max("t").alias("played"))
    rows = adapters.memberships(spark, sf_dir).join(played, "itemKey", "left")
    return lists.in_order(rows, F.greatest("addedAt", F.coalesce("played", F.lit(0)))).select("listKey", "itemKey", "place")


@query(f"""WITH {MEMBERS}, r AS (SELECT *, row_number() OVER (PARTITION BY "listKey" ORDER BY "itemKey") * CASE WHEN "itemKey" % 5 = 0 THEN NULL ELSE 1 END AS k FROM members), w AS (SELECT "itemKey", k AS rank FROM r WHERE "listKey" = '2-HIGH'),
 gap AS (SELECT min(x) AS free FROM range(4, 100000) AS t(x) WHERE x NOT IN (SELECT rank FROM w WHERE rank IS NOT NULL AND "itemKey" <> 40))
 SELECT "itemKey", CAST(CASE WHEN "itemKey" = 40 THEN 4 WHEN rank >= 4 AND rank < (SELECT free FROM gap) THEN rank + 1 ELSE rank END AS BIGINT) AS rank FROM w""")
def list_rank_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("listKey").orderBy("itemKey"))
    rows = adapters.memberships(spark, sf_dir).withColumn("n", n).withColumn("rank", F.when(F.col("itemKey") % 5 != 0, F.col("n").cast("long")))
    return lists.with_rank(rows, "2-HIGH", 40, 4).where(F.col("listKey") == "2-HIGH").select("itemKey", "rank")


@query(f"""WITH {FILES}, t AS (SELECT key, n, name, CASE WHEN n % 13 = 0 THEN 1 WHEN n % 7 = 0 THEN 3 ELSE 2147483647 END AS grp, {BARE} LIKE '%widget%' AS hit FROM bare) SELECT key, grp, CAST(row_number() OVER (ORDER BY grp, name, key) - 1 AS BIGINT) AS position FROM t WHERE hit OR grp < 2147483647""")
def list_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    n = F.col("n")
    members = files.select(F.explode(F.array(F.when(n % 13 == 0, "a"), F.when(n % 5 == 0, "b"), F.when(n % 7 == 0, "c"))).alias("listKey"), F.col("key").alias("itemKey")).where(F.col("listKey").isNotNull())
    named = spark.createDataFrame([("a", "Widget fans", 1), ("b", "others", 2), ("c", "my-widgets", 3)], "key string, name string, place int")
    s = search.Search(query="widget", mode="flat", order="name")
    found = search.tiles(files, s, search.members_of(members, search.lists_named(named, s.query)))
    return search.in_order(found, s).select("key", "grp", "position")
