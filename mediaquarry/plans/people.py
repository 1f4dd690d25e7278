"""Queries on people across files, walks, ingested results, and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import faces, ingest, intervals, sequential, series, tables, walk
from ..sources import adapters, codecs
from .faces import BLACK, NEAR, QUERY_SQL, SPANS, _blacklist, _query, _spans
from .registry import CHARACTERS, DETECTIONS, FILES, L2, query

NOW = 1_706_000_000_000


@query(f"""WITH {CHARACTERS}, {QUERY_SQL}, d AS (SELECT key, "memberCount", {L2.format(a='e', b='v')} AS distance FROM characters, q) SELECT key, CAST(row_number() OVER (ORDER BY distance, "memberCount" DESC, key) AS BIGINT) AS place FROM d WHERE distance < 1.3""")
def face_search_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = faces.person_search(adapters.characters(spark, sf_dir), _query(), 1.3, closed=False, by="distance")
    return tables.numbered(found, faces.face_order("distance"), "place").select("key", (F.col("place") + 1).alias("place"))


@query(f"""WITH {CHARACTERS}, {QUERY_SQL}, d AS (SELECT "fileKey", "characterIdx", CASE WHEN vec_id % 7 <> 0 THEN {L2.format(a='e', b='v')} ELSE CAST('infinity' AS DOUBLE) END AS distance FROM characters, q) SELECT "fileKey", "characterIdx", CAST(row_number() OVER (PARTITION BY "fileKey" ORDER BY distance, "characterIdx") - 1 AS INT) AS place FROM d""")
def face_ranked_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.characters(spark, sf_dir).withColumn("bestFaceEmbedding", F.when(F.col("vec_id") % 7 != 0, F.col("bestFaceEmbedding")))
    return faces.ranked_in_file(rows, _query()).select("fileKey", "characterIdx", "place")


@query(f"""WITH {CHARACTERS}, {QUERY_SQL} SELECT key, {L2.format(a='e', b='v')} AS distance FROM characters, q WHERE "fileKey" = 'show#3' QUALIFY row_number() OVER (ORDER BY {L2.format(a='e', b='v')}, "characterIdx") = 1""")
def face_in_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = adapters.characters(spark, sf_dir).where(F.col("fileKey") == "show#3")
    near = faces.nearest_by_file(mine, _query())
    return near.join(mine.select("key", "characterIdx"), "characterIdx").select("key", "distance")


@query(f"""WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), m AS (SELECT key, CASE WHEN s.folder IS NOT NULL THEN b.parent END AS folder, 1 + n % 5 AS c FROM bare b LEFT JOIN ser s ON s.folder = b.parent WHERE n % 4 = 0), g AS (SELECT folder, count(*) AS k, sum(c) AS a FROM m WHERE folder IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
 SELECT 'series' AS kind, folder AS key, k AS matches, CAST(a AS BIGINT) AS appearances FROM g UNION ALL SELECT 'video', key, 1, c FROM m WHERE folder IS NULL OR folder NOT IN (SELECT folder FROM g)""")
def face_matches_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    matches = files.where(F.col("n") % 4 == 0).select(F.col("key").alias("fileKey"), (1 + F.col("n") % 5).alias("memberCount"))
    return faces.by_series(matches, series.series_of(series.with_folder(files), 2))


@query("""WITH c AS (SELECT user_id AS f, event_id % 3 AS cl, epoch_us(ts) // 1000 AS t, CAST(50 + event_id % 200 AS BIGINT) AS w, CAST(60 + event_id % 170 AS BIGINT) AS h, CASE WHEN user_id % 2 = 0 THEN 5686666666666.0 ELSE 0.0 END AS d, user_id % 8 AS sib FROM events WHERE user_id % 9 <> 0),
 m AS (SELECT *, max(t) OVER (PARTITION BY f, cl) AS last FROM c), x AS (SELECT * FROM m WHERE cl = CASE WHEN sib >= 5 THEN (SELECT CASE WHEN max(cl) >= 1 THEN 1 ELSE 0 END FROM c k WHERE k.f = m.f) ELSE 0 END)
 SELECT f AS "fileKey", t, w, h FROM x WHERE t >= 0.3 * CASE WHEN d > 0 THEN d ELSE last END AND w >= 128 QUALIFY row_number() OVER (PARTITION BY f ORDER BY w * h DESC, t) = 1""")
def face_poster_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("file")
    rows = adapters.detections(spark, sf_dir).select(u.alias("fileKey"), (n % 3).alias("cluster"), "t", (50 + n % 200).alias("w"), (60 + n % 170).alias("h"), F.when(u % 2 == 0, 5686666666666.0).otherwise(0.0).alias("duration"))
    users = rows.select("fileKey").distinct()
    return faces.poster(rows, users.withColumn("siblings", F.col("fileKey") % 8), users.where(F.col("fileKey") % 9 == 0))


@query(f"""WITH {CHARACTERS}, {BLACK} SELECT 'kept' AS what, count(*) AS n FROM characters WHERE key <> 'show#3#01' UNION ALL SELECT 'black', count(*) + 1 FROM black UNION ALL SELECT 'pardoned', count(*) - 1 FROM black""")
def face_blacklisting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.characters(spark, sf_dir)
    black = _blacklist(spark, sf_dir).withColumns({"fileKey": F.lit("x"), "blacklistedAt": F.lit(1).cast("long")})
    left, _, more = faces.blacklisted(rows, rows, black, "show#3#01", NOW)
    one = black.agg(F.min("key")).first()[0]
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(left, "kept").unionByName(count(more, "black")).unionByName(count(faces.pardoned(black, one), "pardoned"))


@query(f"""WITH {CHARACTERS}, ok AS (SELECT * FROM characters WHERE NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id % 50 = 0 AND {L2.format(a='e', b='CAST(b.embedding AS DOUBLE[])')} < 1.1)) SELECT "fileKey", sum("memberCount") AS appearances, count(*) AS n FROM ok WHERE "memberCount" >= 2 GROUP BY 1""")
def face_merged_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups differ by model, but who is in some group, and how often, is a sum."""
    characters = adapters.characters(spark, sf_dir)
    frames = characters.select("key", F.array(F.col("vec_id").cast("float")).alias("frameTimes"))
    merged = sequential.merged_faces(characters, 1.1, 2, _blacklist(spark, sf_dir))
    groups = faces.merged_groups(merged, characters, frames)
    return groups.groupBy("fileKey").agg(F.sum("memberCount").alias("appearances"), F.sum(F.size("charKeys")).alias("n"))


SAME = f"""{FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), grp AS (SELECT b.key AS f, b.parent, b.n, g, (b.n * 7 + g * 11) % 500 AS v FROM bare b, unnest(range(3)) AS u(g)), src AS (SELECT b.key AS c, b.parent, (b.n * 3) % 500 AS v FROM bare b WHERE n % 10 = 0),
 emb AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


def _numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered(adapters.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), [F.col("vec_id")], "v").select(F.col("v").cast("long").alias("v"), "embedding")


@query(f"""WITH {SAME}, p AS (SELECT grp.f, src.c, g, {L2.format(a='x.e', b='y.e')} AS d FROM src JOIN grp ON grp.f = src.c OR (grp.parent = src.parent AND src.parent IN (SELECT folder FROM ser)) JOIN emb x ON x.v = src.v JOIN emb y ON y.v = grp.v) SELECT f AS "fileKey", c AS "charKey", CAST(g AS INT) AS "groupId" FROM p WHERE true QUALIFY row_number() OVER (PARTITION BY f, c ORDER BY d, g) = 1 AND d <= 1.35""")
def people_in_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    vectors = _numbered_vectors(spark, sf_dir)
    g = F.explode(F.array(*map(F.lit, range(3)))).alias("groupId")
    groups = files.select(F.col("key").alias("fileKey"), "n", g).withColumn("v", (F.col("n") * 7 + F.col("groupId") * 11) % 500).join(vectors, "v").select("fileKey", "groupId", F.col("embedding").alias("repEmbedding"))
    sources = files.where(F.col("n") % 10 == 0).select(F.col("key").alias("charKey"), F.col("key").alias("fileKey"), (F.col("n") * 3 % 500).alias("v")).join(vectors, "v").drop("v")
    targets = faces.same_series(sources, files, series.series_of(series.with_folder(files), 2))
    return faces.people_groups(targets, groups, 1.35).select("fileKey", "charKey", "groupId")


@query(f"""WITH {SPANS}, p AS (SELECT file, grp FROM spans WHERE points >= 3 GROUP BY 1, 2) SELECT DISTINCT s.file, s.start FROM spans s JOIN p ON p.file = s.file AND p.grp = s.grp""")
def scenes_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    people = spans.where(F.col("points") >= 3).select(F.col("file").alias("fileKey"), F.col("grp").alias("groupId"))
    return faces.scenes_of(spans.select("file", "start", F.array("grp").alias("groups")), people).select("file", "start").distinct()


@query(f"""WITH {SPANS} SELECT s.file, s.grp, s.start, (SELECT max(d.t) FROM det d WHERE d.file = s.file AND d.grp = 'view' AND 2 * d.t <= s.start + s."end") AS frame FROM spans s""")
def scene_thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = _spans(spark, sf_dir).withColumn("t", ((F.col("start") + F.col("end")) / 2))
    frames = adapters.detections(spark, sf_dir).where(F.col("grp") == "view").select("file", F.col("t").cast("double").alias("t"), F.col("t").alias("v"))
    return intervals.as_of(middle, frames, "file", "t", "v", "frame").select("file", "grp", "start", "frame")


@query(f"""WITH {DETECTIONS} SELECT file, t // 3600000 AS t, min_by(event_id, event_id) AS event_id FROM det GROUP BY 1, 2""")
def keyframe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.detections(spark, sf_dir).select("file", F.expr("t div 3600000").alias("t"), "event_id")
    return intervals.first_of_each(rows, ["file", "t"], "event_id")


@query("""SELECT user_id AS file, max(event_id % 90 + 40) AS "right", max(event_id % 70 + 30) AS bottom FROM events GROUP BY 1""")
def cue_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return intervals.extents(adapters.detections(spark, sf_dir).select("file", (n % 90).alias("x"), (n % 70).alias("y"), F.lit(40).alias("w"), F.lit(30).alias("h")), "file")


@query(f"""WITH {SPANS}, p AS (SELECT *, lead(start) OVER (PARTITION BY file ORDER BY start, grp) AS nx FROM spans) SELECT d.event_id, (SELECT arg_min(s.grp, [s.start, s.id2]) FROM (SELECT *, CAST(hash(grp) % 1 AS BIGINT) AS id2 FROM spans) s WHERE s.file = d.file AND d.t >= s.start AND d.t <= s."end" AND s.start = (SELECT min(z.start) FROM spans z WHERE z.file = d.file AND d.t >= z.start AND d.t <= z."end")) IS NOT NULL AS shown, (SELECT min(z.start) FROM spans z WHERE z.file = d.file AND d.t >= z.start AND d.t <= z."end") AS start FROM det d WHERE d.grp = 'purchase'""")
def active_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = adapters.detections(spark, sf_dir).where(F.col("grp") == "purchase").select("file", "t", "event_id")
    first = intervals.first_containing(points, _spans(spark, sf_dir).select("file", "grp", "start", "end"), "file", ["event_id"], 24 * 3_600_000)
    return points.join(first.select("event_id", F.col("start").alias("s")), "event_id", "left").select("event_id", F.col("s").isNotNull().alias("shown"), F.col("s").alias("start"))


@query(f"""WITH {FILES}, ser AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), m AS (SELECT f.*, n % 6 = 0 AS u FROM foldered f JOIN ser USING (folder))
 SELECT folder, coalesce(arg_min(key, name) FILTER (u), arg_max(key, "positionUpdatedAt") FILTER ("positionUpdatedAt" > 0), arg_min(key, name)) AS key FROM m GROUP BY 1""")
def series_thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir).withColumn("userThumb", F.col("n") % 6 == 0)
    return series.display_thumbs(series.with_folder(files), 2)


PATHS = "w AS (SELECT page_id AS n, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/f' || page_id || CASE WHEN page_id % 4 = 0 THEN '.MKV' ELSE '.txt' END AS path FROM pages)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return adapters.pages_tree(spark, sf_dir).select("n", F.concat("path", F.lit("/f"), n.cast("string"), F.when(n % 4 == 0, ".MKV").otherwise(".txt")).alias("path"))


SEEN = f"""{PATHS}, x AS (SELECT path, string_split(path, '/') AS p, path LIKE '%.MKV' AS v FROM w), fs AS (SELECT path, p[:len(p)-1] AS q, v FROM x),
 tree AS (SELECT DISTINCT q[:CAST(i AS INT)] AS q FROM fs, unnest(range(len(q) + 1)) AS t(i)), o AS (SELECT NULL AS path, q, false AS v FROM tree UNION ALL SELECT path, q, v FROM fs),
 s AS (SELECT *, coalesce(q[1], '') AS top, path IS NOT NULL AS f, coalesce(sum(CASE WHEN path IS NULL THEN 0 WHEN v THEN 2 ELSE -1 END) OVER (PARTITION BY coalesce(q[1], '') ORDER BY len(q), q, path IS NOT NULL, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM o),
 k AS (SELECT *, 3 + min(c) OVER (PARTITION BY top ORDER BY len(q), q, f, path ROWS UNBOUNDED PRECEDING) AS l FROM s), seen AS (SELECT * FROM k WHERE l > 0 OR top = '')"""


@query(f"""WITH {SEEN} SELECT array_to_string(q, '/') AS folder, count(*) FILTER (f) AS files, count(*) FILTER (v) AS videos FROM seen GROUP BY 1""")
def folder_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_paths(spark, sf_dir), budget=3, bonus=3).folders


@query(f"""WITH {SEEN} SELECT count(*) FILTER (NOT f) AS folders, count(*) FILTER (f) AS files, count(*) FILTER (v) AS videos, bool_or(top <> '' AND f AND 3 + c + CASE WHEN v THEN 2 ELSE -1 END <= 0) AS truncated FROM seen""")
def walk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.walk(_paths(spark, sf_dir), budget=3, bonus=3).summary


@query(f"""WITH {PATHS}, h AS (SELECT min(split_part(path, '/', 1)) AS host FROM w), k AS (SELECT path AS key, row_number() OVER (ORDER BY path) - 1 AS r FROM w, h WHERE path LIKE '%.MKV' AND NOT starts_with(path, host || '/') AND n % 16 <> 0 AND NOT regexp_matches('/' || path, '/[.]')) SELECT key, CAST(r // 5 AS INT) AS batch FROM k""")
def offline_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    host = paths.agg(F.min(F.substring_index("path", "/", 1))).first()[0]
    ignored = spark.createDataFrame([(host,)], "key string")
    return walk.offline(paths, ignored, paths.where(F.col("n") % 16 == 0).select(F.col("path").alias("key")), 5).select("key", F.col("batch").cast("int").alias("batch"))


@query("""WITH k AS (SELECT event_id, event_id % 8 AS file, epoch_us(ts) // 1000 AS t, dense_rank() OVER (ORDER BY event_id) - 1 AS r FROM events), w AS (SELECT max(r) AS top, min(t) AS t0, max(t) - min(t) AS span FROM k), f AS (SELECT file, min(t) AS first, max(t) AS last, min(r) AS lo, max(r) AS hi, count(*) AS rows FROM k GROUP BY 1)
 SELECT file, first, last, rows, CASE WHEN span > 0 THEN (first - t0) / CAST(span AS DOUBLE) ELSE 0.0 END AS "timeLeft", CASE WHEN span > 0 THEN (last - first) / CAST(span AS DOUBLE) ELSE 1.0 END AS "timeWidth", CASE WHEN top > 0 THEN lo / CAST(top AS DOUBLE) ELSE 0.0 END AS "keyLeft", CASE WHEN top > 0 THEN (hi - lo) / CAST(top AS DOUBLE) ELSE 1.0 END AS "keyWidth" FROM f, w""")
def file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.detections(spark, sf_dir).select((F.col("event_id") % 8).alias("file"), F.col("event_id").alias("key"), F.col("t").alias("at"))
    return walk.file_ranges(rows)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for files: some failed, some without faces, with pictures of some bytes."""
    n = F.col("vec_id")
    rows = adapters.table(spark, sf_dir, "embeddings")
    b64 = lambda v: F.translate(codecs.vector_text(v), "-_", "+/")
    person = F.struct(F.lit(0).alias("characterIdx"), F.lit(1).alias("memberCount"), (n * 10.0).alias("bestFaceTimeMs"), b64(F.col("embedding")).alias("bestFaceEmbedding_b64"), b64(F.col("embedding")).alias("embeddings_b64"), b64(F.array(n.cast("float"))).alias("frameTimes_b64"))
    picture = lambda k: F.struct((n + k).cast("double").alias("timeSec"), F.base64(F.concat(F.lit("pic").cast("binary"), n.cast("string").cast("binary"))).alias("jpeg_b64"))
    frames = F.struct(F.lit(2.5).alias("intervalSec"), F.array(picture(0), picture(1)).alias("frames"))
    result = F.struct(
        F.concat(F.lit("f"), n.cast("string")).alias("fileKey"), F.when(n % 3 != 0, F.array(person)).alias("characters"), F.struct(F.lit(640).alias("thumbW"), F.lit(360).alias("thumbH"), F.lit("face").alias("source")).alias("thumbnail"),
        F.when(n % 4 != 0, frames).alias("keyframes"), F.when(n % 8 == 4, "no frames").alias("keyframesError"), F.when(n % 5 == 0, "decoder is stuck").alias("error"), F.when(n % 10 == 0, True).alias("blacklist"),
    )
    return rows.select(F.to_json(result).alias("value"))


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Results:
    n = F.col("vec_id")
    had = adapters.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), n.cast("string")).alias("key"), F.when(n % 6 == 1, "user").otherwise("auto").alias("thumbSource"), F.when(n % 7 == 0, 9).otherwise(6).alias("keyframesVersion"))
    return ingest.ingested(ingest.results(_lines(spark, sf_dir)), had, had, 64, NOW)


@query(f"""SELECT 'f'||vec_id AS key, 7 AS "facesVersion", CASE WHEN vec_id % 5 = 0 THEN 'decoder is stuck' ELSE '' END AS "facesError", vec_id % 5 <> 0 AND vec_id % 3 = 0 AS "facesEmpty", CASE WHEN vec_id % 10 = 0 THEN true END AS "scanBlacklisted", CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id % 3 <> 0 AS BIGINT) END AS "faceCount" FROM embeddings""")
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).files.select("key", "facesVersion", "facesError", "facesEmpty", "scanBlacklisted", "faceCount")


@query("""SELECT 'f'||vec_id||'#00' AS key, vec_id * 10.0 AS "bestFaceTimeMs", embedding AS "bestFaceEmbedding", CAST(vec_id AS FLOAT) AS "time" FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0""")
def ingest_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _ingested(spark, sf_dir)
    return out.characters.join(out.frames.select("key", F.col("frameTimes")[0].alias("time")), "key").select("key", "bestFaceTimeMs", "bestFaceEmbedding", "time")


@query("""SELECT 'f'||vec_id AS "fileKey", CASE WHEN vec_id % 2 = 0 THEN 'characters of the wrong length' ELSE 'frames of the wrong length' END AS reason FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0 AND vec_id % 4 IN (1, 2)""")
def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which some lost the end of a vector, or a member, on their way."""
    n = F.col("vec_id")
    whole = ingest.results(_lines(spark, sf_dir))
    number = F.expr("CAST(substring(fileKey, 2) AS LONG)")
    torn = F.transform("characters", lambda c: F.when(number % 4 == 2, c.withField("bestFaceEmbedding_b64", F.substring(c["bestFaceEmbedding_b64"], 1, 40))).when(number % 4 == 1, c.withField("memberCount", c["memberCount"] + 1)).otherwise(c))
    none = adapters.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("f"), n.cast("string")).alias("key"), F.lit("auto").alias("thumbSource"), F.lit(1).alias("keyframesVersion"))
    return ingest.ingested(whole.withColumn("characters", torn), none, none, 64, NOW).rejected


@query("""SELECT 'f'||vec_id AS key, 'face' AS source FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 6 <> 1""")
def ingest_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).thumbnails.select("key", F.col("thumbSource").alias("source"))


@query("""SELECT 'f'||vec_id AS key, CASE WHEN vec_id % 4 <> 0 THEN 2 END AS pictures, CASE WHEN vec_id % 4 <> 0 THEN vec_id + 1.0 END AS last, CASE WHEN vec_id % 4 <> 0 THEN 12 + 16 + 12 + 2 * (3 + length(CAST(vec_id AS VARCHAR))) END AS bytes, CASE WHEN vec_id % 4 <> 0 THEN true END AS complete, CASE WHEN vec_id % 4 <> 0 THEN false END AS torn, CASE WHEN vec_id % 4 <> 0 THEN '' ELSE 'no frames' END AS error FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND (vec_id % 4 <> 0 OR vec_id % 8 = 4)""")
def ingest_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ingested(spark, sf_dir).keyframes
    n = F.octet_length("keyframes2")
    both = rows.select("key", "keyframesError", n.alias("bytes"), codecs.strip_parts("keyframes2").alias("s"), codecs.strip_parts(F.expr("substring(keyframes2, 1, octet_length(keyframes2) - 1)")).alias("cut"))
    return both.select("key", F.col("s.count").cast("int").alias("pictures"), F.col("s.times")[1].alias("last"), F.element_at("s.offsets", -1).cast("int").alias("bytes"), "s.complete", F.col("cut.complete").alias("torn"), F.col("keyframesError").alias("error"))


@query(f"""WITH {FILES}, w AS (SELECT key FROM bare WHERE n % 3 = 0) SELECT '{{"version":7,"total":'||count(*)||'}}' AS value FROM w UNION ALL SELECT '{{"key":"'||key||'"}}' FROM w""")
def work_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.work_list(adapters.bare_files(spark, sf_dir).where(F.col("n") % 3 == 0).select("key"))


def _points(n: Column, k: int) -> Column:
    return F.array(*(F.struct(((n * (i + 3) + k * i * i) % 97).cast("double").alias("x"), ((n * (i + 5) + k * 31) % 89).cast("double").alias("y")) for i in range(5)))


# Whole numbers, so that sums are the same in any order.
POINTS = "list_transform(range(5), lambda i: {{'x': (n * (i + 3) + {k} * i * i) % 97, 'y': (n * (i + 5) + {k} * 31) % 89}})"


@query(f"""WITH e AS (SELECT event_id AS n, {POINTS.format(k=1).replace('n *', 'event_id *')} AS s, {POINTS.format(k=2).replace('n *', 'event_id *')} AS d FROM events), u AS (SELECT n, s[CAST(i AS INT)] AS s, d[CAST(i AS INT)] AS d FROM e, unnest(range(1, 6)) AS t(i)),
 m AS (SELECT n, CAST(sum(s.x) AS BIGINT) AS x, CAST(sum(s.y) AS BIGINT) AS y, CAST(sum(d.x) AS BIGINT) AS u, CAST(sum(d.y) AS BIGINT) AS v, 5 * CAST(sum(s.x * s.x + s.y * s.y) AS BIGINT) AS zz, 5 * CAST(sum(s.x * d.x + s.y * d.y) AS BIGINT) AS aa, 5 * CAST(sum(s.x * d.y - s.y * d.x) AS BIGINT) AS bb FROM u GROUP BY 1), q AS (SELECT n, x, y, u, v, zz - x * x - y * y AS z, aa - x * u - y * v AS a, bb - x * v + y * u AS b FROM m)
 SELECT n, CASE WHEN z > 0 THEN (z * u - a * x + b * y) / CAST(5 * z AS DOUBLE) END AS x, CASE WHEN z > 0 THEN (z * v - b * x - a * y) / CAST(5 * z AS DOUBLE) END AS y FROM q""")
def face_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    fitted = adapters.table(spark, sf_dir, "events").select(n.alias("n"), geometry.similarity(_points(n, 1), _points(n, 2)).alias("f"))
    return fitted.select("n", geometry.moved(F.col("f"), F.lit(0.0), F.lit(0.0)).alias("p")).select("n", "p.x", "p.y")


@query("""WITH s AS (SELECT vec_id AS key, unnest(range(64)) AS idx, unnest(CAST(embedding AS DOUBLE[])) AS score, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT *, idx // 2 AS cell FROM s WHERE score >= 0.1) SELECT key, CAST(idx AS INT) AS idx, (cell % 10 + 0.5) * 64 - e[CAST(idx * 4 % 64 + 1 AS INT)] * 64 AS x1, (cell // 10 + 0.5) * 64 + e[CAST((idx * 4 + 3) % 64 + 1 AS INT)] * 64 AS y2, score FROM c""")
def anchor_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    outputs = adapters.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), e.alias("score"), F.concat(e, e, e, e).alias("bbox"))
    return geometry.anchor_boxes(outputs, 64, 0.1).select("key", "idx", "x1", "y2", "score")


@query("""WITH b AS (SELECT p_partkey AS n, array_to_string(list_transform(string_split(left(p_name, 7), ''), lambda c: lpad(bin(ascii(c)), 8, '0')), '') AS t FROM part) SELECT n, array_to_string(list_transform(range(CAST(ceil(length(t) / 10.0) AS INT)), lambda i: list_reduce(list_transform(string_split(rpad(t[i*10+1:i*10+10], 10, '0'), ''), lambda c: CAST(c AS INT)), lambda a, c: a * 2 + c)), ',') AS groups FROM b""")
def ten_bit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    groups = geometry.ten_bit_groups(F.left("p_name", F.lit(7)).cast("binary"))
    return part.select(F.col("p_partkey").alias("n"), F.array_join(F.transform(groups, lambda x: x.cast("string")), ",").alias("groups"))


@query("""SELECT vec_id, (CAST(embedding[3] AS DOUBLE) + CAST(embedding[35] AS DOUBLE)) / 2 AS third, 32 AS frames FROM embeddings""")
def mono_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = adapters.table(spark, sf_dir, "embeddings").select("vec_id", geometry.mono(F.col("embedding").cast("array<double>"), F.lit(2)).alias("m"))
    return out.select("vec_id", F.col("m")[2].alias("third"), F.size("m").alias("frames"))
