"""Queries on faces, scenes and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import faces, folds, intervals, sequential
from ..sources import adapters
from .registry import CHARACTERS, DETECTIONS, L2, query

#: Vectors of the fixtures have this length, and little in common: thresholds are wider than for people.
DIM, NEAR = 64, 1.25

QUERY_SQL = "q AS (SELECT list_transform(range(64), lambda i: sin(CAST(i AS DOUBLE) * 1.7 + 0.3) / 5.656854249492381) AS v)"


def _query() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.sin(i.cast("double") * 1.7 + 0.3) / 5.656854249492381)


@query(f"""WITH {CHARACTERS}, {QUERY_SQL}, d AS (SELECT *, {L2.format(a='e', b='v')} AS distance FROM characters, q) SELECT "fileKey", distance, "characterIdx", "memberCount" FROM d QUALIFY row_number() OVER (PARTITION BY "fileKey" ORDER BY distance, "characterIdx") = 1""")
def face_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.nearest_by_file(adapters.characters(spark, sf_dir), _query())


@query(f"""WITH {CHARACTERS}, {QUERY_SQL} SELECT key, "memberCount", {L2.format(a='e', b='v')} AS distance FROM characters, q WHERE {L2.format(a='e', b='v')} <= 1.3""")
def face_person_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.person_search(adapters.characters(spark, sf_dir), _query(), 1.3).select("key", "memberCount", "distance")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "embeddings").select(F.concat_ws("#", F.lit("show"), "label", (F.col("vec_id") % 5).cast("string")).alias("key"), "vec_id", "embedding")
    packed = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    return packed.select("key", F.flatten(F.transform("x", lambda r: r["embedding"])).alias("embeddings"), F.transform("x", lambda r: r["vec_id"] * 1000).alias("frameTimes"))


@query(f"""WITH {QUERY_SQL}, a AS (SELECT 'show#'||label||'#'||(vec_id % 5) AS key, vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(row_number() OVER (PARTITION BY label, vec_id % 5 ORDER BY vec_id) - 1 AS INT) AS frame FROM embeddings), f AS (SELECT * FROM a WHERE key IN (SELECT key FROM a, q WHERE {L2.format(a='e', b='v')} <= 1.15))
 SELECT key, frame, vec_id * 1000 AS time, {L2.format(a='e', b='v')} AS distance, CAST(row_number() OVER w AS INT) AS rank FROM f, q WINDOW w AS (PARTITION BY key ORDER BY {L2.format(a='e', b='v')}, frame) QUALIFY row_number() OVER w <= 3""")
def face_frames_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = faces.person_search(adapters.characters(spark, sf_dir), _query(), 1.15)
    matched = near.select(F.concat_ws("#", "fileKey", (F.col("vec_id") % 5).cast("string")).alias("key")).distinct()
    return faces.best_frames(_packed(spark, sf_dir), matched, _query(), DIM)


BLACK = """black AS (SELECT 'b'||vec_id AS other, CAST(embedding AS DOUBLE[]) AS o FROM embeddings WHERE vec_id % 50 = 0)"""


def _blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.concat(F.lit("b"), "vec_id").alias("key"), "embedding")


@query(f"""WITH {CHARACTERS}, {BLACK}, d AS (SELECT key, other, {L2.format(a='e', b='o')} AS distance FROM characters, black) SELECT key, other, distance FROM d WHERE distance < {NEAR} QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, other) = 1""")
def face_blacklist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.characters(spark, sf_dir).select("key", F.col("bestFaceEmbedding").alias("embedding"))
    return faces.theta_nearest(rows, _blacklist(spark, sf_dir), NEAR)


@query(f"""WITH {CHARACTERS}, {BLACK} SELECT key FROM characters WHERE NOT EXISTS (SELECT 1 FROM black WHERE {L2.format(a='e', b='o')} < {NEAR})""")
def face_without_blacklisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.without_blacklisted(adapters.characters(spark, sf_dir), _blacklist(spark, sf_dir), NEAR).select("key")


CENTRES = f"""{CHARACTERS}, p AS (SELECT "fileKey", i, avg(e[i]) AS x FROM characters, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2), c AS (SELECT "fileKey", list(x ORDER BY i) AS m FROM p GROUP BY 1), cen AS (SELECT "fileKey", list_transform(m, lambda x: x / (sqrt(list_inner_product(m, m)) + 1e-12)) AS centroid FROM c)"""


@query(f"""WITH {CENTRES}, d AS (SELECT "fileKey", key, {L2.format(a='e', b='centroid')} AS distance FROM characters JOIN cen USING ("fileKey")) SELECT "fileKey", key AS medoid, distance FROM d QUALIFY row_number() OVER (PARTITION BY "fileKey" ORDER BY distance, key) = 1""")
def face_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.medoids(adapters.characters(spark, sf_dir), "fileKey", "key", "bestFaceEmbedding")


@query(f"""WITH {CHARACTERS}, b AS (SELECT "fileKey", key AS "bestKey", e AS be FROM characters QUALIFY row_number() OVER (PARTITION BY "fileKey" ORDER BY "bestFaceScore" DESC, "characterIdx") = 1),
 d AS (SELECT c."fileKey", c.key, "bestKey", "characterIdx", CASE WHEN c.key = "bestKey" THEN 0.0 ELSE {L2.format(a='c.e', b='be')} END AS distance FROM characters c JOIN b USING ("fileKey"))
 SELECT "fileKey", key, "bestKey", distance, CAST(row_number() OVER (PARTITION BY "fileKey" ORDER BY CASE WHEN key = "bestKey" THEN 0 ELSE 1 END, distance, "characterIdx") - 1 AS INT) AS place FROM d""")
def face_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faces.against_best(adapters.characters(spark, sf_dir))


@query("""WITH c AS (SELECT user_id AS "fileKey", epoch_us(ts) // 1000 AS t, CAST(50 + event_id % 200 AS BIGINT) AS w, CAST(60 + event_id % 170 AS BIGINT) AS h, 1706000000000 AS "after" FROM events) SELECT "fileKey", t, w, h FROM c WHERE t >= 0.3 * 5686666666666.0 AND w >= 128 QUALIFY row_number() OVER (PARTITION BY "fileKey" ORDER BY w * h DESC, t) = 1""")
def face_poster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.detections(spark, sf_dir).select(F.col("file").alias("fileKey"), "t", (50 + F.col("event_id") % 200).alias("w"), (60 + F.col("event_id") % 170).alias("h"), F.lit(5686666666666.0).alias("duration"), F.lit(0).alias("cluster"))
    return faces.poster(rows)


HOUR = 3_600_000


def _points(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return adapters.detections(spark, sf_dir).where(F.col("grp") == kind)


@query(f"""WITH {DETECTIONS} SELECT a.event_id, (SELECT max(b.t) FROM det b WHERE b.file = a.file AND b.grp = 'click' AND b.t <= a.t) AS click FROM det a WHERE a.grp = 'purchase'""")
def as_of_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _points(spark, sf_dir, "click").select("file", "t", F.col("t").alias("v"))
    return intervals.as_of(_points(spark, sf_dir, "purchase"), right, "file", "t", "v", "click").select("event_id", "click")


@query(f"""WITH {DETECTIONS} SELECT a.event_id, coalesce((SELECT min(b.t) FROM det b WHERE b.file = a.file AND b.grp = 'click' AND b.t >= a.t), (SELECT max(b.t) FROM det b WHERE b.file = a.file AND b.grp = 'click')) AS click FROM det a WHERE a.grp = 'purchase'""")
def as_of_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _points(spark, sf_dir, "click").select("file", "t", F.col("t").alias("v"))
    return intervals.as_of_next(_points(spark, sf_dir, "purchase"), right, "file", "t", "v", "click").select("event_id", "click")


@query(f"""WITH {DETECTIONS} SELECT a.event_id, (SELECT b.t FROM det b WHERE b.file = a.file AND b.grp = 'click' ORDER BY abs(b.t - a.t), b.t LIMIT 1) AS click FROM det a WHERE a.grp = 'purchase'""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nearest_in_time(_points(spark, sf_dir, "purchase"), _points(spark, sf_dir, "click"), "file", "t", "click").select("event_id", "click")


SPANS = f"""{DETECTIONS}, gaps AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 36000000 THEN 0 ELSE 1 END AS new FROM det WINDOW w AS (PARTITION BY file, grp ORDER BY t)), ids AS (SELECT *, sum(new) OVER (PARTITION BY file, grp ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM gaps), spans AS (SELECT file, grp, min(t) AS start, max(t) AS "end", count(*) AS points FROM ids GROUP BY file, grp, id)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.bridged(adapters.detections(spark, sf_dir), ["file", "grp"], 10 * HOUR)


@query(f'WITH {SPANS} SELECT * FROM spans')
def bridge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir)


@query(f"""WITH {SPANS}, x AS (SELECT file, start, "end" FROM spans WHERE "end" > start), f AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x), g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS id FROM f) SELECT file, min(start) AS start, max("end") AS "end" FROM g GROUP BY file, id""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged_ranges(_spans(spark, sf_dir).select("file", "start", "end"), ["file"])


@query(f"""WITH {SPANS} SELECT a.event_id, s.grp, s.start, s."end" FROM det a JOIN spans s ON s.file = a.file AND a.t >= s.start - 150 AND a.t <= s."end" WHERE a.grp = 'purchase'""")
def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.containing(_points(spark, sf_dir, "purchase").select("file", "t", "event_id"), _spans(spark, sf_dir).select("file", "grp", "start", "end"), "file", 24 * HOUR, early_ms=150).select("event_id", "grp", "start", "end")


@query(f"""WITH {SPANS} SELECT a.file, a.grp AS grp1, b.grp AS grp2, a.start AS start1, b.start AS start2 FROM spans a JOIN spans b ON a.file = b.file AND a.start <= b."end" AND b.start <= a."end" WHERE a.grp < b.grp""")
def spans_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spans(spark, sf_dir).drop("points")
    return intervals.overlapping(s, s, "file", 24 * HOUR).where(F.col("grp1") < F.col("grp2")).select("file", "grp1", "grp2", "start1", "start2")


@query(f"""WITH {SPANS} SELECT s.file, s.grp, s.start, s."end", (SELECT max(t) FROM det d WHERE d.file = s.file AND d.t < s.start) AS before, (SELECT min(t) FROM det d WHERE d.file = s.file AND d.t > s."end") AS "after" FROM spans s""")
def span_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.neighbours(adapters.detections(spark, sf_dir), _spans(spark, sf_dir).drop("points"), "file")


@query(f"""WITH {DETECTIONS}, c AS (SELECT file, event_id AS idx, t AS start, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 9 * 4000 AS BIGINT) END AS duration FROM det), e AS (SELECT *, CASE WHEN duration > 0 THEN start + duration ELSE least(coalesce(lead(start) OVER (PARTITION BY file ORDER BY start, idx), start + 5000), start + 15000) END AS x FROM c) SELECT file, idx, start, CASE WHEN x <= start THEN start + 2000 ELSE x END AS "end" FROM e""")
def cue_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = adapters.detections(spark, sf_dir).select("file", F.col("event_id").alias("idx"), F.col("t").alias("start"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9 * 4000).alias("duration"))
    return intervals.filled_ends(cues, "file").select("file", "idx", "start", "end")


@query(f"""WITH {DETECTIONS}, r AS (SELECT *, sum(value) OVER w AS s, max(value) OVER w AS slowest, min(t) OVER (PARTITION BY file) AS t0 FROM det WINDOW w AS (PARTITION BY file ORDER BY t RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)) SELECT event_id, s * 1000.0 / least(86400000.0, greatest(1.0, CAST(t - t0 AS DOUBLE))) AS rate, slowest FROM r""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.rolling_rate(adapters.detections(spark, sf_dir).withColumnRenamed("value", "amount"), "file", 24 * HOUR).select("event_id", "rate", "slowest")


@query("""WITH d AS (SELECT user_id AS track, event_id AS idx, CAST(1 + event_id % 4 AS INT) AS n, CAST(event_id % 50 AS BIGINT) AS delta FROM events), s AS (SELECT d.*, i FROM d, unnest(range(1, n + 1)) AS t(i)) SELECT track, CAST(row_number() OVER w - 1 AS INT) AS sample, CAST(sum(delta) OVER w - delta AS BIGINT) AS time FROM s WINDOW w AS (PARTITION BY track ORDER BY idx, i ROWS UNBOUNDED PRECEDING)""")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.detections(spark, sf_dir).select(F.col("file").alias("track"), F.col("event_id").alias("idx"), (1 + F.col("event_id") % 4).cast("int").alias("count"), (F.col("event_id") % 50).alias("delta"))
    return intervals.running_time(rows, "track")


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("show#"), "label").alias("file"), (F.col("vec_id") * 1000).alias("t"), (F.col("vec_id") % 3).alias("idx"), "embedding", (F.col("vec_id") % 97 * 10).alias("area"))


@query()
def face_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.clustered(_faces(spark, sf_dir), NEAR)


@query()
def face_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.extracted(_faces(spark, sf_dir), NEAR, _blacklist(spark, sf_dir))


@query()
def face_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.merged_faces(adapters.characters(spark, sf_dir), NEAR, 2, _blacklist(spark, sf_dir))


SCENES = f"""RECURSIVE {DETECTIONS}, o AS (SELECT file, t, grp, row_number() OVER (PARTITION BY file ORDER BY t, grp) AS r FROM det),
 s AS (SELECT file, CAST(2 AS BIGINT) AS k, t AS first, t AS last, [grp] AS g, CAST([] AS VARCHAR[]) AS w, CAST(NULL AS BIGINT) AS fw, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS VARCHAR[]) AS c FROM o WHERE r = 1
 UNION ALL SELECT file, CASE WHEN over THEN coalesce(fw, k) + 1 ELSE k + 1 END, CASE WHEN over THEN pt ELSE first END, CASE WHEN over THEN pt WHEN mine THEN t ELSE last END, CASE WHEN over THEN [pg] WHEN mine THEN list_distinct(list_concat(g, w)) ELSE g END,
  CASE WHEN over OR mine THEN [] ELSE list_append(w, grp) END, CASE WHEN over OR mine THEN NULL ELSE coalesce(fw, k) END, CASE WHEN over THEN first END, CASE WHEN over THEN last END, CASE WHEN over THEN g END
  FROM (SELECT s.*, o.t, o.grp, p.t AS pt, p.grp AS pg, o.t IS NULL OR o.t - s.last > {24 * HOUR} AS over, list_contains(s.g, o.grp) AS mine FROM s LEFT JOIN o ON o.file = s.file AND o.r = s.k LEFT JOIN o p ON p.file = s.file AND p.r = coalesce(s.fw, s.k) WHERE s.first IS NOT NULL)),
 scenes AS (SELECT file, a AS "firstFace", b AS "lastFace", coalesce((SELECT max(t) FROM det WHERE det.file = s.file AND det.t < a), 0) AS start, coalesce((SELECT min(t) FROM det WHERE det.file = s.file AND det.t > b), greatest(0, b)) AS "end", list_sort(c) AS groups FROM s WHERE a IS NOT NULL)"""


@query(f"""WITH {SCENES} SELECT * FROM scenes""")
def scene_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.scenes(adapters.detections(spark, sf_dir), 24 * HOUR)


@query(f"""WITH {SCENES} SELECT * FROM scenes WHERE list_has_any(groups, ['purchase', 'signup'])""")
def scenes_with_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequential.scenes(adapters.detections(spark, sf_dir), 24 * HOUR)
    return found.where(F.arrays_overlap("groups", F.array(F.lit("purchase"), F.lit("signup"))))


@query(f"""WITH RECURSIVE {SPANS}, g AS (SELECT file, grp, CAST(sum(points) AS BIGINT) AS appearances, list({{'s': start, 'e': "end"}}) AS segs FROM spans GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY appearances DESC, grp) AS r FROM g),
 s AS (SELECT file, grp, appearances, r, CAST(1 AS BIGINT) AS spot, [segs] AS held FROM o WHERE r = 1 UNION ALL SELECT file, grp, appearances, r, spot, CASE WHEN spot > len(held) THEN list_append(held, segs) ELSE list_concat(held[:spot - 1], [list_concat(held[spot], segs)], held[spot + 1:]) END FROM (SELECT o.*, s.held, coalesce(nullif(list_position(list_transform(s.held, lambda x: len(list_filter(x, lambda a: len(list_filter(o.segs, lambda b: a.s <= b.e AND b.s <= a.e)) > 0)) = 0), true), 0), len(s.held) + 1) AS spot FROM s JOIN o ON o.file = s.file AND o.r = s.r + 1))
 SELECT file, grp, CAST(spot - 1 AS INT) AS "row", appearances FROM s""")
def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.packed(_spans(spark, sf_dir))


@query(f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT file, t, row_number() OVER (PARTITION BY file ORDER BY t) AS r FROM (SELECT DISTINCT file, t FROM det)), s AS (SELECT file, r, t, t AS last, true AS kept FROM o WHERE r = 1 UNION ALL SELECT o.file, o.r, o.t, CASE WHEN o.t - s.last >= 36000000 THEN o.t ELSE s.last END, o.t - s.last >= 36000000 FROM s JOIN o ON o.file = s.file AND o.r = s.r + 1) SELECT file, t FROM s WHERE kept""")
def thinned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.thinned(adapters.detections(spark, sf_dir), "file", 10 * HOUR)


@query(f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT file, value, row_number() OVER (PARTITION BY file ORDER BY t, event_id) AS r FROM det), e AS (SELECT file, r, value AS rate FROM o WHERE r = 1 UNION ALL SELECT o.file, o.r, 0.7 * e.rate + 0.3 * o.value FROM e JOIN o ON o.file = e.file AND o.r = e.r + 1) SELECT file, rate FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY r DESC) = 1""")
def smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.smoothed(adapters.detections(spark, sf_dir).withColumnRenamed("value", "x"), "file")


@query("""WITH RECURSIVE b AS (SELECT CAST(user_id AS VARCHAR) AS file, epoch_us(ts) // 1000 // 864000000 AS frame, event_id AS idx, {'x1': CAST(event_id % 90 AS DOUBLE), 'y1': CAST(event_id % 70 AS DOUBLE), 'x2': CAST(event_id % 90 + 40 + event_id % 11 AS DOUBLE), 'y2': CAST(event_id % 70 + 40 + event_id % 7 AS DOUBLE)} AS b, value FROM events),
 o AS (SELECT *, row_number() OVER (PARTITION BY file, frame ORDER BY value DESC, idx) AS r FROM b),
 s AS (SELECT file, frame, r, idx, [b] AS kept, true AS stays FROM o WHERE r = 1 UNION ALL SELECT file, frame, r, idx, CASE WHEN free THEN list_append(kept, b) ELSE kept END, free FROM (SELECT o.file, o.frame, o.r, o.idx, o.b, s.kept, len(list_filter(s.kept, lambda k: greatest(0.0, least(o.b.x2, k.x2) - greatest(o.b.x1, k.x1)) * greatest(0.0, least(o.b.y2, k.y2) - greatest(o.b.y1, k.y1)) / ((o.b.x2 - o.b.x1) * (o.b.y2 - o.b.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - greatest(0.0, least(o.b.x2, k.x2) - greatest(o.b.x1, k.x1)) * greatest(0.0, least(o.b.y2, k.y2) - greatest(o.b.y1, k.y1))) > 0.4)) = 0 AS free FROM s JOIN o ON o.file = s.file AND o.frame = s.frame AND o.r = s.r + 1)) SELECT file, frame, idx FROM s WHERE stays""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    boxes = adapters.detections(spark, sf_dir).select(F.col("file").cast("string").alias("file"), F.floor(F.col("t") / (240 * HOUR)).alias("frame"), n.alias("idx"), (n % 90).cast("double").alias("x1"), (n % 70).cast("double").alias("y1"), (n % 90 + 40 + n % 11).cast("double").alias("x2"), (n % 70 + 40 + n % 7).cast("double").alias("y2"), F.col("value").alias("score"))
    return sequential.suppressed(boxes)


@query("""SELECT vec_id, CAST(list_transform(embedding, lambda x: 0.5) AS DOUBLE[]) IS NOT NULL AS there, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").isNotNull().alias("there"), vectors.norm(F.col("embedding")).alias("norm"))
