"""Queries on the catalogue's upkeep, triage, text and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, tables, triage
from ..sources import adapters, codecs
from ..streaming import sessions
from .registry import DETECTIONS, FILES, query

NOW = 1_706_000_000_000


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue before a walk: two of three files, some marked missing."""
    n = F.col("n")
    return adapters.bare_files(spark, sf_dir).where(n % 3 != 0).select("key", "size", F.lit(NOW - catalog.DAY).alias("seenAt"), (NOW - n * 1000).alias("addedAt"), F.when(n % 8 == 1, NOW - (n % 6) * catalog.DAY).alias("missingSinceMs"))


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bare_files(spark, sf_dir).where(F.col("n") % 5 != 0).select("key", (F.col("size") + 1).alias("size"))


STORED = f"""{FILES}, old AS (SELECT key, size, {NOW} - 86400000 AS "seenAt", {NOW} - n * 1000 AS "addedAt", CASE WHEN n % 8 = 1 THEN {NOW} - (n % 6) * 86400000 END AS missing FROM bare WHERE n % 3 <> 0), walk AS (SELECT key, size + 1 AS size FROM bare WHERE n % 5 <> 0)"""


@query(f"""WITH {STORED} SELECT coalesce(w.key, o.key) AS key, coalesce(w.size, o.size) AS size, CAST(CASE WHEN w.key IS NOT NULL THEN {NOW} ELSE o."seenAt" END AS BIGINT) AS "seenAt", CAST(CASE WHEN o.key IS NULL THEN {NOW} ELSE o."addedAt" END AS BIGINT) AS "addedAt", CAST(CASE WHEN w.key IS NULL THEN missing END AS BIGINT) AS "missingSinceMs" FROM old o FULL JOIN walk w ON o.key = w.key""")
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.seen(_stored(spark, sf_dir), _walk(spark, sf_dir), NOW)


for days in (3, 30):

    @query(f"""WITH {STORED}, m AS (SELECT o.key, CAST(CASE WHEN w.key IS NULL THEN coalesce(missing, {NOW}) END AS BIGINT) AS "missingSinceMs" FROM old o LEFT JOIN walk w ON o.key = w.key) SELECT * FROM m WHERE "missingSinceMs" IS NULL OR {NOW} - "missingSinceMs" <= {days * 86400000}""", f"reconcile_{days}_days")
    def reconcile(spark: SparkSession, sf_dir: str, days: int = days) -> DataFrame:
        return catalog.reconcile(_stored(spark, sf_dir), _walk(spark, sf_dir), NOW, days).select("key", "missingSinceMs")


@query(f"""WITH {FILES}, n AS (SELECT key, CASE WHEN n % 4 = 0 THEN NULL ELSE 'new' END AS "extractionError", 9 AS "metadataVersion" FROM bare WHERE n % 6 = 0 UNION ALL SELECT 'new/'||p_partkey, 'new', 9 FROM part WHERE p_partkey % 50 = 0)
 SELECT coalesce(n.key, b.key) AS key, name, CASE WHEN n.key IS NOT NULL THEN n."extractionError" ELSE b."extractionError" END AS "extractionError", CAST(coalesce(n."metadataVersion", b."metadataVersion") AS INT) AS "metadataVersion" FROM bare b FULL JOIN n ON n.key = b.key""")
def upsert_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    n = F.col("n")
    rows = files.where(n % 6 == 0).select("key", F.when(n % 4 != 0, "new").alias("extractionError"), F.lit(9).alias("metadataVersion"))
    new = files.where(n % 50 == 0).select(F.concat(F.lit("new/"), n.cast("string")).alias("key"), F.lit("new").alias("extractionError"), F.lit(9).alias("metadataVersion"))
    return catalog.upsert(files.select("key", "name", "extractionError", "metadataVersion"), rows.unionByName(new))


@query(f"""WITH {FILES} SELECT key, CASE WHEN n % 6 = 0 THEN 0 ELSE size END AS size FROM bare WHERE n % 9 <> 0""")
def update_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    rows = files.where(F.col("n") % 6 == 0).select("key", F.lit(0).cast("long").alias("size")).union(spark.createDataFrame([("none", 0)], "key string, size long"))
    return catalog.delete(catalog.update(files.select("key", "size"), rows), files.where(F.col("n") % 9 == 0))


@query(f"""WITH {FILES} SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'set' ELSE 'clear' END AS change FROM (SELECT key FROM bare WHERE n % 2 = 0) a FULL JOIN (SELECT key FROM bare WHERE n % 3 = 0) b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL""")
def mirror_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    return catalog.mirrored(files.where(F.col("n") % 2 == 0), files.where(F.col("n") % 3 == 0))


@query(f"""WITH {FILES} SELECT key FROM bare WHERE NOT contains(regexp_replace(lower(key), '[^a-z0-9]', '', 'g'), 'widget')""")
def bulk_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    gone = spark.createDataFrame([], "key string, removedAt long")
    return catalog.removed(files, gone, files.where(text.match_filter("widget", F.col("key"))), NOW)[0].select("key")


WORK = 'SELECT key, CAST(row_number() OVER (ORDER BY "scanPriority" DESC NULLS LAST, len(string_split(key, \'/\')), key) AS BIGINT) AS place FROM bare WHERE NOT "scanBlacklisted" AND '


def _queue(rows: DataFrame) -> DataFrame:
    return tables.numbered(rows, catalog.in_work_order()).select("key", (F.col("position") + 1).alias("place"))


@query(f'WITH {FILES}, w AS ({WORK} "metadataVersion" <> 7) SELECT * FROM w')
def work_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(catalog.metadata_work(adapters.bare_files(spark, sf_dir)))


@query(f"WITH {FILES}, w AS ({WORK} \"metadataVersion\" = 7 AND \"keyframesVersion\" IS DISTINCT FROM 7 AND coalesce(\"extractionError\", '') = '') SELECT * FROM w")
def work_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(catalog.keyframe_work(adapters.bare_files(spark, sf_dir)))


def _face_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = adapters.bare_files(spark, sf_dir).withColumn("facesEmpty", F.col("n") % 2 == 0)
    rows = files.select(F.col("key").alias("fileKey"), "n")
    return files, rows.where(F.col("n") % 4 != 1), rows.where(F.col("n") % 7 != 1)


READY = "NOT \"scanBlacklisted\" AND \"keyframesVersion\" = 7 AND coalesce(\"extractionError\", '') = ''"


@query(f"WITH {FILES} SELECT key FROM bare WHERE {READY} AND (\"facesVersion\" < 7 OR (\"facesVersion\" = 7 AND n % 2 <> 0 AND (n % 4 = 1 OR n % 7 = 1)))")
def work_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.face_work(*_face_tables(spark, sf_dir)).select("key")


@query(f"WITH {FILES} SELECT key FROM bare WHERE {READY} AND \"facesVersion\" <> 7")
def work_faces_any_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.face_work(*_face_tables(spark, sf_dir), newer_redone=True).select("key")


@query(f'WITH {FILES} SELECT key, CAST(n % 5 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS INT) AS "metaAttempts", n % 5 + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END > 3 AS "gaveUp" FROM bare')
def crash_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir).withColumn("metaAttempts", (F.col("n") % 5).cast("int"))
    return catalog.attempted(files, files.where(F.col("n") % 3 == 0)).select("key", "metaAttempts", "gaveUp")


@query(f'WITH {FILES} SELECT key, CASE WHEN n % 10 <> 0 THEN "metadataVersion" END AS "metadataVersion", CASE WHEN n % 10 = 0 THEN 99 ELSE "scanPriority" END AS "scanPriority", n % 10 <> 0 AND "scanBlacklisted" AS "scanBlacklisted" FROM bare')
def force_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.bare_files(spark, sf_dir)
    return catalog.forced(files, files.where(F.col("n") % 10 == 0), 99).select("key", "metadataVersion", "scanPriority", "scanBlacklisted")


@query(f"""WITH {FILES} SELECT count(*) AS total, count(*) - count(*) FILTER ("metadataVersion" = 7) AS "metadataLeft", count(*) - count(*) FILTER ("keyframesVersion" = 7) AS "keyframesLeft", count(*) FILTER (coalesce("extractionError", '') <> '') AS failed, CAST(sum(size) AS BIGINT) AS bytes FROM bare""")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.phase_counts(adapters.bare_files(spark, sf_dir))


@query(f"""WITH {FILES}, t AS (SELECT count(*) AS rows, 1 - count(DISTINCT key) / CAST(count(*) AS DOUBLE) AS duplicates, count(key) AS a, CAST(sum(octet_length(encode(key))) AS BIGINT) AS b, count("extractionError") AS c, CAST(sum(octet_length(encode("extractionError"))) AS BIGINT) AS d FROM bare)
 SELECT 'key' AS "column", a AS filled, b AS bytes, rows, duplicates FROM t UNION ALL SELECT 'extractionError', c, d, rows, duplicates FROM t""")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table_stats(adapters.bare_files(spark, sf_dir), "key", ["key", "extractionError"])


RECORDS = f"""{FILES}, rec AS (SELECT key AS "relativePath", n, size, n % 29 <> 0 AS "exists", CASE WHEN n % 6 = 0 THEN 'avi' ELSE 'mkv' END AS ext, CASE WHEN n % 7 = 0 THEN 'Extraction timed out' WHEN n % 7 = 1 THEN 'Decoding error: frame '||n ELSE coalesce("extractionError", 'odd') END AS err,
  n % 2 = 0 AS probed, n % 12 <> 2 AS ok, n % 16 <> 4 AS video, ['h264','hevc','mpeg4','vc1','av1','mpeg2video','mpeg1video'][CAST(n % 7 + 1 AS INT)] AS codec FROM bare),
 cat AS (SELECT *, CASE WHEN NOT "exists" THEN 'file-missing' WHEN probed AND NOT ok THEN 'corrupt-container' WHEN probed AND NOT video THEN 'no-real-video' WHEN probed AND codec = 'mpeg2video' THEN 'mpeg2' WHEN probed AND codec = 'vc1' THEN 'vc1' WHEN (probed AND codec = 'mpeg4') OR ext = 'avi' THEN 'mpeg4-part2' WHEN probed AND codec = 'mpeg1video' THEN 'mpeg1' WHEN probed AND codec = 'hevc' THEN 'hevc' WHEN probed AND codec = 'h264' THEN 'h264-browser-refused' WHEN probed THEN 'other-readable-video'
  WHEN regexp_matches(err, 'cannot be decoded by this browser|decod(er|ing) error|unrecognizable format', 'i') THEN 'browser-undecodable-unprobed' WHEN regexp_matches(err, 'timed out', 'i') THEN 'timeout-unprobed' ELSE 'uncategorized' END AS category FROM rec),
 sup AS (SELECT *, CASE WHEN category IN ('file-missing','corrupt-container','no-real-video') THEN 'unsupported' WHEN category IN ('browser-undecodable-unprobed','timeout-unprobed') THEN 'investigate' WHEN category = 'uncategorized' THEN category ELSE 'offline' END AS support FROM cat)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    codec = F.array(*map(F.lit, ("h264", "hevc", "mpeg4", "vc1", "av1", "mpeg2video", "mpeg1video")))[(n % 7).cast("int")]
    probe = F.when(n % 2 == 0, F.struct((n % 12 != 2).alias("ok"), (n % 16 != 4).alias("hasVideo"), F.lit("matroska").alias("container"), codec.alias("primaryVideo"), F.array(codec, F.lit("png")).alias("video"), F.when(n % 3 == 0, F.array(F.lit("aac"))).otherwise(F.array().cast("array<string>")).alias("audio"), F.when(n % 8 == 6, "bad header").alias("ffError")))
    error = F.when(n % 7 == 0, "Extraction timed out").when(n % 7 == 1, F.concat(F.lit("Decoding error: frame "), n.cast("string"))).otherwise(F.coalesce("extractionError", F.lit("odd")))
    rows = adapters.bare_files(spark, sf_dir).select("relativePath", "n", "size", (n % 29 != 0).alias("exists"), F.when(n % 6 == 0, "avi").otherwise("mkv").alias("ext"), error.alias("extractionError"), probe.alias("probe"))
    return triage.categorized(rows)


@query(f"WITH {RECORDS} SELECT \"relativePath\", category, support FROM sup")
def triage_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("relativePath", "category", "support")


@query(f"WITH {RECORDS} SELECT support, category, count(*) AS records FROM sup GROUP BY GROUPING SETS ((support), (support, category))")
def triage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.summary(_records(spark, sf_dir))


@query(f"""WITH {RECORDS}, s AS (SELECT *, left(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(err, "relativePath", '<file>'), regexp_extract("relativePath", '[^/]*$'), '<file>'), '0x[0-9a-fA-F]+', '0x#', 'g'), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), 240) AS signature FROM sup) SELECT signature, count(*) AS records, min_by(err, "relativePath") AS example FROM s GROUP BY 1""")
def triage_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.signatures(_records(spark, sf_dir))


@query(f"""WITH {RECORDS}, s AS (SELECT *, CASE WHEN NOT probed THEN '(unprobed)' WHEN NOT ok THEN 'UNREADABLE: '||CASE WHEN n % 8 = 6 THEN 'bad header' ELSE '?' END ELSE 'matroska | v='||codec||',png a='||CASE WHEN n % 3 = 0 THEN 'aac' ELSE 'none' END END AS shape FROM sup) SELECT shape, count(*) AS records, min("relativePath") AS example FROM s GROUP BY 1""")
def triage_probe_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.probe_shapes(_records(spark, sf_dir))


@query(f"""WITH {RECORDS} SELECT "relativePath" FROM sup WHERE category = 'hevc' OR contains(lower("relativePath"), 'hevc') OR contains(lower(err), 'hevc')""")
def triage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.selected(_records(spark, sf_dir), "hevc").select("relativePath")


@query(f"""WITH {FILES} SELECT key FROM bare WHERE contains(lower(name||' '||key||coalesce(' '||"extractionError", '')||CASE WHEN coalesce("extractionError", '') <> '' THEN ' error failed' ELSE '' END||CASE WHEN "scanBlacklisted" THEN ' blacklisted skipped' ELSE '' END||CASE WHEN "metadataVersion" = 7 THEN ' scanned' ELSE ' unscanned pending' END), 'skipped scanned')""")
def scanning_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.haystack(adapters.bare_files(spark, sf_dir), "skipped scanned").select("key")


@query(r"""SELECT p_partkey AS n, regexp_replace(regexp_replace(lower(trim(p_type||' & '||p_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])||w[2:]), ' ') AS title, CASE WHEN p_size < 10 THEN '0'||p_size ELSE CAST(p_size AS VARCHAR) END AS padded, regexp_extract(p_brand||'#'||p_size, '^(.*)#([^#]*)$', 1) AS owner FROM part""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    name = F.concat("p_type", F.lit(" & "), "p_name")
    return part.select(F.col("p_partkey").alias("n"), text.slug(name).alias("slug"), text.title_case(F.col("p_name")).alias("title"), text.padded(F.col("p_size")).alias("padded"), text.owner_of(F.concat_ws("#", "p_brand", F.col("p_size").cast("string"))).alias("owner"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\{[^}]*\}', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM pages""")
def tags_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.table(spark, sf_dir, "pages").select("page_id", text.trimmed(text.without_tags(F.col("html"))).alias("plain"))


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files as they are found: last cue first, markup, a character that can't be shown, ends that are starts, times within a block."""
    c = F.col("turn")
    stamp = lambda s: F.format_string("00:%02d:%02d,%03d", F.floor(s / 60) % 60, s % 60, F.col("conv_id") % 1000)
    times = lambda s, e: F.concat(stamp(s), F.lit(" --> "), stamp(e))
    more = F.when(c % 4 == 3, F.concat_ws("\r\n", times(c * 7 + 3, c * 7 + 5), F.lit("again")))
    block = F.concat_ws("\r\n", (c + 1).cast("string"), F.concat(times(c * 7, F.when(c % 5 == 4, c * 7).otherwise(c * 7 + 3)), F.lit(" position:50%")), F.concat(F.lit("{\\an8}<i>"), F.col("role"), F.lit("</i> turn "), c.cast("string"), F.lit("\u200b")), more)
    rows = adapters.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b"))), asc=False).alias("x"))
    return rows.select(F.col("conv_id").alias("key"), F.concat(F.lit("\ufeff"), F.array_join(F.transform("x", lambda r: r["b"]), "\r\n \r\n")).alias("text"))


@query("""WITH c AS (SELECT *, CAST(turn * 7000 + conv_id % 1000 AS BIGINT) AS s FROM conversations), q AS (SELECT conv_id AS key, s AS "startMs", s + 3000 AS "endMs", role||' turn '||turn||'[U+200B]' AS cue FROM c WHERE turn % 5 <> 4 UNION ALL SELECT conv_id, s + 3000, s + 5000, 'again' FROM c WHERE turn % 4 = 3) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY "startMs") - 1 AS INT) AS idx, "startMs", "endMs", cue FROM q""")
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.subtitle_cues(_srt(spark, sf_dir))


@query("""SELECT vec_id, embedding AS back FROM embeddings""")
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "embeddings").select("vec_id", codecs.vector_text(F.col("embedding")).alias("q"))
    return rows.select("vec_id", codecs.text_vector(F.col("q"), 64).alias("back"))


@query("""SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, url AS path, CAST(page_id AS FLOAT) AS "timeMs", CAST(length(html) AS BIGINT) AS "fileCount", page_id % 7 AS "videoCount" FROM pages""")
def report_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("url").alias("path"), F.col("page_id").cast("float").alias("timeMs"), F.length("html").cast("long").alias("fileCount"), (F.col("page_id") % 7).alias("videoCount"))
    bundles = adapters.table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.collect_list(row).alias("rows")).withColumn("bundle", codecs.report_bytes("rows"))
    return bundles.select("host", F.explode(codecs.report_rows("bundle")).alias("r")).select("host", "r.*")


@query("""WITH e AS (SELECT event_id AS n, event_id % 5 <> 0 AS fine, event_id % 3 = 0 AS cover, event_id % 7 = 0 AS failed FROM events) SELECT n, fine AND NOT failed AS ok, fine AND NOT cover AS "hasVideo", CASE WHEN fine THEN 'mp4' END AS container, CASE WHEN fine AND NOT cover THEN 'hevc' END AS codec,
 CASE WHEN NOT fine THEN '' WHEN cover THEN 'webp' ELSE 'png,hevc' END AS video, CASE WHEN fine AND cover THEN '?' ELSE '' END AS audio, CASE WHEN failed THEN 'line 2 line 3' WHEN NOT fine THEN 'no streams' END AS "ffError" FROM e""")
def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    raw = F.when(n % 5 == 0, "{broken").when(n % 3 == 0, '{"streams":[{"codec_type":"video","codec_name":"webp"},{"codec_type":"audio"}],"format":{"format_name":"mp4"}}').otherwise('{"streams":[{"codec_type":"video","codec_name":"png"},{"codec_type":"video","codec_name":"hevc"}],"format":{"format_name":"mp4"}}')
    p = codecs.probe_summary(raw, n % 7 != 0, F.when(n % 7 == 0, "line 1\nline 2\nline 3"))
    rows = adapters.table(spark, sf_dir, "events").select(n.alias("n"), p.alias("p"))
    return rows.select("n", "p.ok", "p.hasVideo", "p.container", F.col("p.primaryVideo").alias("codec"), F.array_join("p.video", ",").alias("video"), F.array_join("p.audio", ",").alias("audio"), "p.ffError")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations with times made up from their place: a pause after each ninth."""
    rows = adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    start = F.col("turn") * 100.0 + F.col("i") * 0.4 + F.floor(F.col("i") / 9) * 1.0
    return rows.where(F.col("word") != "").select(F.col("conv_id").alias("key"), start.alias("start"), (start + 0.3).alias("end"), "word")


@query("""WITH RECURSIVE w AS (SELECT conv_id AS key, turn * 100.0::DOUBLE + i * 0.4::DOUBLE + (i // 9) * 1.0::DOUBLE AS start, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations) WHERE word <> ''), o AS (SELECT key, start, start + 0.3::DOUBLE AS "end", word, row_number() OVER (PARTITION BY key ORDER BY start, start + 0.3::DOUBLE, word) AS r FROM w),
 s AS (SELECT key, r, start AS first, "end" AS last, length(word) + 1 AS n, 1 AS id FROM o WHERE r = 1 UNION ALL SELECT key, r, CASE WHEN cut THEN start ELSE first END, "end", CASE WHEN cut THEN 0 ELSE n END + length(word) + 1, id + CASE WHEN cut THEN 1 ELSE 0 END FROM (SELECT o.*, s.first, s.n, s.id, o.start - s.last > 0.8::DOUBLE OR o."end" - s.first > 6.0::DOUBLE OR s.n + length(o.word) > 84 AS cut FROM s JOIN o ON o.key = s.key AND o.r = s.r + 1))
 SELECT s.key, min(o.start) AS start, max(o."end") AS "end", string_agg(o.word, ' ' ORDER BY o.r) AS cue FROM s JOIN o ON o.key = s.key AND o.r = s.r GROUP BY s.key, s.id""")
def word_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.cues(words(spark, sf_dir))


@query(f"""WITH {DETECTIONS}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w < 36000000 THEN 0 ELSE 1 END AS new FROM det WINDOW w AS (PARTITION BY file ORDER BY t)), i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY t ROWS UNBOUNDED PRECEDING) AS id FROM n) SELECT file AS key, count(*) AS events FROM i GROUP BY file, id""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"))
    return sessions.sessions(rows, "10 hours").select("key", "events")


@query("""SELECT event_type AS source, max_by(event_id, ts) AS status, max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 SECOND AS stale FROM events GROUP BY 1""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "events").select(F.timestamp_micros(text.epoch_ms(F.col("ts")) * 1000).alias("ts"), F.col("event_type").alias("source"), F.col("event_id").alias("status"))
    return sessions.latest(rows, F.timestamp_seconds(F.lit(1_706_616_000))).select("source", "status", "stale")
