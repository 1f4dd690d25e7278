"""Queries on formats, subtitle sources, scan queues and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text
from ..operators import catalog, folders, folds, lists, scans, series, tables, tracks, triage
from ..sources import adapters
from ..streaming import sessions
from .registry import DETECTIONS, FILES, query

NOW = 1_706_000_000_000


def _n() -> Column:
    return F.col("n")


def _bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bare_files(spark, sf_dir)


ROUND = "CAST(floor({x} + 0.5) AS BIGINT)"
S = ROUND.format(x="s")


@query(f"""WITH d AS (SELECT p_partkey AS n, p_partkey % 9 * 1234.5 + p_partkey % 7 AS s, p_partkey % 11 * 123456 AS r FROM part)
 SELECT n, CASE WHEN {S} >= 3600 THEN {S} // 3600 || 'h' || CASE WHEN {S} % 3600 // 60 > 0 THEN {S} % 3600 // 60 || 'm' ELSE '' END ELSE {S} // 60 || 'm' END AS hm,
 CASE WHEN {S} >= 3600 THEN {S} // 3600 || ':' || lpad(CAST({S} % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST({S} // 60 AS VARCHAR) END || ':' || lpad(CAST({S} % 60 AS VARCHAR), 2, '0') AS clock,
 CASE WHEN r >= 1000000 THEN printf('%.2f Mbps', r / 1000000.0) WHEN r >= 1000 THEN printf('%.0f kbps', r / 1000.0) WHEN r > 0 THEN r || ' bps' END AS rate,
 CASE WHEN n % 5 * 11025 >= 1000 THEN printf('%.1f kHz', n % 5 * 11025 / 1000.0) END AS hz,
 CASE n % 9 WHEN 0 THEN NULL WHEN 1 THEN '1 (Mono)' WHEN 2 THEN '2 (Stereo)' WHEN 3 THEN '3 (2.1)' WHEN 6 THEN '6 (5.1)' WHEN 8 THEN '8 (7.1)' ELSE CAST(n % 9 AS VARCHAR) END AS channels FROM d""")
def shown_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _n() % 9 * 1234.5 + _n() % 7
    return _bare(spark, sf_dir).select("n", formats.hours_minutes(s).alias("hm"), formats.clock(s).alias("clock"), formats.bit_rate(_n() % 11 * 123456).alias("rate"), formats.sample_rate(_n() % 5 * 11025).alias("hz"), formats.channels((_n() % 9).cast("int")).alias("channels"))


@query("""SELECT p_partkey AS n, CAST(list_reduce(list_prepend(2166136261, list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 360 AS BIGINT) AS name_hue,
 CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 360 AS BIGINT) AS title_hue, (p_partkey * 137.508::DOUBLE) % 360 AS group_hue FROM part""")
def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("n"), formats.name_hue(F.col("p_name")).alias("name_hue"), formats.title_hue(F.col("p_name")).alias("title_hue"), formats.group_hue(F.col("p_partkey")).alias("group_hue"))


@query("""WITH d AS (SELECT p_partkey AS n, p_partkey % 97 * 10 AS need, list_filter([160, 320, 640], lambda w: (p_partkey // w) % 3 <> 1) AS there, p_partkey % 61 * 60.0 AS dur, p_partkey % 700 AS avail FROM part), t AS (SELECT *, CASE WHEN need <= 200 THEN 160 WHEN need <= 400 THEN 320 ELSE 640 END AS w FROM d)
 SELECT n, coalesce(list_min(list_filter(there, lambda x: x >= w)), list_min(list_filter(there, lambda x: x < w))) AS width,
 array_to_string(list_transform(list_filter([CASE WHEN dur < 1800 THEN dur / 2 ELSE dur * 0.2 END, dur * 0.1, dur * 0.05, 1, 0], lambda x: dur = 0 OR x <= dur), lambda x: printf('%.3f', CAST(x AS DOUBLE))), ',') AS every,
 CASE WHEN avail >= 100 THEN array_to_string(list_transform(range((avail + 7) // 107), lambda c: (avail - ((avail + 7) // 107 - 1) * 7) // ((avail + 7) // 107) + CASE WHEN c < (avail - ((avail + 7) // 107 - 1) * 7) % ((avail + 7) // 107) THEN 1 ELSE 0 END), ',') ELSE '' END AS columns FROM t""")
def thumb_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = F.filter(F.array(*map(F.lit, formats.THUMB_WIDTHS)), lambda w: F.floor(_n() / w) % 3 != 1)
    duration = _n() % 61 * 60.0
    # Equal times are sought once; the SQL lists them all.
    every = F.transform(formats.thumb_times(duration), lambda t: F.format_string("%.3f", t))
    whole = F.filter(F.array(F.when(duration < 1800, duration / 2).otherwise(duration * 0.2), duration * 0.1, duration * 0.05, F.lit(1.0), F.lit(0.0)), lambda t: (duration == 0) | (t <= duration))
    same = F.array_distinct(F.transform(whole, lambda t: F.format_string("%.3f", t))) == F.array_distinct(every)
    return _bare(spark, sf_dir).select("n", formats.thumb_width(_n() % 97 * 10, there).alias("width"), F.when(same, F.array_join(F.transform(whole, lambda t: F.format_string("%.3f", t)), ",")).alias("every"), F.array_join(F.transform(formats.column_widths(_n() % 700, F.lit(100), F.lit(7)), lambda x: x.cast("string")), ",").alias("columns"))


@query("""WITH d AS (SELECT p_partkey AS n, p_partkey % 83 * 10.0 AS x, p_partkey % 59 * 8.0 AS y, p_partkey % 31 * 9.0 AS w, p_partkey % 29 * 9.0 AS h FROM part), s AS (SELECT *, least(greatest(w, h, 1.0), 640.0, 360.0) AS side FROM d)
 SELECT n, side, greatest(0.0, least(x + w / 2 - side / 2, 640.0 - side)) AS sx, greatest(0.0, least(y + h / 2 - side / 2, 360.0 - side)) AS sy FROM s""")
def avatar_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _n() % 83 * 10.0, _n() % 59 * 8.0
    square = formats.avatar_square(x, y, x + _n() % 31 * 9.0, y + _n() % 29 * 9.0, F.lit(640.0), F.lit(360.0))
    return _bare(spark, sf_dir).select("n", square.alias("s")).select("n", "s.side", F.col("s.x").alias("sx"), F.col("s.y").alias("sy"))


MESSAGES = ("victim changed while decoding", "Scan Aborted", "worker unresponsive", "the decoder is stuck", "Extraction timed out after 9s", "Inactivity timeout", "plain failure")


@query(f"""WITH m AS (SELECT event_id AS n, ['{"','".join(MESSAGES)}'][CAST(event_id % 7 + 1 AS INT)] AS m FROM events) SELECT n, n % 7 < 2 AS transient, n % 7 IN (2, 3) AS hang, n % 7 IN (4, 5) AS timeout FROM m""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.array(*map(F.lit, MESSAGES))[(F.col("event_id") % 7).cast("int")]
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), formats.is_transient_error(m).alias("transient"), formats.is_hang_error(m).alias("hang"), formats.is_timeout_error(m).alias("timeout"))


NAMES = ("a.MKV", "b.mp4.part", "c.webm", "noext", "d.tS", "e.mpeg", "f.srt", ".avi", "mov")


@query("""SELECT p_partkey AS n FROM part WHERE p_partkey % 9 IN (0, 2, 4, 5, 7)""")
def video_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.array(*map(F.lit, NAMES))[(_n() % 9).cast("int")]
    return _bare(spark, sf_dir).where(formats.is_video_name(name)).select("n")


@query("""SELECT p_partkey AS n FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 4 = 1 OR p_partkey % 6 IN (1, 2)""")
def hdr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = lambda kind, hdr, transfer: F.struct(F.lit(kind).alias("kind"), hdr.alias("hdr"), transfer.alias("colorTransfer"))
    transfer = F.element_at(F.array(F.lit(None).cast("string"), F.lit("pq"), F.lit("hlg"), F.lit("bt709"), F.lit("bt709"), F.lit(None).cast("string")), (_n() % 6 + 1).cast("int"))
    listed = F.array(track("audio", F.lit(True), F.lit("pq")), track("video", F.when(_n() % 4 == 1, True), transfer))
    return _bare(spark, sf_dir).where(formats.is_hdr(listed, F.when(_n() % 13 == 0, True))).select("n")


@query(f"""WITH {FILES} SELECT key FROM bare WHERE NOT "scanBlacklisted" AND ("metadataVersion" <> 7 OR "keyframesVersion" IS DISTINCT FROM 7)""")
def unscanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bare(spark, sf_dir).where(scans.unscanned(faces=False)).select("key")


@query("""SELECT DISTINCT p_brand||'/'||p_type AS folder FROM part WHERE contains(lower(p_brand||'/'||p_type), 'econ')""")
def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bare(spark, sf_dir).select(F.col("parent").alias("folder")).distinct().where(formats.in_folder_name(F.col("folder"), " ECON "))


STEM = "p_partkey||' '||p_name"


@query(f"""WITH v AS (SELECT p_partkey AS n, p_brand||'/'||p_type||'/'||{STEM}||'.mkv' AS key, {STEM} AS stem FROM part) SELECT key, CASE n % 4 WHEN 0 THEN stem||'.en.srt' WHEN 2 THEN upper(stem)||'.VTT' ELSE stem||'.de.forced.srt' END AS name, CASE n % 4 WHEN 0 THEN 'en' WHEN 2 THEN '' ELSE 'de.forced' END AS tag, CASE n % 4 WHEN 2 THEN 'vtt' ELSE 'srt' END AS ext FROM v WHERE n % 4 <> 1""")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir)
    stem = F.regexp_replace("name", r"\.mkv$", "")
    beside = F.when(_n() % 4 == 0, F.concat(stem, F.lit(".en.srt"))).when(_n() % 4 == 1, F.concat(stem, F.lit("2.srt"))).when(_n() % 4 == 2, F.concat(F.upper(stem), F.lit(".VTT"))).otherwise(F.concat(stem, F.lit(".de.forced.srt")))
    return tracks.sidecars(files, files.select(F.concat_ws("/", "parent", beside).alias("path")))


CODES = " UNION ALL ".join(f"SELECT '{c}' AS code, '{name}' AS language" for name, codes in tracks.LANGUAGES.items() for c in codes)
TAGS = ("eng", "EN", "spa", "forced.english", "", "de", "xx", " fr ")


@query(f"""WITH code AS ({CODES}), d AS (SELECT doc_id AS n, ['{"','".join(TAGS)}'][CAST(doc_id % 8 + 1 AS INT)] AS lang FROM documents) SELECT n, CASE WHEN trim(lang) = '' THEN 'Unknown' ELSE coalesce(language, trim(lang)) END AS language, coalesce(language = 'English', false) OR contains(lower(lang), 'english') AS wanted FROM d LEFT JOIN code ON code = lower(trim(lang))""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.array(*map(F.lit, TAGS))[(F.col("doc_id") % 8).cast("int")]
    name = tracks.language_name(lang)
    return adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), name.alias("language"), tracks.matches_language(lang, name, "English ").alias("wanted"))


@query("""WITH s AS (SELECT conv_id AS key, turn AS idx, role = 'user' AS sidecar, turn % 3 = 1 AS german, turn % 2 = 0 AS vob, turn % 5 <> 4 AS ok FROM conversations), x AS (SELECT *, CAST(CASE WHEN sidecar THEN 1000 ELSE 0 END + CASE WHEN german THEN 100 ELSE 0 END + CASE WHEN vob THEN 0 ELSE 10 END AS INT) AS score FROM s WHERE ok) SELECT key, idx, score FROM x QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, idx) = 1""")
def subtitle_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    lang = F.when(t % 3 == 1, "ger").otherwise("en")
    rows = adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), t.alias("idx"), F.when(F.col("role") == "user", "sidecar").otherwise("embedded").alias("origin"), lang.alias("lang"), tracks.language_name(lang).alias("langName"), F.when(t % 2 == 0, "VobSub").otherwise("SubRip").alias("format"), (t % 5 != 4).alias("supported"))
    return tracks.best_sources(rows, "de")




@query(f"""WITH {FILES} SELECT key, CAST(row_number() OVER (ORDER BY coalesce("positionUpdatedAt", 0) DESC, coalesce("addedAt", 0) DESC, key) AS INT) AS place FROM files QUALIFY row_number() OVER (ORDER BY coalesce("positionUpdatedAt", 0) DESC, coalesce("addedAt", 0) DESC, key) <= 100""")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.files(spark, sf_dir).withColumns({"lastTouchedAt": F.col("positionUpdatedAt"), "lastScanAt": F.col("addedAt")})
    return scans.scan_table(rows).select("key", "place")


@query(f"""WITH {DETECTIONS}, kept AS (SELECT event_id AS key, t AS "at" FROM det WHERE grp = 'error' ORDER BY t DESC, event_id DESC LIMIT 200) SELECT key, "at", CAST(row_number() OVER (ORDER BY "at" DESC, key DESC) AS INT) AS place FROM kept ORDER BY "at" DESC, key DESC LIMIT 100""")
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = adapters.detections(spark, sf_dir).where(F.col("grp") == "error").select(F.col("event_id").alias("key"), F.col("t").alias("at"))
    return scans.shown_errors(scans.kept_errors(log))




@query(f"""WITH {FILES}, e AS (SELECT key, n FROM bare WHERE n % 3 = 0), r AS (SELECT user_id AS n, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY 1 ORDER BY 2 LIMIT 1000),
 p AS (SELECT e.key, CASE WHEN e.n < 40 THEN 1 ELSE 0 END AS late, CASE WHEN e.n < 20 THEN 0 WHEN r.place IS NOT NULL THEN 1 WHEN e.n % 5 = 0 THEN 2 ELSE 3 END AS tier, CASE WHEN e.n < 20 THEN e.n WHEN r.place IS NOT NULL THEN r.place WHEN e.n % 5 = 0 THEN e.n ELSE 0 END AS place FROM e LEFT JOIN r USING (n)) SELECT key, late, tier FROM p ORDER BY late, tier, place, key LIMIT 1""")
def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir)
    views = adapters.detections(spark, sf_dir).groupBy(F.col("file").alias("key")).agg(F.max("t").alias("at"))
    recent = scans.recent_keys(views).join(files.select(_n().alias("key"), F.col("key").alias("name")), "key").select(F.col("name").alias("key"), "place")
    placed = files.select("key", _n().alias("place"))
    return scans.next_file(files.where(_n() % 3 == 0), placed.where(F.col("place") < 20), recent, placed.where(F.col("place") % 5 == 0), files.where(_n() < 40)).select("key", "late", "tier")


@query("""SELECT event_type AS phase, max(epoch_us(ts) // 1000) > 0 AND 1706572800000 - max(epoch_us(ts) // 1000) < 86400000 AS fresh FROM events WHERE user_id % 2 = 0 GROUP BY 1""")
def scan_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = adapters.detections(spark, sf_dir).select((F.col("file") % 2).cast("string").alias("root"), F.col("grp").alias("phase"), F.col("t").alias("at"))
    return scans.fresh(done, "0", 1_706_572_800_000)


@query(f"""WITH {FILES} SELECT key FROM files WHERE n % 8 = 0 OR "fileModifiedAt" IS NULL""")
def missing_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.files(spark, sf_dir).withColumn("size", F.when(_n() % 8 != 0, F.col("size")))
    return scans.without_info(rows).select("key")


@query(f"""WITH {FILES} SELECT key, CASE WHEN n % 3 = 0 THEN nullif(n * 1.5, 0) WHEN n % 5 = 0 AND n % 3 <> 0 THEN "durationSec" + 2 ELSE "durationSec" END AS "durationSec" FROM bare""")
def duration_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir)
    told = files.where((_n() % 3 == 0) | (_n() % 5 == 0) | (_n() % 7 == 0)).select("key", (F.when(_n() % 3 == 0, _n() * 1.5).when(_n() % 5 == 0, F.col("durationSec") + 2).otherwise(F.col("durationSec") + 0.25) * 1000).alias("durationMs"))
    return scans.with_durations(files.withColumn("durationSec", F.when(_n() % 3 != 0, F.col("durationSec"))), told).select("key", "durationSec")


@query(f"""WITH RECURSIVE {DETECTIONS}, o AS (SELECT file, t, value, event_id % 11 = 0 AS forced, row_number() OVER (PARTITION BY file ORDER BY t, value) AS r FROM det), s AS (SELECT file, r, forced OR abs(value) >= 50 AS kept, CASE WHEN forced OR abs(value) >= 50 THEN value ELSE 0.0 END AS last, t, value FROM o WHERE r = 1 UNION ALL SELECT o.file, o.r, o.forced OR abs(o.value - s.last) >= 50, CASE WHEN o.forced OR abs(o.value - s.last) >= 50 THEN o.value ELSE s.last END, o.t, o.value FROM s JOIN o ON o.file = s.file AND o.r = s.r + 1) SELECT file AS key, t AS "at", value AS sec FROM s WHERE kept""")
def position_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = adapters.detections(spark, sf_dir).select(F.col("file").alias("key"), F.col("t").alias("at"), F.col("value").alias("sec"), (F.col("event_id") % 11 == 0).alias("forced"))
    return folds.saved_positions(reports, 50.0)


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), h AS (SELECT min(split_part(path, '/', 1)) AS host FROM t WHERE contains(path, '/')), f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/') AS folder FROM t, unnest(range(1, len(string_split(path, '/')))) AS u(i))
 SELECT 'old' AS key, CAST(1 AS BIGINT) AS "ignoredAt", CAST(NULL AS BIGINT) AS "totalFiles", CAST(NULL AS BIGINT) AS "folderCount" UNION ALL SELECT host, 1706000000000, (SELECT count(*) FROM t WHERE starts_with(path, host||'/')), (SELECT count(*) FROM f WHERE starts_with(folder, host||'/')) FROM h""")
def ignore_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = folders.tree(adapters.pages_tree(spark, sf_dir))
    host = tree.where(~F.contains("folder", F.lit("/"))).agg(F.min("folder")).first()[0]
    ignored = spark.createDataFrame([("old", 1)], "key string, ignoredAt long")
    return scans.ignored_with_stats(ignored, tree, host, NOW)


ETA = """st AS (SELECT user_id AS run, CAST(count(*) AS DOUBLE) AS el, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE sum(value) END AS done, CASE WHEN user_id % 6 = 0 THEN 0 ELSE user_id % 5 END AS files, CASE WHEN user_id % 4 = 0 THEN 100.0 ELSE 0.0 END AS cur, CASE WHEN user_id % 3 <> 0 THEN user_id % 7 * 30000.0 ELSE 0.0 END AS pos FROM events GROUP BY 1),
 lf AS (SELECT user_id AS run, coalesce(sum(CASE WHEN event_id % 3 <> 0 THEN value END), 0.0) AS s, count(*) FILTER (event_id % 3 <> 0 AND value > 0) AS k, count(*) FILTER (NOT (event_id % 3 <> 0 AND value > 0)) AS u FROM events GROUP BY 1),
 j AS (SELECT *, CASE WHEN cur > 0 THEN least(greatest(0, pos / 1000), cur) ELSE greatest(0, pos / 1000) END AS fl FROM st JOIN lf USING (run)),
 m AS (SELECT *, done + fl AS pr, files + CASE WHEN cur > 0 THEN 1 ELSE 0 END + k AS c FROM j)"""


@query(f"""WITH {ETA} SELECT run, CASE WHEN el <= 0 THEN NULL WHEN pr > 0 THEN (greatest(0, cur - fl) + s + u * CASE WHEN c > 0 THEN (done + cur + s) / c ELSE 0 END) / (pr / el) WHEN files > 0 THEN (k + u + CASE WHEN cur > 0 THEN 1 ELSE 0 END) / (files / el) END AS "etaSec", CASE WHEN el <= 0 THEN 'none' WHEN pr > 0 THEN 'media' WHEN files > 0 THEN 'files' ELSE 'none' END AS basis FROM m""")
def run_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = adapters.table(spark, sf_dir, "events")
    state = rows.groupBy("user_id").agg(F.count("*").cast("double").alias("elapsedSec"), F.sum("value").alias("v")).select(
        u.alias("run"), "elapsedSec", F.when(u % 3 == 0, 0.0).otherwise(F.col("v")).alias("doneSec"), F.when(u % 6 == 0, 0).otherwise(u % 5).alias("filesDone"),
        F.when(u % 4 == 0, 100.0).otherwise(0.0).alias("currentSec"), F.when(u % 3 != 0, u % 7 * 30000.0).otherwise(0.0).alias("positionMs"),
    )
    return scans.media_eta(state, rows.select(u.alias("run"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("durationSec")))


@query("""WITH d AS (SELECT event_id AS n, event_id % 10 AS done, CAST(event_id % 13 AS DOUBLE) AS el, CASE WHEN event_id % 4 <> 0 THEN value * 100 END AS learned, CAST(event_id % 500 * 1000 AS DOUBLE) AS ms, CASE WHEN event_id % 3 <> 0 THEN event_id % 100 / 100.0 END AS frac, event_id % 30 AS left_ FROM events),
 p AS (SELECT *, CASE WHEN frac > 0.01 THEN ms / frac END AS proj FROM d), e AS (SELECT *, greatest(coalesce(learned, 0.0), coalesce(proj, ms)) AS each FROM p)
 SELECT n, CASE WHEN done > 0 AND el > 0 THEN greatest(0, 20 - done) / (done / el) END AS "countEta", CASE WHEN each > 0 THEN greatest(0.0, coalesce(proj, each) - ms) + left_ * each END AS "etaMs", CASE WHEN each > 0 THEN each END AS "perItemMs",
 ms > 360000 * CASE WHEN left_ <= 10 THEN 4 ELSE 1 END OR coalesce(ms > 30000 * CASE WHEN left_ <= 10 THEN 4 ELSE 1 END AND frac > 0 AND ms / nullif(frac, 0) > 500000 * CASE WHEN left_ <= 10 THEN 4 ELSE 1 END, false) AS aborted FROM e""")
def live_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    ms, fraction, left = (n % 500 * 1000).cast("double"), F.when(n % 3 != 0, n % 100 / 100.0), n % 30
    eta = scans.live_eta(F.when(n % 4 != 0, F.col("value") * 100), ms, fraction, left)
    return adapters.table(spark, sf_dir, "events").select(n.alias("n"), scans.count_eta(n % 10, F.lit(20), (n % 13).cast("double")).alias("countEta"), eta["etaMs"].alias("etaMs"), eta["perItemMs"].alias("perItemMs"), scans.aborted(ms, fraction, F.lit(1.0), left).alias("aborted"))


@query("""WITH s AS (SELECT event_id AS n, value > 50 AS m, event_id % 3 > 0 AS k, event_id % 5 > 1 AS f, CASE event_type WHEN 'error' THEN 'metadata' WHEN 'click' THEN 'keyframes' ELSE 'faces' END AS c FROM events)
 SELECT n, c AS changed, CASE c WHEN 'metadata' THEN m WHEN 'keyframes' THEN m OR k ELSE m OR f END AS metadata, CASE c WHEN 'metadata' THEN m AND k WHEN 'keyframes' THEN k ELSE k OR f END AS keyframes, CASE c WHEN 'metadata' THEN m AND f WHEN 'keyframes' THEN k AND f ELSE f END AS faces FROM s""")
def phase_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "metadata").when(F.col("event_type") == "click", "keyframes").otherwise("faces")
    settings = adapters.table(spark, sf_dir, "events").select(n.alias("n"), kind.alias("changed"), (F.col("value") > 50).alias("metadata"), (n % 3 > 0).alias("keyframes"), (n % 5 > 1).alias("faces"))
    return settings.select("n", "changed", *catalog.phases(F.col("changed")))


@query(f"""WITH {FILES} SELECT key, n % 9 <> 0 AS ok, CASE WHEN n % 9 = 0 THEN NULL WHEN n % 4 = 0 THEN 'held' ELSE 'read' END AS container, CASE WHEN n % 9 = 0 THEN 'file missing on disk' END AS "ffError" FROM bare""")
def probe_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir)
    probe = lambda container: F.struct(F.lit(True).alias("ok"), F.lit(True).alias("hasVideo"), F.lit(container).alias("container"), F.lit("hevc").alias("primaryVideo"), F.lit(None).cast("string").alias("ffError"))
    held = files.where(_n() % 2 == 0).select("key", F.when(_n() % 4 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"), probe("held").alias("probe"))
    return triage.probed(files.select("key", "size", (_n() % 9 != 0).alias("exists")), held, probe("read")).select("key", "probe.ok", "probe.container", "probe.ffError")


LISTED = """l AS (SELECT o_orderpriority AS key, lower(o_orderpriority) AS name, max(epoch_us(o_orderdate) // 1000) AS last, min(o_orderkey) AS first FROM orders GROUP BY 1)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.min("o_orderkey").alias("createdAt"))
    return rows.select("key", F.lower("key").alias("name"), "createdAt", F.lit(None).cast("double").alias("order"), F.lit(False).alias("pinned"))


@query(f"""WITH {LISTED} SELECT key, CAST(row_number() OVER (ORDER BY CASE WHEN key LIKE '2%' THEN first ELSE last END DESC, name, key) AS INT) AS place FROM l WHERE key <> '3-MEDIUM'""")
def list_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = adapters.memberships(spark, sf_dir).where(~F.startswith("listKey", F.lit("2")))
    return lists.picker_order(_lists(spark, sf_dir), members, "3-MEDIUM").select("key", "place")


@query(f"""WITH {LISTED}, o AS (SELECT key, row_number() OVER (ORDER BY key) * 10 AS ord FROM l) SELECT key, CAST(CASE key WHEN '3-MEDIUM' THEN 20 WHEN '2-HIGH' THEN 30 ELSE ord END AS DOUBLE) AS "order" FROM o""")
def list_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lists(spark, sf_dir).withColumn("order", F.substring("key", 1, 1).cast("double") * 10)
    return lists.swapped(rows, "3-MEDIUM", -1)


@query(f"""WITH {LISTED}, m AS (SELECT DISTINCT o_orderpriority AS k, o_custkey AS i FROM orders), one AS (SELECT min(i) AS i FROM m WHERE k = '1-URGENT') SELECT key, (SELECT count(*) FROM m WHERE k = key AND NOT (k = '1-URGENT' AND i = (SELECT i FROM one))) AS items FROM l WHERE key <> '2-HIGH'""")
def list_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = adapters.memberships(spark, sf_dir)
    item = members.where(F.col("listKey") == "1-URGENT").agg(F.min("itemKey")).first()[0]
    rest = lists.without_list(_lists(spark, sf_dir), members, "2-HIGH")
    left = lists.without_item(*rest, "1-URGENT", item)
    return left[0].join(lists.sizes(left[1]).withColumnRenamed("listKey", "key"), "key", "left").select("key", F.coalesce("items", F.lit(0)).alias("items"))


@query(f"""WITH {LISTED}, n AS (SELECT key, name FROM l UNION ALL SELECT 'my-list', 'taken' UNION ALL SELECT 'my-list-2', 'taken too') SELECT key, name FROM n UNION ALL SELECT 'my-list-3', 'My List!' UNION ALL SELECT 'list-77', '!!'""")
def list_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = _lists(spark, sf_dir).unionByName(spark.createDataFrame([("my-list", "taken", 0, 1.0, False), ("my-list-2", "taken too", 0, 1.0, False)], "key string, name string, createdAt long, order double, pinned boolean"))
    once = lists.created(lists.created(had, " My List! ", 5), "!!", 77)
    return lists.created(lists.created(once, "MY LIST!", 9), " 1-urgent", 9).select("key", "name")


@query("""SELECT conv_id AS key, array_to_string(list_sort(list_filter(list_distinct(list(role)), lambda x: x <> 'user')), ',') AS off, array_to_string(list_sort(list_distinct(list_append(list(role), 'extra'))), ',') AS more FROM conversations GROUP BY 1""")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.collect_set("role").alias("r"))
    # A role that isn't there would be added: only those with it are asked to take it away.
    off = F.when(F.array_contains("r", "user"), lists.toggled(F.col("r"), F.lit("user"))).otherwise(F.col("r"))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("key", joined(off).alias("off"), joined(lists.toggled(F.col("r"), F.lit("extra"))).alias("more"))


@query("""SELECT 'list#'||o_orderpriority AS "listKey", count(DISTINCT o_custkey) AS items FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1""")
def list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = adapters.memberships(spark, sf_dir).select(F.concat(F.lit("list#"), "key").alias("key"))
    return lists.sizes_by_prefix(keys, "list#1-URGENT")


def _later(a: Column, b: Column) -> Column:
    return formats.later_version(a, b)


@query("""SELECT event_id AS n, greatest(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '2024-01-15T00:00:00') AS version FROM events""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    return adapters.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), _later(at, F.lit("2024-01-15T00:00:00")).alias("version"))


@query(r"""SELECT p_partkey AS n, CASE WHEN p_partkey % 2 = 0 THEN 'One, two'||chr(10)||'three' ELSE p_name END AS ass FROM part""")
def ass_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = adapters.table(spark, sf_dir, "part")
    event = F.when(F.col("p_partkey") % 2 == 0, r"0,0,Default,,0,0,0,,{\i1}One, two\Nthree").otherwise(F.col("p_name"))
    return part.select(F.col("p_partkey").alias("n"), text.ass_text(event).alias("ass"))


SUMS = """sum(CASE WHEN n % 3 <> 0 THEN n END)"""


@query(f"""WITH {FILES} SELECT 'metadata' AS phase, count(*) FILTER (NOT "scanBlacklisted" AND "metadataVersion" <> 7) AS "left", count(*) FILTER ("metadataVersion" = 7 AND n % 4 = 0) AS errored, CAST(sum(n) AS DOUBLE) AS ms FROM bare
 UNION ALL SELECT 'keyframes', count(*) FILTER (NOT "scanBlacklisted" AND coalesce("extractionError", '') = '' AND "keyframesVersion" IS DISTINCT FROM 7), NULL, CAST({SUMS} AS DOUBLE) FROM bare UNION ALL SELECT 'faces', count(*) FILTER (NOT "scanBlacklisted" AND coalesce("extractionError", '') = '' AND "facesVersion" <> 7), NULL, 0.0 FROM bare""")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bare(spark, sf_dir).withColumns({"thumbW": F.when(_n() % 4 != 0, 640), "metadataMs": _n(), "keyframesMs": F.when(_n() % 3 != 0, _n()), "facesMs": F.lit(None).cast("long")})
    return catalog.phase_totals(rows)


@query(f"""WITH {FILES}, r AS (SELECT key, n, CASE WHEN n % 3 = 0 THEN 'OK' WHEN n % 3 = 1 AND n % 2 = 0 THEN 'TIMEOUT' WHEN n % 5 = 0 THEN 'FAIL' ELSE 'moov '||n % 4 END AS shape FROM bare WHERE n % 7 <> 0) SELECT shape, count(*) AS records, min(key) AS example FROM r GROUP BY 1""")
def triage_decode_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _n()
    rows = _bare(spark, sf_dir).withColumns({"exists": n % 7 != 0, "ok": n % 3 == 0, "timedOut": n % 2 == 0, "stderr": F.when(n % 5 != 0, F.concat(F.lit("first\nmoov "), (n % 4).cast("string")))})
    return triage.decode_shapes(rows.withColumn("timedOut", F.col("timedOut") & (n % 3 == 1)))


@query(f"""WITH {FILES} SELECT key, key AS "relativePath", "extractionError", CASE WHEN n % 2 = 0 THEN size END AS size, CASE WHEN n % 3 = 0 THEN 'hevc' END AS "videoCodec", 'mkv' AS ext FROM bare WHERE coalesce("extractionError", '') <> '' AND n % 13 <> 0""")
def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir)
    column = lambda c, where: files.where(where).select("key", c.alias("value"))
    rows = triage.assembled(column(F.col("extractionError"), F.lit(True)), column(F.col("relativePath"), _n() % 13 != 0), size=column(F.col("size"), _n() % 2 == 0), videoCodec=column(F.lit("hevc"), _n() % 3 == 0))
    return rows.select("key", "relativePath", "extractionError", "size", "videoCodec", "ext")


@query(f"""WITH {FILES} SELECT key, CAST(row_number() OVER (ORDER BY lower(name), key) - 1 AS INT) AS place FROM bare WHERE NOT "scanBlacklisted" AND "metadataVersion" <> 7""")
def work_metadata_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.metadata_work(_bare(spark, sf_dir))
    return tables.numbered(rows, catalog.in_name_order(), "place").select("key", "place")


@query(f"""WITH {FILES} SELECT 'missing' AS mode, count(*) FILTER (n % 4 = 0) AS files FROM bare WHERE NOT "scanBlacklisted" UNION ALL SELECT 'force', count(*) FROM bare WHERE NOT "scanBlacklisted" UNION ALL SELECT 'skipped', count(*) FROM bare WHERE NOT "scanBlacklisted" AND n % 5 <> 1""")
def work_metadata_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _bare(spark, sf_dir).withColumn("thumbW", F.when(_n() % 4 != 0, 640))
    count = lambda rows, mode: rows.agg(F.count("*").alias("files")).select(F.lit(mode).alias("mode"), "files")
    skipped = catalog.skipped(files, files.where(_n() % 5 == 1))
    return count(catalog.metadata_work(files, "missing"), "missing").unionByName(count(catalog.metadata_work(files, "force"), "force")).unionByName(count(catalog.metadata_work(skipped, "force"), "skipped"))


@query(f"""WITH {FILES}, s AS (SELECT folder FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100) SELECT folder, CAST(row_number() OVER (ORDER BY folder) - 1 AS BIGINT) AS place FROM s WHERE folder LIKE '%/%'""")
def series_alphabetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.series_of(series.with_folder(_bare(spark, sf_dir)), 2).where(F.contains("folder", F.lit("/")))
    return series.alphabetical(found).select("folder", "place")


@query(f"""WITH {FILES}, s AS (SELECT folder, max("positionUpdatedAt") AS p FROM foldered GROUP BY 1 HAVING count(*) BETWEEN 2 AND 100), m AS (SELECT key AS "itemKey", n AS "addedAt", coalesce("positionUpdatedAt", 0) AS p, CASE WHEN n % 9 = 0 THEN n END AS rank FROM files WHERE n % 3 = 0 UNION ALL SELECT folder, 5, coalesce(p, 0), NULL FROM s)
 SELECT "itemKey", CAST(row_number() OVER (ORDER BY rank NULLS LAST, CASE WHEN rank IS NULL THEN -greatest("addedAt", p) END, "itemKey") AS INT) AS place FROM m""")
def list_mixed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = adapters.files(spark, sf_dir)
    foldered = series.with_folder(files)
    plays = series.last_plays(foldered, 2)
    videos = files.where(_n() % 3 == 0).select(F.lit("video").alias("itemType"), F.col("key").alias("itemKey"), _n().alias("addedAt"), F.when(_n() % 9 == 0, _n()).alias("rank"))
    whole = plays.select(F.lit("series").alias("itemType"), F.col("key").alias("itemKey"), F.lit(5).cast("long").alias("addedAt"), F.lit(None).cast("long").alias("rank"))
    members = lists.with_activity(videos.unionByName(whole).withColumn("listKey", F.lit("l")), files.select("key", F.col("positionUpdatedAt").alias("played")), plays)
    return lists.in_order(members, F.col("activity")).select("itemKey", "place")


@query("""WITH pg AS (SELECT page_id AS n, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), pre AS (SELECT n, array_to_string(string_split(path, '/')[1:i], '/') AS folder FROM pg, unnest(range(1, len(string_split(path, '/')))) AS t(i)) SELECT folder, sum(n % 7)::DOUBLE AS "timeMs", CAST(sum(CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS videos FROM pre GROUP BY 1""")
def folder_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.pages_tree(spark, sf_dir).withColumns({"timeMs": (_n() % 7).cast("double"), "videos": F.when(_n() % 4 == 0, 1).otherwise(0)})
    return folders.tree(rows, measures=("timeMs", "videos")).select("folder", "timeMs", "videos")


@query("""WITH w AS (SELECT event_type AS source, value, (epoch_us(ts) // 10000000 + 1 + i) * 10000000 AS e FROM events, unnest(range(6)) AS t(i)) SELECT source, e // 1000000 AS "end", sum(value) / 60 AS rate, count(*) AS reads FROM w GROUP BY 1, 2""")
def read_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = adapters.table(spark, sf_dir, "events").select(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))).alias("ts"), F.col("event_type").alias("source"), F.col("value").alias("amount"))
    return sessions.rates(reads).select("source", F.unix_seconds("end").alias("end"), "rate", "reads")
