"""Queries on files: containers, pictures and what tables take. The files are made from the tables, by tasks, in the folder that executors share, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import frames
from ..operators import storage, tables
from ..sources import adapters, matroska, mp4, ranges, vobsub
from .registry import query


def _be(n: Column | int, length: int = 4) -> Column:
    """A number as big-endian bytes."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.unhex(F.right(F.lpad(F.hex(n.cast("long")), 2 * length, "0"), F.lit(2 * length)))


def _bytes(text: str) -> Column:
    return F.unhex(F.lit(text))


def _box(kind: str, *content: Column) -> Column:
    whole = F.concat(*content)
    return F.concat(_be(F.octet_length(whole) + 8), F.lit(kind).cast("binary"), whole)


def _joined(column: str | Column, by: str = "turn") -> Column:
    """Bytes of a group's rows, by order."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, F.hex(column).alias("h")))), lambda x: x["h"]), ""))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with a number in theirs from 0, and as bytes what a player would show: the digest of the text."""
    rows = adapters.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("i", F.row_number().over(W.partitionBy("conv").orderBy("turn", "text")) - 1)
    return numbered.withColumn("data", F.substring(F.md5("text"), 1, F.lit(8) + F.length("text") % 24).cast("binary"))


ESDS = "0000000003191234000411" + "00" * 13 + "0540" + "00EB8080" + "00108080" * 15


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A film for each conversation: two samples a chunk, three bytes between chunks; an empty edit of half a second."""
    rows = _turns(spark, sf_dir).withColumn("chunk", F.expr("i div 2"))
    rows = rows.withColumn("last", F.lead("i").over(W.partitionBy("conv", "chunk").orderBy("i")).isNull())
    padded = F.concat("data", F.when(F.col("last"), _bytes("EEEEEE")).otherwise(_bytes("")))
    rows = rows.withColumns({"padded": padded, "end": F.sum(F.octet_length(padded)).over(W.partitionBy("conv").orderBy("i").rowsBetween(W.unboundedPreceding, -1))})
    place = F.when(F.col("i") % 2 == 0, _be(24 + F.coalesce("end", F.lit(0)))).otherwise(_bytes(""))
    film = rows.groupBy("conv").agg(
        _joined("padded", "i").alias("media"), _joined(_be(F.octet_length("data")), "i").alias("sizes"), _joined(place, "i").alias("places"),
        _joined(F.concat(_be(1), _be(500 + F.col("i") * 10)), "i").alias("times"), F.count("*").alias("n"),
    )
    n = F.col("n")
    stbl = _box(
        "stbl", _box("stsd", _be(0), _be(1), _box("mp4s", _bytes("00" * 8), _box("esds", _bytes(ESDS)))), _box("stts", _be(0), _be(n), F.col("times")), _box("stsz", _be(0), _be(0), _be(n), F.col("sizes")),
        _box("stco", _be(0), _be(F.expr("(n + 1) div 2")), F.col("places")), _box("stsc", _be(0), _be(1), _be(1), _be(2), _be(1)),
    )
    media = _box("mdia", _box("mdhd", _bytes("00" * 12), _be(1000), _be(0), _bytes("15C70000")), _box("hdlr", _bytes("00" * 8), F.lit("subp").cast("binary"), _bytes("00" * 12)), _box("minf", stbl))
    moov = _box("moov", _box("mvhd", _bytes("00" * 12), _be(600), _be(0)), _box("trak", _box("edts", _box("elst", _be(0), _be(2), _be(300), _bytes("FFFFFFFF00010000"), _be(0), _be(40), _bytes("00010000"))), media))
    return film.select(F.concat(F.col("conv").cast("string"), F.lit(".mp4")).alias("name"), F.concat(_box("ftyp", F.lit("isom").cast("binary"), _be(0)), _box("mdat", F.col("media")), moov).alias("content"))


def _read_back(spark: SparkSession, made: DataFrame) -> DataFrame:
    return tables.stored(ranges.written(made, tables.new_path(spark, "media")), "media-files")


def _name(path: str = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[a-z0-9]+$", 1).cast("long").alias("conv")


TURNS = """t AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS i, coalesce(text, '') AS text FROM conversations),
 s AS (SELECT conv, i, substring(md5(text), 1, CAST(8 + length(text) % 24 AS INT)) AS data, CAST(8 + length(text) % 24 AS BIGINT) AS size FROM t),
 p AS (SELECT *, 24 + coalesce(sum(size) OVER w, 0) + 3 * (i // 2) AS "at", coalesce(sum(500 + i * 10) OVER w, 0) AS time FROM s WINDOW w AS (PARTITION BY conv ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"""WITH {TURNS} SELECT conv, CAST(i AS BIGINT) AS sample, CAST(time AS BIGINT) AS time, CAST(500 + i * 10 AS BIGINT) AS duration, CAST("at" AS BIGINT) AS "at", size, data FROM p""")
def mp4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _read_back(spark, _movies(spark, sf_dir))
    found = ranges.sample_bytes(mp4.samples(mp4.subtitle_tracks(mp4.tracks(mp4.heads(files)))))
    return found.select(_name(), "sample", "time", "duration", "at", "size", F.col("data").cast("string").alias("data"))


@query(f"""WITH {TURNS} SELECT conv, 1 AS track, 'eng' AS lang, CAST(1000 AS BIGINT) AS timescale, 460.0 AS "shiftMs", CAST(16777215 AS BIGINT) AS first FROM p GROUP BY conv""")
def mp4_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mp4.subtitle_tracks(mp4.tracks(mp4.heads(_read_back(spark, _movies(spark, sf_dir)))))
    return found.select(_name(), "track", "lang", "timescale", "shiftMs", F.col("palette")[0].cast("long").alias("first"))


# Reads of at most 100 bytes, over gaps of at most 2.
@query(f"""WITH {TURNS}, g AS (SELECT *, CASE WHEN i % 2 = 1 THEN 0 ELSE 1 END AS new FROM p), h AS (SELECT *, sum(new) OVER (PARTITION BY conv ORDER BY i) AS island FROM g), k AS (SELECT *, ("at" - min("at") OVER (PARTITION BY conv, island)) // 100 AS part FROM h)
 SELECT conv, CAST(min("at") AS BIGINT) AS start, CAST(max("at" + size) - min("at") AS BIGINT) AS length, count(*) AS samples FROM k GROUP BY conv, island, part""")
def mp4_read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mp4.samples(mp4.subtitle_tracks(mp4.tracks(mp4.heads(_read_back(spark, _movies(spark, sf_dir))))))
    return ranges.planned(found, 100, 2).select(_name(), "start", "length", F.size("samples").cast("long").alias("samples"))


def _element(code: str, *content: Column) -> Column:
    whole = F.concat(*content)
    return F.concat(_bytes(code), _bytes("01"), _be(F.octet_length(whole), 7), whole)


def _films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A film for each conversation: a cluster for each four turns, of unknown size where the conversation's number is odd; every third turn has a length of its own."""
    rows = _turns(spark, sf_dir).withColumn("cluster", F.expr("i div 4"))
    frame = F.concat(_bytes("83"), _be(F.col("i") % 4 * 700, 2), _bytes("00"), F.col("data"))
    kept = F.when(F.col("i") % 3 == 0, _element("A0", _element("A1", frame), _element("9B", _be(300 + F.col("i"), 2)))).otherwise(_element("A3", frame))
    other = _element("A3", _bytes("81000000"), F.col("text").cast("binary"))
    clusters = rows.groupBy("conv", "cluster").agg(_joined(F.concat(other, kept), "i").alias("blocks"))
    content = F.concat(_element("E7", _be(F.col("cluster") * 10_000)), F.col("blocks"))
    unknown = F.concat(_bytes("1F43B67501FFFFFFFFFFFFFF"), content)
    films = clusters.groupBy("conv").agg(_joined(F.when(F.col("conv") % 2 == 1, unknown).otherwise(_element("1F43B675", content)), "cluster").alias("clusters"))
    text = lambda s: F.lit(s).cast("binary")
    entry = lambda n, kind, codec, lang: _element("AE", _element("D7", _bytes(n)), _element("83", _bytes(kind)), _element("86", text(codec)), _element("22B59C", text(lang)))
    head = F.concat(_element("1A45DFA3", _element("4282", text("matroska"))), _bytes("1853806701FFFFFFFFFFFFFF"), _element("1549A966", _element("2AD7B1", _be(1_000_000))), _element("1654AE6B", entry("01", "01", "V_MPEG4", "und"), entry("03", "11", "S_TEXT/UTF8", "eng")))
    return films.select(F.concat(F.col("conv").cast("string"), F.lit(".mkv")).alias("name"), F.concat(head, F.col("clusters"), _element("1254C367", text("tags"))).alias("content"))


@query(f"""WITH {TURNS}, c AS (SELECT conv, i, data, (i // 4) * 10000 + i % 4 * 700.0 AS s, CASE WHEN i % 3 = 0 THEN 300 + i END AS d FROM s), e AS (SELECT *, coalesce(d, least(coalesce(lead(s) OVER (PARTITION BY conv ORDER BY s), s + 5000), s + 15000) - s) AS l FROM c)
 SELECT conv, CAST(3 AS BIGINT) AS number, CAST(i AS INT) AS idx, CAST(s AS DOUBLE) AS "startMs", CAST(s + l AS DOUBLE) AS "endMs", data AS text FROM e""")
def mkv_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = tables.stored(matroska.index(_read_back(spark, _films(spark, sf_dir))), "media-index")
    found = matroska.subtitle_cues(indexed, matroska.subtitle_tracks(indexed), 1 << 16)
    return found.select(_name(), "number", F.col("idx").cast("int").alias("idx"), "startMs", "endMs", "text")


@query(f"""WITH {TURNS} SELECT conv, CAST(3 AS BIGINT) AS number, 'UTF8' AS codec, 'eng' AS lang, true AS supported, CAST(max(i) // 4 + 1 AS BIGINT) AS clusters FROM s GROUP BY conv""")
def mkv_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = tables.stored(matroska.index(_read_back(spark, _films(spark, sf_dir))), "media-index")
    n = indexed.where("kind = 'cluster'").groupBy("path").agg(F.count("*").alias("clusters"))
    return matroska.subtitle_tracks(indexed).join(n, "path").select(_name(), "number", "codec", "lang", "supported", "clusters")


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each event: a rectangle of 16 to 47 columns and 4 lines, the first 4 to 15 columns in ink; it fades in, out or neither, and may never end."""
    n = F.col("event_id")
    wide, ink = 16 + n % 32, 4 + n % 12
    line = F.concat(F.lit("0"), F.hex(ink * 4 + 1), F.lit("0000"))  # 0x11 to 0x3D: two half bytes; then the rest of the line
    line = F.concat(F.right(line, F.length(line) - 1))
    fields = F.unhex(F.concat(line, line))  # two lines
    x, y = n % 500, n % 300
    area = F.concat(_be(x * 4096 + x + wide - 1, 3), _be(y * 4096 + y + 3, 3))
    solid, clear, kind = _bytes("04FFF0"), _bytes("040000"), n % 3
    first = F.concat(_bytes("033210"), F.when(kind == 1, clear).otherwise(solid), _bytes("05"), area, _bytes("0600040009"), _bytes("01FF"))
    then = F.concat(F.when(kind == 1, solid).when(kind == 2, clear).otherwise(_bytes("")), F.when(n % 5 == 0, _bytes("")).otherwise(_bytes("02")), _bytes("FF"))
    size = F.octet_length(fields)
    at = 4 + 2 * size
    after = at + 4 + F.octet_length(first)
    whole = F.concat(_be(after + 4 + F.octet_length(then), 2), _be(at, 2), fields, fields, _be(n % 7, 2), _be(after, 2), first, _be(90 + n % 50, 2), _be(after, 2), then)
    return adapters.table(spark, sf_dir, "events").select(n.alias("n"), whole.alias("data"), F.array(F.lit(0), n.cast("int") % 65536 + 65536, *(F.lit(0) for _ in range(14))).alias("palette"))


DELAY = "CAST(floor(({}) * 1024 * 1000 / 90000.0 + 0.5) AS INT)"


@query(f"""SELECT event_id AS n, {DELAY.format('event_id % 7')} AS "showMs", CASE WHEN event_id % 5 <> 0 THEN {DELAY.format('90 + event_id % 50')} END AS "hideMs", CAST(event_id % 500 AS INT) AS x1, CAST(event_id % 500 + 15 + event_id % 32 AS INT) AS x2, CAST(event_id % 300 AS INT) AS y1, CAST(event_id % 300 + 3 AS INT) AS y2 FROM events""")
def vobsub_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _packets(spark, sf_dir).withColumn("c", vobsub.control("data"))
    return found.select("n", *(F.col(f"c.{k}") for k in ("showMs", "hideMs", "x1", "x2", "y1", "y2")))


@query("""SELECT event_id AS n, CAST(16 + event_id % 32 AS INT) AS width, 4 AS height, sha256(unhex(repeat(repeat(lpad(hex(65536 + event_id % 65536), 6, '0') || 'FF', CAST(4 + event_id % 12 AS INT)) || repeat('00000000', CAST(16 + event_id % 32 - 4 - event_id % 12 AS INT)), 4))) AS rgba FROM events""")
def vobsub_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _packets(spark, sf_dir).withColumn("b", vobsub.bitmap("data", "palette"))
    return found.select("n", "b.width", "b.height", F.sha2("b.rgba", 256).alias("rgba"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture for each part, 64 or 32 pixels wide and high: bars of up to 15 lines at the top, 7 at the bottom (for some of nearly all lines); bars have a stray pixel or are not quite black."""
    n = F.col("p_partkey")
    side = F.when(n % 11 == 0, 32).otherwise(64)
    top, bottom = F.when(n % 13 == 0, side - 8).otherwise(n % 16), n % 8
    line = lambda *pixels: F.concat(*(F.repeat(F.lit(p), k.cast("int")) for p, k in pixels))
    bar = F.when(n % 3 == 0, line(("050505FF", side - 1), ("FFFFFFFF", F.lit(1)))).otherwise(line(("141414FF", side)))
    whole = F.concat(F.repeat(bar, top.cast("int")), F.repeat(line(("000000FF", side / 2), ("80FF10FF", side / 2)), (side - top - bottom).cast("int")), F.repeat(bar, bottom.cast("int")))
    return adapters.table(spark, sf_dir, "part").select(n.alias("n"), side.alias("side"), F.unhex(whole).alias("data"))


@query("""WITH p AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 11 = 0 THEN 32 ELSE 64 END AS side FROM part), b AS (SELECT n, side, CASE WHEN n % 13 = 0 THEN side - 8 ELSE n % 16 END AS top, n % 8 AS bottom FROM p), k AS (SELECT *, side - top - bottom AS rest FROM b)
 SELECT n, CAST(CASE WHEN side = 64 AND rest * 2 >= side THEN top ELSE 0 END AS INT) AS y, CAST(CASE WHEN side = 64 AND rest * 2 >= side THEN rest ELSE side END AS INT) AS height,
  CAST(CASE WHEN n % 3 <> 0 AND rest >= side * 6 // 10 THEN top ELSE 0 END AS INT) AS "workerY", CAST(CASE WHEN n % 3 <> 0 AND rest >= side * 6 // 10 THEN rest ELSE side END AS INT) AS "workerHeight" FROM k""")
def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.col("side")
    found = _pictures(spark, sf_dir).select("n", frames.letterbox(F.col("data"), side, side).alias("a"), frames.letterbox(F.col("data"), side, side, worker=True).alias("b"))
    return found.select("n", F.col("a.y").alias("y"), F.col("a.height").alias("height"), F.col("b.y").alias("workerY"), F.col("b.height").alias("workerHeight"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their priority for every seventh, as files of their own."""
    rows = adapters.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.array("o_totalprice", "o_totalprice").alias("prices"))
    return tables.stored(rows, "orders")


@query("""WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 = 0) AS gone FROM orders) SELECT c AS "column", n AS rows, CASE WHEN c = 'priority' THEN gone ELSE 0 END AS nulls, true AS stored FROM o, (VALUES ('o_orderkey'), ('o_custkey'), ('priority'), ('prices')) AS t(c)""")
def storage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = storage.column_sizes(storage.footers(storage.files_of(_orders(spark, sf_dir))))
    return sizes.select("column", "rows", "nulls", ((F.col("bytes") > 0) & (F.col("plain_bytes") > 0)).alias("stored"))


@query("""SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, 1 - count(DISTINCT o_custkey) / CAST(count(*) AS DOUBLE) AS duplicates, 1.0 AS "looseShare" FROM orders""")
def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    found = storage.totals(storage.footers(storage.files_of(orders)), orders, "o_custkey", F.col("file_bytes") < 64 << 20)
    return found.select("rows", "columns", "duplicates", "looseShare")
