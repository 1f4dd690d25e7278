"""Subtitle tracks of MP4 files: the box tree is walked in tasks, its tables are expanded by Spark, samples are read by planned ranges.

What a file's head says is a row for each box; run-length coded times, sizes, chunks and runs of chunks become rows by
explode and running sums, joined by sample. Bytes of samples are read last, for the tracks that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.colours import DEFAULT_PALETTE, yuv_rgb
from . import ranges, vobsub

#: Boxes that hold boxes on the way to the tables.
HOLDERS = ("trak", "mdia", "minf", "stbl", "edts")
TABLES = ("mvhd", "tkhd", "mdhd", "hdlr", "elst", "stsd", "stts", "stsz", "stco", "co64", "stsc")
HEAD = "path string, size long, moov binary"

#: A cue without an end of its own: milliseconds that it stays; those of one whose end isn't after its start.
UNTIMED_MS, LEAST_MS = 3000, 2000


def children(data: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Kind, begin and end of the content of each box in a part of data; a box that doesn't fit ends the walk."""
    while at + 8 <= end:
        size, begin = int.from_bytes(data[at : at + 4]), at + 8
        if size == 1:  # the size follows, in 64 bits
            if at + 16 > end:
                return
            size, begin = int.from_bytes(data[at + 8 : at + 16]), at + 16
        elif size == 0:
            size = end - at
        if size < 8 or at + size > end:
            return
        yield data[at + 4 : at + 8].decode("latin-1"), begin, at + size
        at += size


def leaves(moov: bytes) -> list[tuple[int, str, bytes]]:
    """Track (from 1; 0: the whole file), kind and content of the boxes in TABLES; of several of a kind the first."""
    found: dict[tuple[int, str], bytes] = {}
    entered: set[tuple[int, str]] = set()

    def walk(at: int, end: int, track: int) -> int:
        tracks = 0
        for kind, begin, upto in children(moov, at, end):
            if kind == "trak" and track == 0:
                tracks += 1
                walk(begin, upto, tracks)
            elif kind in HOLDERS and track and (track, kind) not in entered:
                entered.add((track, kind))
                walk(begin, upto, track)
            elif kind in TABLES:
                found.setdefault((track, kind), moov[begin:upto])
        return tracks

    walk(0, len(moov), 0)
    return [(*key, content) for key, content in found.items()]


def heads(files: DataFrame) -> DataFrame:
    """path, size and moov (the content of that box) of files (path); files without one aren't there. Only headers and that box are read."""

    def moov_of(file: pa.NativeFile) -> bytes | None:
        at, size = 0, file.size()
        while at + 8 <= size:
            head = file.read_at(min(16, size - at), at)
            length, begin = int.from_bytes(head[:4]), 8
            if length == 1:
                if len(head) < 16:
                    return None
                length, begin = int.from_bytes(head[8:16]), 16
            elif length == 0:
                length = size - at
            if length < 8 or at + length > size:
                return None
            if head[4:8] == b"moov":
                return file.read_at(length - begin, at + begin)
            at += length
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with ranges.opened(path) as file:
                    if (moov := moov_of(file)) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.size()], pa.int64()), pa.array([moov], pa.binary())], names=["path", "size", "moov"])

    return files.select("path").mapInArrow(run, HEAD)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("track", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])))
def _leaves(moov: pd.Series) -> pd.Series:
    return moov.map(lambda x: [{"track": t, "kind": k, "data": d} for t, k, d in leaves(x)])


@F.pandas_udf(T.BinaryType())
def _decoder_info(stsd: pd.Series) -> pd.Series:
    return stsd.map(lambda x: None if x is None else decoder_info(x))


def decoder_info(stsd: bytes) -> bytes | None:
    """The decoder's own data of an mp4s sample entry (of another one, if there is none), out of nested descriptors."""
    entries = list(children(stsd, 8, len(stsd)))
    entry = next((e for e in entries if e[0] == "mp4s"), entries[0] if entries else None)
    esds = next((c for c in children(stsd, entry[1] + 8, entry[2]) if c[0] == "esds"), None) if entry else None
    if esds is None:
        return None
    at, end = esds[1] + 4, esds[2]
    while at < end:
        tag, length, at = stsd[at], 0, at + 1
        for _ in range(4):
            if at >= end:
                break
            byte, at = stsd[at], at + 1
            length = length << 7 | byte & 0x7F
            if byte < 0x80:
                break
        if tag == 5:
            return stsd[at : at + length] if at + length <= end else None
        at += {3: 3, 4: 13}.get(tag, length)  # those two hold descriptors after so many bytes
    return None


def number(data: Column, at: Column | int, length: int = 4) -> Column:
    """Big-endian number in some bytes of binary data."""
    return F.conv(F.hex(F.substring(data, F.lit(at) + 1, F.lit(length))), 16, 10).cast("long")


def entries(data: Column, width: int, fields: dict[str, tuple[int, int]], first: int = 8, count_at: int = 4) -> Column:
    """Array of structs of a table's entries: a field is (place in the entry, bytes). Entries that the box doesn't hold are left out."""
    n = F.coalesce(F.least(number(data, count_at), F.floor((F.octet_length(data) - first) / width)), F.lit(0)).cast("int")
    one = lambda i: F.struct(*(number(data, first + i * width + at, size).alias(name) for name, (at, size) in fields.items()))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))


def versioned(data: Column, old: Column, new: Column) -> Column:
    return F.when(number(data, 0, 1) == 1, new).otherwise(old)


def edit_shift(elst: Column, movie_scale: Column, media_scale: Column) -> Column:
    """Milliseconds by which an edit list moves a track: empty edits before the first real one delay it, that one's start comes off."""
    old = F.transform(entries(elst, 12, {"d": (0, 4), "m": (4, 4)}), lambda e: F.struct(e["d"].alias("d"), F.when(e["m"] >= 1 << 31, e["m"] - (1 << 32)).otherwise(e["m"]).alias("m")))
    new = F.transform(entries(elst, 20, {"d": (0, 8), "h": (8, 4), "l": (12, 4)}), lambda e: F.struct(e["d"].alias("d"), F.when((e["h"] == 0xFFFFFFFF) & (e["l"] == 0xFFFFFFFF), F.lit(-1).cast("long")).otherwise(e["h"] * (1 << 32) + e["l"]).alias("m")))
    start = F.struct(F.lit(0.0).alias("ms"), F.lit(False).alias("over"))
    step = lambda s, e: F.when(s["over"], s).when(e["m"] == -1, F.struct((s["ms"] + e["d"] / movie_scale * 1000).alias("ms"), F.lit(False).alias("over"))).otherwise(F.struct((s["ms"] - e["m"] / media_scale * 1000).alias("ms"), F.lit(True).alias("over")))
    return F.coalesce(F.aggregate(versioned(elst, old, new), start, step, lambda s: s["ms"]), F.lit(0.0))


def tracks(heads: DataFrame) -> DataFrame:
    """A row for each track: path, size, track, handler, lang, timescale, shiftMs, and its tables."""
    boxes = heads.select("path", "size", F.explode(_leaves("moov")).alias("b")).select("path", "size", "b.*")
    own = boxes.where("track > 0").groupBy("path", "size", "track").agg(*(F.first(F.when(F.col("kind") == k, F.col("data")), ignorenulls=True).alias(k) for k in TABLES if k != "mvhd"))
    movie = boxes.where("track = 0 AND kind = 'mvhd'").select("path", versioned(F.col("data"), number(F.col("data"), 12), number(F.col("data"), 20)).alias("_scale"))
    letters = versioned(F.col("mdhd"), number(F.col("mdhd"), 20, 2), number(F.col("mdhd"), 36, 2))
    letter = lambda shift: F.chr((F.floor(letters / (1 << shift)) % 32) + 0x60)
    lang = F.concat(letter(10), letter(5), letter(0))
    joined = own.join(movie, "path", "left").withColumn("timescale", versioned(F.col("mdhd"), number(F.col("mdhd"), 12), number(F.col("mdhd"), 20)))
    scale = F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1000)
    return joined.withColumns({"handler": F.substring("hdlr", 9, 4).cast("string"), "lang": F.when(lang.rlike("^[a-z]{3}$"), lang).otherwise("und"), "shiftMs": edit_shift(F.col("elst"), scale, F.col("timescale"))}).drop("_scale")


def subtitle_tracks(tracks: DataFrame) -> DataFrame:
    """Those of tracks that hold sub-pictures and say their palette, with index (their place in the file) and palette (16 numbers 0xRRGGBB)."""
    info = tracks.where((F.col("handler") == "subp") & F.col("mdhd").isNotNull() & (F.col("timescale") > 0) & F.col("stsd").isNotNull()).withColumn("_info", _decoder_info("stsd")).where(F.col("_info").isNotNull())
    byte = lambda i, k: number(F.col("_info"), 4 * i + k, 1)
    known = F.least(F.lit(16), F.floor(F.octet_length("_info") / 4))
    colour = lambda i: F.when(i < known, yuv_rgb(byte(i, 1), byte(i, 2), byte(i, 3))).otherwise(F.get(F.array(*map(F.lit, DEFAULT_PALETTE)), i.cast("int")))
    listed = info.withColumn("palette", F.transform(F.sequence(F.lit(0), F.lit(15)), colour)).drop("_info")
    return listed.withColumn("index", F.row_number().over(W.partitionBy("path").orderBy("track")) - 1)


def samples(tracks: DataFrame) -> DataFrame:
    """path, track, sample (from 0), time and duration (in the track's units), at and size (bytes) of every sample that all tables know."""
    key = ["path", "track"]
    before = lambda *order: W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, *order: F.coalesce(F.sum(c).over(before(*order)), F.lit(0))

    runs = tracks.select(*key, F.posexplode(entries(F.col("stts"), 8, {"n": (0, 4), "delta": (4, 4)})).alias("run", "e")).select(*key, "run", "e.*").where("n > 0")
    runs = runs.withColumns({"_first": so_far("n", "run"), "_time": so_far(F.col("n") * F.col("delta"), "run")})
    timed = runs.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(*key, (F.col("_first") + F.col("_i")).alias("sample"), (F.col("_time") + F.col("_i") * F.col("delta")).alias("time"), F.col("delta").alias("duration"))

    one_size = number(F.col("stsz"), 4)
    n = number(F.col("stsz"), 8)
    sizes = F.when(one_size == 0, F.transform(entries(F.col("stsz"), 4, {"size": (0, 4)}, 12, 8), lambda e: e["size"])).when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda _: one_size))
    sized = tracks.select(*key, F.posexplode(sizes).alias("sample", "size")).withColumn("sample", F.col("sample").cast("long"))

    # Chunks that runs of chunks reach, in the order of the runs.
    places = F.when(F.col("stco").isNotNull(), F.transform(entries(F.col("stco"), 4, {"at": (0, 4)}), lambda e: e["at"])).otherwise(F.transform(entries(F.col("co64"), 8, {"at": (0, 8)}), lambda e: e["at"]))
    listed = tracks.select(*key, places.alias("_places"), F.posexplode(entries(F.col("stsc"), 12, {"first": (0, 4), "each": (4, 4)})).alias("run", "e")).select(*key, "run", "e.*", "_places")
    following = F.coalesce(F.lead("first").over(W.partitionBy(*key).orderBy("run")), F.size("_places") + 1)
    reached = listed.withColumn("_last", F.least(following - 1, F.size("_places"))).where((F.col("first") >= 1) & (F.col("first") <= F.col("_last")) & (F.col("each") > 0))
    chunks = reached.select(*key, "run", "each", "_places", F.explode(F.sequence("first", "_last")).alias("chunk")).select(*key, "run", "each", "chunk", F.get("_places", F.col("chunk").cast("int") - 1).alias("_base"))
    # No further than there are samples: what runs claim beyond that isn't expanded.
    count = sized.groupBy(*key).agg(F.count("*").alias("_count"))
    chunks = chunks.withColumn("_first", so_far("each", "run", "chunk")).join(count, key).where(F.col("_first") < F.col("_count"))
    held = chunks.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("each"), F.col("_count") - F.col("_first")) - 1))).select(*key, "run", "chunk", "_base", (F.col("_first") + F.col("_i")).alias("sample"))

    placed = held.join(sized, [*key, "sample"])
    inside = W.partitionBy(*key, "run", "chunk").orderBy("sample").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(timed, [*key, "sample"]).select(*key, "sample", "time", "duration", "at", "size")


def subtitle_cues(listed: DataFrame) -> DataFrame:
    """Cues of subtitle tracks: path, track, sample, startMs, endMs, data, palette, by the timing that their packets hold; packets of 4 bytes only clear the screen, and those that can't be read are none."""
    about = listed.select("path", "track", "timescale", "shiftMs", "palette", F.col("size").alias("_size"))
    wanted = samples(listed).join(about, ["path", "track"]).where(F.col("at") + F.col("size") <= F.col("_size")).drop("_size")
    packets = ranges.sample_bytes(wanted).where(F.col("size") > 4).withColumn("c", vobsub.control("data")).where(F.col("c").isNotNull())
    ms = lambda t: t / F.col("timescale") * 1000 + F.col("shiftMs")
    start = ms(F.col("time")) + F.col("c.showMs")
    end = F.when(F.col("c.hideMs").isNotNull(), ms(F.col("time")) + F.col("c.hideMs")).when(F.col("duration") > 0, ms(F.col("time") + F.col("duration"))).otherwise(start + UNTIMED_MS)
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return packets.withColumns({"_s": start, "_e": end}).select("path", "track", "sample", whole(F.col("_s")).alias("startMs"), whole(F.when(F.col("_e") <= F.col("_s"), F.col("_s") + LEAST_MS).otherwise(F.col("_e"))).alias("endMs"), "data", "palette")
