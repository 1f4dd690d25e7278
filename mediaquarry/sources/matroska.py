"""Subtitle tracks of Matroska files: one walk over headers finds tracks and clusters, and tasks read the clusters.

The walk hops from header to header and never reads pictures or sound. It gives a row for each track and each cluster, so
that the clusters of one long film are read by many tasks, each by windows of a size. Cues are ended by Spark, over the
cues of a track.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.colours import idx_palette
from ..functions.text import ass_text, cue_text
from ..operators.intervals import filled_ends
from . import vobsub
from .ranges import Windowed, opened

WINDOW_BYTES = 8 << 20
LEAST_MS = 2000

# Ids of elements, with the bits of their length; the kind of track that holds subtitles.
SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS = 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, CODEC_PRIVATE, LANGUAGE, NAME = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0x63A2, 0x22B59C, 0x536E
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
TOP_LEVEL = {SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
SUBTITLES = 0x11
DEFAULT_SCALE = 1_000_000

INDEX = pa.schema([("path", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("scale", pa.int64()), ("number", pa.int64()), ("type", pa.int64()), ("codec", pa.string()), ("lang", pa.string()), ("name", pa.string()), ("private", pa.binary()), ("error", pa.string())])
RAW = pa.schema([("path", pa.string()), ("number", pa.int64()), ("at", pa.int64()), ("time", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])


def variable(data: bytes, at: int, marked: bool) -> tuple[int, int, bool]:
    """A number of variable length, its bytes, and whether all its bits are set (a size that isn't known). marked: the bits of its length stay, as in ids."""
    if at >= len(data) or data[at] == 0:
        raise ValueError("not a number of variable length")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError("a number of variable length is cut off")
    value = int.from_bytes(data[at : at + length])
    bits = (1 << 7 * length) - 1
    return (value, length, False) if marked else (value & bits, length, value & bits == bits)


class Element:
    def __init__(self, file: Windowed, at: int):
        head = file.bytes(at, min(12, file.size - at))
        self.id, n, _ = variable(head, 0, True)
        self.size, m, self.unknown = variable(head, n, False)
        self.begin = at + n + m
        self.end = self.begin + self.size


def inside(file: Windowed, at: int, end: int) -> Iterator[Element]:
    while at < end:
        element = Element(file, at)
        yield element
        at = element.end


def whole_number(file: Windowed, e: Element) -> int:
    return int.from_bytes(file.bytes(e.begin, e.size))


def text_of(file: Windowed, e: Element) -> str:
    return file.bytes(e.begin, e.size).decode("utf-8", "replace").removeprefix("﻿")


def end_of(file: Windowed, cluster: Element, end: int) -> int:
    """Where a cluster ends; one of unknown size goes on to the next element that no cluster holds."""
    if not cluster.unknown:
        return cluster.end
    at = cluster.begin
    while at < end:
        child = Element(file, at)
        if child.id in TOP_LEVEL:
            return at
        at = child.end
    return end


def track_rows(file: Windowed, tracks: Element) -> Iterator[dict]:
    for entry in inside(file, tracks.begin, tracks.end):
        if entry.id == TRACK_ENTRY:
            row = {"kind": "track", "number": -1, "type": -1, "codec": "", "lang": "eng", "name": ""}
            for e in inside(file, entry.begin, entry.end):
                if e.id in (TRACK_NUMBER, TRACK_TYPE):
                    row["number" if e.id == TRACK_NUMBER else "type"] = whole_number(file, e)
                elif e.id in (CODEC_ID, LANGUAGE, NAME):
                    row[{CODEC_ID: "codec", LANGUAGE: "lang", NAME: "name"}[e.id]] = text_of(file, e)
                elif e.id == CODEC_PRIVATE:
                    row["private"] = file.bytes(e.begin, e.size)
            yield row | {"lang": row["lang"].strip()}


def walked(file: Windowed) -> Iterator[dict]:
    """Tracks and clusters, in the order of the file."""
    if file.size < 4:
        return
    segment = Element(file, 0)
    if segment.id != SEGMENT:
        segment = Element(file, segment.end)
    if segment.id != SEGMENT:
        return
    end = file.size if segment.unknown else segment.end
    at, scale, known = segment.begin, DEFAULT_SCALE, False
    while at < end:
        e = Element(file, at)
        at = e.end
        if e.id == INFO:
            scale = next((whole_number(file, x) for x in inside(file, e.begin, e.end) if x.id == TIMESTAMP_SCALE), DEFAULT_SCALE)
        elif e.id == TRACKS:
            known = True
            yield from track_rows(file, e)
        elif e.id == CLUSTER:
            if not known:
                return  # tracks have to come first
            at = end_of(file, e, end)
            yield {"kind": "cluster", "at": e.begin, "end": at, "scale": scale}


def rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=schema)


def index(files: DataFrame, window: int = 64 << 10) -> DataFrame:
    """Rows of files (path) for their tracks and clusters; a file that breaks off keeps what was found and has a row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found: list[dict] = []
                with opened(path) as file:
                    try:
                        for row in walked(Windowed(file, window)):
                            found.append({"path": path} | row)
                            if len(found) == 10_000:
                                yield rows(found, INDEX)
                                found = []
                    except ValueError as e:
                        found.append({"path": path, "kind": "error", "error": str(e)})
                yield rows(found, INDEX)

    return files.select("path").mapInArrow(run, "path string, kind string, at long, end long, scale long, number long, type long, codec string, lang string, name string, private binary, error string")


def subtitle_tracks(indexed: DataFrame) -> DataFrame:
    """path, number, lang, name, codec (as shown), supported, private and full (the codec's id) of subtitle tracks; pictures of other kinds than VobSub are listed, but can't be read."""
    upper = F.upper("codec")
    is_vobsub = F.startswith(upper, F.lit("S_VOBSUB"))
    picture = is_vobsub | F.contains(upper, F.lit("PGS")) | F.contains(upper, F.lit("DVBSUB")) | F.startswith(upper, F.lit("S_IMAGE"))
    short = F.regexp_replace(F.regexp_replace("codec", "^S_TEXT/", ""), "^S_", "")
    found = indexed.where((F.col("kind") == "track") & (F.col("type") == SUBTITLES) & (F.col("number") >= 0))
    return found.select("path", "number", "lang", "name", F.when(short == "", "sub").otherwise(short).alias("codec"), (~picture | is_vobsub).alias("supported"), "private", F.col("codec").alias("full"), is_vobsub.alias("pictures"))


def block(data: bytes) -> tuple[int, int, int, bytes]:
    """Track, time within the cluster, flags and content of a block."""
    track, n, _ = variable(data, 0, False)
    if len(data) < n + 3:
        raise ValueError("a block is cut off")
    return track, int.from_bytes(data[n : n + 2], signed=True), data[n + 2], data[n + 3 :]


def blocks(file: Windowed, at: int, end: int, numbers: set[int]) -> Iterator[dict]:
    """Blocks of a cluster that hold one frame of one of the tracks, with their time and length in the file's units. Of others only the headers are read."""
    began = 0

    def of(e: Element, length: int | None) -> Iterator[dict]:
        number = variable(file.bytes(e.begin, min(8, e.size)), 0, False)[0]
        if number in numbers:
            _, time, flags, data = block(file.bytes(e.begin, e.size))
            if flags & 6 == 0:  # more than one frame in a block isn't used for subtitles
                yield {"number": number, "at": e.begin, "time": began + time, "length": length, "data": data}

    for e in inside(file, at, end):
        if e.id == TIMESTAMP:
            began = whole_number(file, e)
        elif e.id == SIMPLE_BLOCK:
            yield from of(e, None)
        elif e.id == BLOCK_GROUP:
            parts = list(inside(file, e.begin, e.end))
            length = next((whole_number(file, x) for x in reversed(parts) if x.id == BLOCK_DURATION), None)
            for x in [x for x in parts if x.id == BLOCK][-1:]:
                yield from of(x, length)


def frames(indexed: DataFrame, tracks: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """Blocks of tracks (path, number): path, number, at, time, length (null: unknown), data, scale; a cluster that can't be read gives those before the fault."""
    wanted = tracks.groupBy("path").agg(F.collect_set("number").alias("numbers"))  # a file has few
    clusters = indexed.where("kind = 'cluster'").select("path", "at", "end", "scale").join(wanted, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, reader = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file:
                        file.close()
                    path, file = row["path"], opened(row["path"])
                    reader = Windowed(file, window)
                found = []
                try:
                    for b in blocks(reader, row["at"], row["end"], set(row["numbers"])):
                        found.append({"path": path} | b)
                        if len(found) == 1000:
                            yield out(found, row["scale"])
                            found = []
                except ValueError:
                    pass
                yield out(found, row["scale"])
        if file:
            file.close()

    def out(found: list[dict], scale: int) -> pa.RecordBatch:
        batch = rows(found, RAW)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([scale] * len(found), pa.int64())], names=[*batch.schema.names, "scale"])

    dealt = clusters.repartition("path", F.floor(F.col("at") / (4 * window))).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, "path string, number long, at long, time long, length long, data binary, scale long")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of text tracks; bytes that are no UTF-8 become marks."""
    for batch in batches:
        names = batch.schema.names
        texts = [None if p else (d or b"").decode("utf-8", "replace").removeprefix("﻿") for d, p in zip(batch.column("data").to_pylist(), batch.column("pictures").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "raw"])


def subtitle_cues(indexed: DataFrame, tracks: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """Cues of tracks (rows of subtitle_tracks): path, number, idx, startMs, endMs, text, and for pictures data and palette.

    A cue ends where its packet says so, else after its block's length, else where the next begins, but not over 15 seconds
    later. Texts that are empty are no cues; packets that can't be read are none either, but end the cue before them.
    """
    able = tracks.where("supported")
    about = able.select("path", "number", "full", "pictures", F.when(F.col("pictures"), idx_palette(F.col("private").cast("string"))).alias("palette"))
    found = frames(indexed, able, window).join(about, ["path", "number"])
    raw = found.mapInArrow(_decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", raw string")
    is_ass = F.contains("full", F.lit("ASS")) | F.contains("full", F.lit("SSA"))
    texts = raw.withColumn("text", F.when(F.col("pictures"), "").when(is_ass, ass_text(F.col("raw"))).otherwise(cue_text(F.col("raw")))).where(F.col("pictures") | (F.col("text") != ""))
    ms = F.col("scale") / 1_000_000
    timed = texts.select("path", "number", "text", "pictures", "palette", "data", F.col("at").alias("idx"), (F.col("time") * ms).alias("start"), (F.col("length") * ms).alias("duration"), F.concat_ws("\n", "path", "number").alias("_track"))
    ended = filled_ends(timed, "_track").withColumn("c", F.when(F.col("pictures"), vobsub.control("data"))).where(~F.col("pictures") | F.col("c").isNotNull())
    start = F.col("start") + F.coalesce("c.showMs", F.lit(0))
    # A packet's own end counts; what then isn't after the start is put right.
    bare = F.when(F.col("c.hideMs").isNotNull(), F.col("start") + F.col("c.hideMs")).otherwise(F.col("end"))
    shown = ended.withColumns({"_s": start, "_e": bare}).withColumn("_e", F.when(F.col("_e") <= F.col("_s"), F.col("_s") + LEAST_MS).otherwise(F.col("_e")))
    order = W.partitionBy("path", "number").orderBy("start", "idx")
    return shown.select("path", "number", (F.row_number().over(order) - 1).alias("idx"), F.col("_s").alias("startMs"), F.col("_e").alias("endMs"), "text", F.when(F.col("pictures"), F.col("data")).alias("data"), "palette")
