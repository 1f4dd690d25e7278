"""Readers and writers of the library's small formats, as Arrow batch functions and Columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import CLOCK, SPACES, clock_ms, cue_text

FOLDER = T.StructType([T.StructField("path", T.StringType()), T.StructField("timeMs", T.FloatType()), T.StructField("fileCount", T.LongType()), T.StructField("videoCount", T.LongType())])
REPORT_MAGIC, REPORT_VERSION = 0x5343414E, 1


@F.pandas_udf(T.BinaryType())
def report_bytes(folders: pd.Series) -> pd.Series:
    """Folders (path, timeMs, fileCount, videoCount) as one bundle: magic, version, count, then length, text, float and two counts of each, little-endian."""

    def one(rows) -> bytes:
        out = [struct.pack("<III", REPORT_MAGIC, REPORT_VERSION, len(rows))]
        for r in rows:
            path = r["path"].encode()
            out += [struct.pack("<I", len(path)), path, struct.pack("<fII", r["timeMs"], r["fileCount"], r["videoCount"])]
        return b"".join(out)

    return folders.map(one)


@F.pandas_udf(T.ArrayType(FOLDER))
def report_rows(bundles: pd.Series) -> pd.Series:
    """The folders of a bundle; null for what isn't one."""

    def one(data: bytes | None):
        try:
            magic, version, n = struct.unpack_from("<III", data)
            if (magic, version) != (REPORT_MAGIC, REPORT_VERSION):
                return None
            at, rows = 12, []
            for _ in range(n):
                (length,) = struct.unpack_from("<I", data, at)
                path = data[at + 4 : at + 4 + length].decode()
                time, files, videos = struct.unpack_from("<fII", data, at + 4 + length)
                rows.append({"path": path, "timeMs": time, "fileCount": files, "videoCount": videos})
                at += 16 + length
            return rows
        except (struct.error, TypeError, UnicodeDecodeError):
            return None

    return bundles.map(one)


@F.pandas_udf(T.StringType())
def vector_text(vectors: pd.Series) -> pd.Series:
    """A vector as base64url text of its 32-bit floats, without padding."""
    import base64

    return vectors.map(lambda v: None if v is None else base64.urlsafe_b64encode(np.asarray(v, "<f4").tobytes()).decode().rstrip("="))


def text_vector(text: Column, dim: int) -> Column:
    """The vector of base64url text; null unless it has exactly dim numbers."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def floats(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None or len(b) != 4 * dim else np.frombuffer(b, "<f4"))

    alphabet = text.rlike(f"^[A-Za-z0-9_-]{{{-(-16 * dim // 3)}}}$")
    padded = F.rpad(F.translate(text, "-_", "+/"), -(-4 * dim // 3) * 4, "=")
    return floats(F.when(alphabet, F.unbase64(padded)))


#: A line with a cue's times, and what follows it up to an empty line or the end. (?d): only a line feed ends a line.
ARROW = "[{0}]*-->[{0}]*".format(SPACES.replace(r"\n", ""))
TIME_LINE = f"(?dm)^.*?{CLOCK}{ARROW}{CLOCK}.*$"
BODY = rf"^\n((?:[^\n]*[^{SPACES}][^\n]*(?:\n|$))*)"


def subtitle_cues(files: DataFrame) -> DataFrame:
    """Cues of subtitle files (key, text; SubRip or WebVTT): key, idx, startMs, endMs, cue, by start (equal ones in order of the file).

    A cue is a line with two times and the lines after it up to an empty one or the next such line; without text, or with an
    end that isn't after its start, it is none. Null texts have none.
    """
    text = F.regexp_replace(F.regexp_replace(F.col("text"), "^﻿", ""), "\r\n?", "\n")
    both = F.zip_with(F.regexp_extract_all(text, F.lit(TIME_LINE), F.lit(0)), F.slice(F.split(text, TIME_LINE, -1), 2, 1 << 30), lambda line, rest: F.struct(line.alias("line"), rest.alias("rest")))
    found = files.select("key", F.posexplode(both).alias("at", "x"))
    clock = lambda i: clock_ms(F.regexp_extract("x.line", f"({CLOCK}){ARROW}({CLOCK})", i))
    cues = found.select("key", "at", clock(1).alias("startMs"), clock(6).alias("endMs"), cue_text(F.regexp_extract("x.rest", BODY, 1)).alias("cue"))
    kept = cues.where((F.col("cue") != "") & (F.col("endMs") > F.col("startMs")))
    return kept.withColumn("idx", F.row_number().over(W.partitionBy("key").orderBy("startMs", "at")) - 1).select("key", "idx", "startMs", "endMs", "cue")


# Codecs that are only ever cover art.
COVER_ART = ("mjpeg", "png", "bmp", "gif", "webp")


def probe_summary(raw: Column, ok: Column | None = None, error: Column | None = None) -> Column:
    """What a prober's JSON says: ok, hasVideo, container, primaryVideo, video, audio (codecs, ? if unnamed), ffError; cover art is no video.

    ok: whether the prober ended well (by default whether raw can be read); error: its message, whose last two lines ffError shows.
    """
    doc = F.from_json(raw, "streams array<struct<codec_type:string,codec_name:string>>, format struct<format_name:string>")
    streams = F.coalesce(doc["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string>>"))
    codecs_of = lambda kind: F.transform(F.filter(streams, lambda s: s["codec_type"] == kind), lambda s: F.coalesce(s["codec_name"], F.lit("?")))
    video = codecs_of("video")
    real = F.filter(video, lambda c: ~c.isin(*COVER_ART))
    fine = (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))) & (F.size(streams) > 0)
    lines = F.split(F.coalesce(error if error is not None else F.lit(None).cast("string"), F.lit("no streams")), "\n")
    tail = F.left(F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 1), F.lit(2)), " "), F.lit(200))
    return F.struct(
        fine.alias("ok"), (F.size(real) > 0).alias("hasVideo"), doc["format"]["format_name"].alias("container"), F.get(real, 0).alias("primaryVideo"),
        video.alias("video"), codecs_of("audio").alias("audio"), F.when(~fine, tail).alias("ffError"),
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_of(data: pd.Series) -> pd.Series:
    """The little-endian 32-bit floats of bytes; null where their number isn't whole."""
    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


STRIP = T.StructType([T.StructField("count", T.LongType()), T.StructField("intervalSec", T.DoubleType()), T.StructField("times", T.ArrayType(T.DoubleType())), T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("complete", T.BooleanType())])


@F.pandas_udf(T.BinaryType())
def strip_bytes(interval: pd.Series, times: pd.Series, pictures: pd.Series) -> pd.Series:
    """Pictures of a video in one value: count (32 bits), interval and times (doubles, seconds), where each begins among the data and the last ends (32 bits), then the data; little-endian."""

    def one(every, at, data) -> bytes | None:
        if data is None:
            return None
        ends = np.cumsum([0, *map(len, data)])
        return b"".join([struct.pack("<Id", len(data), every), np.asarray(at, "<f8").tobytes(), ends.astype("<u4").tobytes(), *map(bytes, data)])

    return pd.Series([one(*x) for x in zip(interval, times, pictures)], dtype=object)


@F.pandas_udf(STRIP)
def strip_parts(strips: pd.Series) -> pd.DataFrame:
    """count, intervalSec, times, offsets (from the value's first byte; one more than pictures) of such values, and whether all bytes are there; null for what is too short or holds none."""

    def one(data: bytes | None):
        n = struct.unpack_from("<I", data)[0] if data is not None and len(data) >= 12 else 0
        start = 12 + 8 * n + 4 * (n + 1)
        if not n or len(data) < start:
            return (None,) * 5
        offsets = start + np.frombuffer(data, "<u4", n + 1, 12 + 8 * n).astype(np.int64)
        return n, struct.unpack_from("<d", data, 4)[0], np.frombuffer(data, "<f8", n, 12), offsets, bool(len(data) >= offsets[-1])

    return pd.DataFrame([one(x) for x in strips], columns=[f.name for f in STRIP]).astype({"count": "Int64", "intervalSec": "float64", "complete": "boolean"})
