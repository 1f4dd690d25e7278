"""Work lists that go out and results that come back, as JSON lines, and what results change."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import padded
from ..sources.adapters import VERSION
from ..sources.codecs import floats_of, strip_bytes

CHARACTER = "struct<characterIdx:int,memberCount:int,bestFaceTimeMs:double,bestFaceEmbedding_b64:string,embeddings_b64:string,frameTimes_b64:string,avatarJpeg_b64:string>"
RESULT = f"""fileKey string, characters array<{CHARACTER}>, thumbnail struct<thumbW:int,thumbH:int,source:string>,
 keyframes struct<intervalSec:double,frames:array<struct<timeSec:double,jpeg_b64:string>>>, keyframesError string,
 stats struct<faceCount:long,characterCount:long,facesExtractionMs:long>, error string, blacklist boolean"""


class Results(NamedTuple):
    files: DataFrame  # key and what changes in its row; a null column stays as it is unless `done`
    characters: DataFrame
    frames: DataFrame
    thumbnails: DataFrame
    keyframes: DataFrame
    rejected: DataFrame  # fileKey and the reason


def wrong_vectors(dim: int) -> Column:
    """Why the vectors of a result can't be right, by their lengths; null where they can."""
    floats = lambda c: F.coalesce(F.octet_length(F.try_to_binary(c, F.lit("base64"))) / 4, F.lit(-1))
    bad = lambda test: F.coalesce(F.exists("characters", test), F.lit(False))
    frames = lambda c: (floats(c["embeddings_b64"]) != c["memberCount"] * dim) | (floats(c["frameTimes_b64"]) != c["memberCount"]) | c["memberCount"].isNull()
    return F.when(bad(lambda c: floats(c["bestFaceEmbedding_b64"]) != dim), "characters of the wrong length").when(bad(frames), "frames of the wrong length")


def work_list(work: DataFrame, version: int = VERSION) -> DataFrame:
    """Lines of JSON: one with the version and the total, then one for each item of work (all its columns)."""
    head = work.agg(F.to_json(F.struct(F.lit(version).alias("version"), F.count("*").alias("total"))).alias("value"))
    return head.unionByName(work.select(F.to_json(F.struct(*work.columns)).alias("value")))


def results(lines: DataFrame) -> DataFrame:
    """Results from lines of JSON (value), one row each; lines that can't be read or name no file are left out."""
    return lines.select(F.from_json("value", RESULT).alias("r")).select("r.*").where(F.coalesce("fileKey", F.lit("")) != "")


def ingested(found: DataFrame, thumbnails: DataFrame, keyframes: DataFrame, dim: int, now: int, version: int = VERSION) -> Results:
    """What the results change: new rows of characters and frames, and rows of thumbnails and keyframes that may be written.

    A failed result only stamps its file. A thumbnail that a user picked (thumbSource), and keyframes of a newer version, stay. A
    result with a vector of another length than dim, or of frames whose length isn't its count times dim, changes nothing
    and is rejected; all others go on.
    """
    judged = found.withColumn("reason", F.when(F.coalesce("error", F.lit("")) == "", wrong_vectors(dim)))
    rejected, found = judged.where(F.col("reason").isNotNull()).select("fileKey", "reason"), judged.where(F.col("reason").isNull()).drop("reason")
    failed = F.coalesce("error", F.lit("")) != ""
    good = found.where(~failed)
    people = good.select("fileKey", F.explode("characters").alias("c")).select("fileKey", "c.*").withColumn("key", F.concat_ws("#", "fileKey", padded(F.col("characterIdx"))))
    characters = people.select("key", "fileKey", "characterIdx", "memberCount", "bestFaceTimeMs", floats_of(F.unbase64("bestFaceEmbedding_b64")).alias("bestFaceEmbedding"), F.unbase64("avatarJpeg_b64").alias("avatarJpeg"))
    frames = people.select("key", floats_of(F.unbase64("embeddings_b64")).alias("embeddings"), F.col("memberCount").alias("embeddingCount"), floats_of(F.unbase64("frameTimes_b64")).alias("frameTimes"))

    counts = good.select("fileKey", F.coalesce(F.aggregate("characters", F.lit(0).cast("long"), lambda n, c: n + c["memberCount"]), F.lit(0)).alias("faces"), F.coalesce(F.size("characters"), F.lit(0)).alias("people"), "stats")
    patched = counts.select(
        F.col("fileKey").alias("key"), F.lit(version).alias("facesVersion"), F.lit(now).cast("long").alias("facesExtractedAt"), F.lit("").alias("facesError"), (F.greatest(F.col("people"), F.lit(0)) == 0).alias("facesEmpty"),
        F.lit(None).cast("boolean").alias("scanBlacklisted"), F.coalesce("stats.faceCount", "faces").alias("faceCount"), F.coalesce(F.col("stats.characterCount"), F.greatest(F.col("people"), F.lit(0)).cast("long")).alias("characterCount"), F.lit(True).alias("done"),
    )
    stamped = found.where(failed).select(
        F.col("fileKey").alias("key"), F.lit(version).alias("facesVersion"), F.lit(now).cast("long").alias("facesExtractedAt"), F.col("error").alias("facesError"), F.lit(False).alias("facesEmpty"),
        F.when(F.col("blacklist"), True).alias("scanBlacklisted"), F.lit(None).cast("long").alias("faceCount"), F.lit(None).cast("long").alias("characterCount"), F.lit(False).alias("done"),
    )
    theirs = thumbnails.where(F.col("thumbSource") == "user").select(F.col("key").alias("fileKey"))
    thumbs = good.where(F.col("thumbnail").isNotNull()).join(theirs, "fileKey", "left_anti").select(F.col("fileKey").alias("key"), "thumbnail.thumbW", "thumbnail.thumbH", F.col("thumbnail.source").alias("thumbSource"))
    newer = keyframes.where(F.col("keyframesVersion") > version).select(F.col("key").alias("fileKey"))
    strips = F.coalesce(F.size("keyframes.frames") > 0, F.lit(False))
    told = F.coalesce("keyframesError", F.lit("")) != ""
    written = good.where(strips | told).join(newer, "fileKey", "left_anti")
    packed = written.select(
        F.col("fileKey").alias("key"), F.when(strips, strip_bytes(F.col("keyframes.intervalSec"), F.transform("keyframes.frames", lambda f: f["timeSec"]), F.transform("keyframes.frames", lambda f: F.unbase64(f["jpeg_b64"])))).alias("keyframes2"),
        F.lit(version).alias("keyframesVersion"), F.lit(now).cast("long").alias("keyframesExtractedAt"), F.when(strips, "").otherwise(F.col("keyframesError")).alias("keyframesError"),
    )
    return Results(patched.unionByName(stamped), characters, frames, thumbs, packed, rejected)
