"""Subtitle sources of a video: files beside it, languages, and the one to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import stem_of
from ..functions.text import base_of, parent_of

# Codes of languages, as they stand in files, by the languages' names.
LANGUAGES = {
    "Arabic": ("ara", "ar"), "Bulgarian": ("bul", "bg"), "Chinese": ("chi", "zho", "zh"), "Czech": ("cze", "ces", "cs"), "Danish": ("dan", "da"),
    "Dutch": ("dut", "nld", "nl"), "English": ("eng", "en"), "Estonian": ("est", "et"), "Finnish": ("fin", "fi"), "French": ("fre", "fra", "fr"),
    "German": ("ger", "deu", "de"), "Greek": ("gre", "ell", "el"), "Hebrew": ("heb", "he"), "Hindi": ("hin", "hi"), "Croatian": ("hrv", "hr"),
    "Hungarian": ("hun", "hu"), "Icelandic": ("ice", "isl", "is"), "Indonesian": ("ind", "id"), "Italian": ("ita", "it"), "Japanese": ("jpn", "ja"),
    "Korean": ("kor", "ko"), "Latvian": ("lav", "lv"), "Lithuanian": ("lit", "lt"), "Malay": ("may", "msa", "ms"), "Norwegian": ("nor", "no", "nob", "nb"),
    "Polish": ("pol", "pl"), "Portuguese": ("por", "pt"), "Romanian": ("rum", "ron", "ro"), "Russian": ("rus", "ru"), "Slovak": ("slo", "slk", "sk"),
    "Slovenian": ("slv", "sl"), "Spanish": ("spa", "es"), "Serbian": ("srp", "sr"), "Swedish": ("swe", "sv"), "Thai": ("tha", "th"),
    "Turkish": ("tur", "tr"), "Ukrainian": ("ukr", "uk"), "Vietnamese": ("vie", "vi"),
}


def language_name(code: Column) -> Column:
    """The language's name; unknown codes as they are, Unknown for none."""
    trimmed = F.trim(code)
    names = F.create_map(*(F.lit(x) for name, codes in LANGUAGES.items() for c in codes for x in (c, name)))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.element_at(names, F.lower(trimmed)), trimmed))


def matches_language(lang: Column, lang_name: Column, wanted: str) -> Column:
    """Whether a source is in the wanted language: by code, by name, or because its tag holds the text."""
    w = wanted.strip().lower()
    if not w:
        return F.lit(False)
    code = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return (code == w) | (F.lower(lang_name) == F.lower(language_name(F.lit(w)))) | F.contains(F.lower(F.coalesce(lang, F.lit(""))), F.lit(w))


def best_sources(sources: DataFrame, wanted: str) -> DataFrame:
    """For each video (key) the source (idx, origin, lang, langName, format, supported) to show: files beside it first, then the wanted language, then text; the first of equal ones. Unsupported ones never."""
    score = F.when(F.col("origin") == "sidecar", 1000).otherwise(0) + F.when(matches_language(F.col("lang"), F.col("langName"), wanted), 100).otherwise(0) + F.when(F.col("format") == "VobSub", 0).otherwise(10)
    usable = sources.where("supported").withColumn("score", score)
    return usable.groupBy("key").agg(F.max_by(F.struct("idx", "score"), F.struct("score", -F.col("idx"))).alias("b")).select("key", "b.*")


def sidecars(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Subtitle files (path) beside videos (key, relativePath) whose name is the video's, or goes on after it with a dot: key, name, tag, ext.

    A file is joined by each stem that its name may have, so the files of a folder don't all meet its videos.
    """
    name = F.lower(base_of(F.col("path")))
    rows = files.where(name.rlike(r"\.(srt|vtt)$")).select(F.coalesce(parent_of(F.col("path")), F.lit("")).alias("folder"), base_of(F.col("path")).alias("name"), F.regexp_extract(name, r"^(.*)\.(srt|vtt)$", 1).alias("bare"), F.right(name, F.lit(3)).alias("ext"))
    parts = F.split("bare", r"\.")
    stems = rows.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    wanted = videos.select("key", F.coalesce(parent_of(F.col("relativePath")), F.lit("")).alias("folder"), stem_of(F.col("relativePath")).alias("stem"))
    return stems.join(wanted, ["folder", "stem"]).select("key", "name", F.regexp_replace(F.expr("substring(bare, length(stem) + 1)"), r"^\.", "").alias("tag"), "ext")
