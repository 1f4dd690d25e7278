"""A training-data pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

All stages take any columns beside those of documents and leave them as they are (the last one gives its own); an empty
table gives an empty result; texts of any length are worked on whole. What else is defined stands with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.llm import chosen_path, langid, mixing, pieces, secrets
from mediaquarry.llm.common import discard, stored, table

#: A text whose likeliest language has less than this probability isn't in a language that the corpus has.
MIN_LANGUAGE_SCORE = 0.4

# Language ID is learnt, runs are drawn by hash and piece paths are ties of a model: SQL can't express the rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found stay; texts that are null, empty or have no letter, and those that fit no language, go.

    Of languages that are as likely the first by name counts; rows with a null lang teach nothing, but are judged like
    all; repeated rows are judged alike; where nothing can be learnt all rows go.
    """
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}  # columns named like the result's stay
    found = langid.identify(docs.withColumnsRenamed(own), langid.train(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id (of several texts with it one, by hash; of repeated rows one).

    Texts without words (null, empty, blank) are no copies of anything and stay, but rows alike in doc_id and text become one;
    a row without doc_id goes if a row with one has its text.
    """
    return chosen_path.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [KIND]; all rows stay, n_chars follows. Null texts stay null; of spans that overlap the first, and of those that begin together the first kind, names the whole; repeated rows are changed alike."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order of the mix: by slot and place. A null source is a source; within one, rows go by a hash of doc_id, then doc_id; repeated rows each have a place."""
    return mixing.in_mixed_order(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and whether decoding gives the text again. A null or empty text has no ids (round_trip true); repeated rows each have theirs; a text with the space mark itself is decoded to a space there (round_trip false)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode_checked(docs, model)
    return both.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)  # no later stage reads it
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
