"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of letters, lower-cased and set apart by one space, give n-grams of 1 to 3 characters, hashed to BUCKETS features.
Document frequencies are counted over all training rows in Spark; the classifier (follow-the-regularised-leader with
elastic-net penalties) is fitted in one task on a sample of at most about SAMPLE rows, drawn by a hash with the same
number of rows wanted from each language, so a language with most of the rows doesn't drown the others. A fifth of the
sample is kept from the fit and sets the temperature of the softmax. Prediction is one narrow pass over whole texts.

Defined cases: rows with a null lang or null text teach nothing; a null text or one without a letter is predicted `und`
with score 0, and so is every text if nothing could be learnt (an empty table); of languages that are as likely the first
by name is predicted; repeated rows each give a row (rows alike in doc_id and text are drawn for the sample together, of
which no more than twice SAMPLE rows are taken, in the order of their draws); other columns play no part. Texts of any
length are read whole, CHUNK characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE

BUCKETS = 1 << 15
#: Bound of the rows that the classifier is fitted on.
SAMPLE = 4000
#: More languages than this aren't labels of a language column: training says so instead of fitting them. The model has BUCKETS numbers for each.
MAX_LANGUAGES = 200
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
CHUNK = 1 << 18
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (BUCKETS + 1); the last is the intercept
    temperature: float


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point: its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a text and their counts; None without a letter. Long texts are read by chunks, each with the last two letters or spaces before it: the counts are those of the whole."""
    total, letters = np.zeros(BUCKETS, np.int64), False
    before = np.array([32], np.uint32)
    for at in range(0, len(text), CHUNK):
        cps = letter_table()[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")]
        cps = np.concatenate((before, cps, [32] if at + CHUNK >= len(text) else [])).astype(np.uint32)
        cps = cps[np.concatenate(([True], (cps[1:] != 32) | (cps[:-1] != 32)))]
        before = cps[-2:]
        if len(cps) < 3:
            continue
        a, b, c = cps[:-2], cps[1:-1], cps[2:]
        h = b * np.uint32(2654435761)
        hashes = [h, (a * np.uint32(2246822519)) ^ (h + np.uint32(374761393)), (a * np.uint32(3266489917)) ^ (h + np.uint32(668265263)) ^ (c * np.uint32(1274126177))]
        keep = b != 32
        for h in (hashes[0][keep], hashes[1], hashes[2][keep]):
            total += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(17), minlength=BUCKETS)
        letters |= bool(keep.any())
    if not letters:
        return None
    features = np.flatnonzero(total)
    return features, total[features]


def tf_idf(features: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[features]
    return x / max(np.linalg.norm(x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_languages: int) -> np.ndarray:
    """Weights by follow-the-regularised-leader: per-coordinate rates, soft thresholding by L1, shrinking by L2."""
    z, n = np.zeros((n_languages, BUCKETS + 1)), np.zeros((n_languages, BUCKETS + 1))

    def weights(at) -> np.ndarray:
        zs, ns = z[:, at], n[:, at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            features, x = rows[i]
            at, x = np.append(features, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            error = softmax(w @ x)
            error[labels[i]] -= 1
            g = error[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights(slice(None))


def fitted_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss on rows that the fit hasn't seen."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(labels)), labels]))

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame) -> Model | None:
    """A model from the rows of docs (doc_id, text, lang) that aren't held out; None if there are none."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(BUCKETS + 1, np.int64), {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE).to_pydict()
                for text, lang in zip(batch["text"], batch["lang"]):
                    if found := grams(text):
                        seen[found[0]] += 1
                        seen[BUCKETS] += 1
                        rows[lang] = rows.get(lang, 0) + 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int32()), "lang": pa.nulls(len(at), pa.string()), "n": pa.array(seen[at])})
        yield pa.RecordBatch.from_pydict({"feature": pa.array([-1] * len(rows), pa.int32()), "lang": pa.array(list(rows), pa.string()), "n": pa.array(list(rows.values()), pa.int64())})

    # At most a row for each bucket, one for their sum and one for each language come to the driver.
    counted = known.select("text", "lang").mapInArrow(frequencies, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).limit(BUCKETS + MAX_LANGUAGES + 2).collect()
    by_language = {r.lang: r.n for r in counted if r.lang is not None}
    if len(by_language) > MAX_LANGUAGES or len(counted) > BUCKETS + MAX_LANGUAGES + 1:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values: these can't all be languages")
    languages = sorted(by_language)
    if not languages:
        return None
    df = np.zeros(BUCKETS + 1)
    for r in counted:
        if r.lang is None:
            df[r.feature] = r.n
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    wanted = max(1, SAMPLE // len(languages))
    share = F.create_map(*(F.lit(x) for lang, n in by_language.items() for x in (lang, min(1.0, wanted / n))))
    drawn = F.xxhash64(F.lit("sample"), "doc_id", "text")  # rows without doc_id differ by their texts
    draw = F.pmod(drawn, F.lit(1 << 20)) / float(1 << 20)
    place = {lang: i for i, lang in enumerate(languages)}

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            for features, counts, lang in zip(*(batch.column(x) for x in ("features", "counts", "lang"))):
                f = np.frombuffer(features.as_py(), "<i4")
                rows.append((f, tf_idf(f, np.frombuffer(counts.as_py(), "<i4"), idf)))
                labels.append(place[lang.as_py()])
        if not rows:
            return
        apart = np.arange(len(rows)) % 5 == 4
        weights = fit([r for r, x in zip(rows, apart) if not x], [y for y, x in zip(labels, apart) if not x], len(languages))
        logits = np.array([weights[:, r[0]] @ r[1] + weights[:, BUCKETS] for r, x in zip(rows, apart) if x]).reshape(-1, len(languages))
        temperature = fitted_temperature(logits, np.array(labels)[apart])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.astype("<f4").tobytes()]), "temperature": pa.array([temperature])})

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE).to_pydict()
                found = [(i, lang, x) for i, text, lang in zip(batch["drawn"], batch["text"], batch["lang"]) if (x := grams(text))]
                yield pa.RecordBatch.from_pydict({"drawn": pa.array([x[0] for x in found], pa.int64()), "lang": pa.array([x[1] for x in found], pa.string()), "features": pa.array([x[2][0].astype("<i4").tobytes() for x in found], pa.binary()), "counts": pa.array([x[2][1].astype("<i4").tobytes() for x in found], pa.binary())})

    sample = known.where(draw < share[F.col("lang")]).select(drawn.alias("drawn"), "text", "lang").mapInArrow(extract, "drawn long, lang string, features binary, counts binary")
    learnt = sample.orderBy("drawn", "lang", "features").limit(2 * SAMPLE).mapInArrow(fit_sample, "weights binary, temperature double").first()
    if learnt is None:
        return None
    weights = np.frombuffer(learnt.weights, "<f4").reshape(len(languages), BUCKETS + 1)
    return Model(languages, idf.astype("f4"), weights, learnt.temperature)


def predict(text: str | None, model: Model | None) -> tuple[str, float]:
    found = grams(text) if text and model else None
    if not found:
        return UNKNOWN, 0.0
    x = tf_idf(*found, model.idf)
    p = softmax((model.weights[:, found[0]].astype(float) @ x + model.weights[:, BUCKETS]) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score for each row (columns of these names are replaced); the other columns stay."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most languages x BUCKETS numbers
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                found = [predict(x, sent.value) for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double")
