"""Mixing: deadlines and deviations. Language ID: accuracy on rows that weren't learnt from."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mediaquarry.llm import langid, mixing


def check_mix(docs, targets, block):
    out = mixing.mix(docs, targets, block).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert len({(r.slot, r.place) for r in out}) == len(out)
    by_slot, sizes = defaultdict(set), Counter()
    for r in out:
        by_slot[r.slot].add(r.source)
        sizes[r.source, r.block] += 1
        assert r.release <= r.slot < r.deadline and 0 <= r.place < block
    assert all(len(x) == 1 for x in by_slot.values())
    for s, last in {s: max(b for x, b in sizes if x == s) for s, _ in sizes}.items():
        assert all(sizes[s, b] == block for b in range(last)) and sizes[s, last] <= block
    return out


def test_each_source_is_less_than_a_block_from_its_share(documents):
    targets = {s: w for s, w in zip(sorted(r.source for r in documents.select("source").distinct().collect() if r.source is not None), (5, 3, 1, 0.5, 0.2, 2, 2, 2, 2))}
    out = check_mix(documents, targets, 2)
    counts = Counter(r.source for r in documents.collect())
    given = {k: v for k, v in targets.items() if k in counts}
    given |= {k: min(given.values()) for k in counts if k not in given}
    weights = mixing.integer_weights(given)
    total = sum(weights.values())
    horizon = [r for r in out if r.in_horizon]
    end = max(r.slot for r in horizon)
    source_of = {r.slot: r.source for r in horizon}
    assert sorted(source_of) == list(range(end + 1))
    had = Counter()
    for slot in range(end + 1):
        had[source_of[slot]] += 1
        for s, w in weights.items():
            assert abs(had[s] - (slot + 1) * w / total) < 1


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 97, "b": 1, "c": 1, "d": 1}])
def test_schedule_meets_all_deadlines(weights):
    plan = mixing.schedule(weights)
    assert Counter(x[0] for x in plan) == weights
    assert all(release <= slot < deadline for _, _, release, deadline, slot in plan)


def test_weights_add_up():
    assert sum(mixing.integer_weights({f"s{i}": 1.0 for i in range(7)}).values()) == mixing.PERIOD
    assert mixing.integer_weights({}) == {}
    many = mixing.integer_weights({str(i): 1 / (i + 1) for i in range(900)})
    assert min(many.values()) >= 1 and sum(many.values()) == 3600
    with pytest.raises(ValueError):
        mixing.integer_weights({str(i): 1.0 for i in range(mixing.MAX_PERIOD + 1)})


def plain_mix(rows, weights, block):
    """(source, doc_id, slot, place) by serving, slot by slot, the released block whose deadline comes first."""
    period = sum(weights.values())
    names, done, slots = list(weights), dict.fromkeys(weights, 0), {}
    blocks = {k: -(-sum(r.source == k for r in rows) // block) for k in weights}
    slot = 0
    while any(done[k] < blocks[k] for k in names):
        ready = [(-(-(done[k] + 1) * period // weights[k]), i) for i, k in enumerate(names) if done[k] * period // weights[k] <= slot]
        k = names[min(ready)[1]]
        slots[k, done[k]] = slot
        done[k] += 1
        slot += 1
    out = []
    for k in names:
        mine = sorted((r.h, r.doc_id) for r in rows if r.source == k)
        out += [(k, d, slots[k, i // block], i % block) for i, (_, d) in enumerate(mine)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("targets,block", [(None, 4), ({"src1": 5.0, "src2": 1.0, "src3": 0.1}, 3)])
def test_mix_is_that_of_a_plain_schedule(documents, targets, block):
    from pyspark.sql import functions as F

    rows = documents.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id").alias("h")).collect()
    counts = Counter(r.source for r in rows)
    wanted = {k: v for k, v in targets.items() if k in counts} if targets else {k: n**mixing.TEMPER for k, n in counts.items()}
    wanted |= {k: min(wanted.values(), default=1.0) for k in counts if wanted.get(k, 0) <= 0}
    got = mixing.mix(documents, targets, block).collect()
    assert sorted(((r.source, r.doc_id, r.slot, r.place) for r in got), key=repr) == plain_mix(rows, mixing.integer_weights(wanted), block)


def test_mix_of_odd_rows(odd_documents, no_documents):
    check_mix(odd_documents, None, 2)
    check_mix(odd_documents, {"a": 3.0, "not there": 2.0}, 16)
    assert mixing.mix(no_documents).count() == 0
    assert mixing.in_mixed_order(odd_documents).columns == odd_documents.columns
    assert mixing.in_mixed_order(odd_documents).count() == odd_documents.count()


def test_accuracy_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).select("doc_id", "lang", "lang_pred", "score", langid.held_out(F.col("doc_id")).alias("held_out")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    judged = [r for r in found if r.held_out and r.lang is not None and r.lang_pred != langid.UNKNOWN]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.97 * len(judged)
    # Calibrated: the mean score is near the share of right answers.
    assert abs(np.mean([r.score for r in judged]) - np.mean([r.lang == r.lang_pred for r in judged])) < 0.05


def test_nothing_is_learnt_from_held_out_rows(documents):
    from pyspark.sql import functions as F

    changed = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    a, b = langid.train(documents), langid.train(changed)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_languages_of_odd_rows(documents, odd_documents, no_documents):
    model = langid.train(documents)
    out = langid.identify(odd_documents, model).collect()
    assert len(out) == odd_documents.count()
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(no_documents, model).count() == 0
    assert langid.train(no_documents) is None
    assert {r.lang_pred for r in langid.identify(odd_documents, None).collect()} == {"und"}
    assert langid.train(odd_documents).languages


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 101])
@pytest.mark.parametrize("text", ["Große Straße, été 12 und ein Fluß " * 4, "  12 ab cd ef", "ab cd ef", "x", "x ", " x", "12  34", "a  b", "1a", "a1"])
def test_long_texts_give_the_features_of_the_whole(monkeypatch, chunk, text):
    monkeypatch.setattr(langid, "CHUNK", 1 << 18)
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "CHUNK", chunk)
    parts = langid.grams(text)
    assert (whole is None) == (parts is None)
    assert whole is None or (np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1]))


def test_features_are_those_of_runs_of_letters():
    for text in ("ab cd ef", "x", "Ab1é"):
        runs = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        grams = [runs[i] for i in range(len(runs)) if runs[i] != " "] + [runs[i : i + 2] for i in range(len(runs) - 2)] + [runs[i : i + 3] for i in range(len(runs) - 2) if runs[i + 1] != " "]
        assert langid.grams(text)[1].sum() == len(grams)


def test_rows_without_ids_do_not_share_a_draw(spark):
    rows = [(None, f"der Fluss Nummer {i} und das Meer", "de") for i in range(300)] + [(None, f"the river number {i} and the sea", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    found = langid.identify(docs, model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * 600


def test_fit_is_plain_follow_the_regularised_leader(monkeypatch):
    """Against a dense loop over one number at a time, with a handful of features."""
    monkeypatch.setattr(langid, "BUCKETS", 6)
    monkeypatch.setattr(langid, "L1", 1.0)
    draw = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        features = np.sort(draw.choice(6, draw.integers(1, 5), replace=False))
        rows.append((features, draw.random(len(features))))
    labels = [int(f[0] % 3) for f, _ in rows]
    z, n = [[0.0] * 7 for _ in range(3)], [[0.0] * 7 for _ in range(3)]

    def weight(k, j):
        if abs(z[k][j]) <= langid.L1:
            return 0.0
        return -(z[k][j] - math.copysign(langid.L1, z[k][j])) / ((langid.BETA + math.sqrt(n[k][j])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(rows)):
            x = [0.0] * 6 + [1.0]
            for j, v in zip(*rows[i]):
                x[j] = v
            w = [[weight(k, j) for j in range(7)] for k in range(3)]
            e = [math.exp(sum(a * b for a, b in zip(w[k], x))) for k in range(3)]
            for k in range(3):
                for j in range(7):
                    if x[j]:
                        g = (e[k] / sum(e) - (k == labels[i])) * x[j]
                        sigma = (math.sqrt(n[k][j] + g * g) - math.sqrt(n[k][j])) / langid.ALPHA
                        z[k][j] += g - sigma * w[k][j]
                        n[k][j] += g * g
    want = np.array([[weight(k, j) for j in range(7)] for k in range(3)])
    got = langid.fit(rows, labels, 3)
    assert np.allclose(got, want, atol=1e-9) and (want == 0).any() and (want != 0).sum() > 5


def test_temperature_is_the_best_of_a_scan():
    draw = np.random.default_rng(5)
    logits, labels = draw.normal(size=(200, 4)) * 6, draw.integers(0, 4, 200)
    labels[:120] = logits[:120].argmax(axis=1)
    loss = lambda t: -np.mean([math.log(math.exp(r[y] / t) / sum(math.exp(v / t) for v in r)) for r, y in zip(logits, labels)])
    got = langid.fitted_temperature(logits, labels)
    assert all(loss(got) <= loss(t) + 1e-12 for t in np.geomspace(0.05, 20, 121)) and 1 < got < 20


def test_a_column_that_holds_no_languages_is_refused(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "'some text' AS text", "concat('label', id % 3000) AS lang")
    with pytest.raises(ValueError, match="can't all be languages"):
        langid.train(docs)
