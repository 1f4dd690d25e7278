"""Repeated spans against a plain look at all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediaquarry.llm import lzparse

W = lzparse.WINDOW


def plain(rows):
    """Sorted (doc_id, n_words, n_removed, kept digest)."""
    cut = [(doc, (text or "").encode().split()) for doc, text in rows]
    first = {}
    for doc, words in cut:
        for i in range(len(words) - W + 1):
            if doc is not None:
                key = tuple(words[i : i + W])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, words in cut:
        gone = set()
        for i in range(len(words) - W + 1):
            if doc is not None and first[tuple(words[i : i + W])] < doc:
                gone.update(range(i, i + W))
        out.append((doc, len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


def results(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


def texts(seed, n=60):
    """Texts of few words that share passages, cut and strung together at random."""
    draw = random.Random(seed)
    few = ["a", "b", "ab", "c", "é", "🙂"]
    passages = [" ".join(draw.choice(few) for _ in range(draw.choice([12, 13, 14, 20, 40]))) for _ in range(8)]
    for _ in range(n):
        yield "".join(draw.choice([*passages, draw.choice(few), "x" + str(draw.random())]) + draw.choice([" ", "\n", " \t ", "\v\f\r"]) for _ in range(draw.randrange(12)))


@pytest.mark.parametrize(("hot", "common"), [(2000, 100_000), (3, 100_000), (3, 20), (3, 0)])
def test_random_passages(spark, hot, common, monkeypatch):
    monkeypatch.setattr(lzparse, "HOT", hot)
    monkeypatch.setattr(lzparse, "COMMON", common)
    rows = [(i * 7 % 61, t) for i, t in enumerate(texts(1))] + [(None, t) for t in texts(1, 4)] + [(3, t) for t in texts(2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert results(lzparse.without_repeats(docs, texts=False)) == want and sum(r[2] for r in want) > 1000


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert results(lzparse.without_repeats(odd_documents, texts=False)) == plain(rows)
    assert lzparse.without_repeats(no_documents, texts=False).count() == 0
    kept = {r.doc_id: r.kept_text for r in lzparse.without_repeats(odd_documents).where("doc_id IN (5, 6)").collect()}
    assert kept[6] == "" and len(kept[5].split()) == 17


def test_full_filter_changes_nothing(spark, documents, monkeypatch):
    want = results(lzparse.without_repeats(documents, texts=False))
    monkeypatch.setattr(lzparse, "FILTER_BITS", 1)
    monkeypatch.setattr(lzparse, "BITMAP_BITS", 32768)
    assert results(lzparse.without_repeats(documents, texts=False)) == want and sum(r[2] for r in want)


def test_one_common_passage(spark):
    """A passage in all documents, with other words around it: its edges have an anchor in common, which is hot."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'{i}u{j}' for j in range(9))} {passage} {' '.join(f'{i}v{j}' for j in range(9))}") for i in range(2600)]
    got = results(lzparse.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), texts=False))
    assert sorted((r[0], r[2]) for r in got) == [(i, 30 if i else 0) for i in range(2600)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5))
def test_factors(segments):
    """A block finds each window that an earlier document has, also across the ends of factors."""
    block, seen = lzparse.Block(), set()
    for doc, words in enumerate(segments):
        got = set()
        for a, b in block.factors(doc, words):
            assert b - a >= W
            got.update(range(a, b))
        want = set()
        for i in range(len(words) - W + 1):
            if tuple(words[i : i + W]) in seen:
                want.update(range(i, i + W))
        assert got == want
        seen.update(tuple(words[i : i + W]) for i in range(len(words) - W + 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é🙂\t\n\v", max_size=40), max_size=6), st.integers(0, 2))
def test_words_of_a_column(rows, skip):
    column = pa.array(["zz zz"] * skip + rows, pa.string()).slice(skip)
    words = lzparse.Words(column)
    got = [[] for _ in rows]
    for a, b, r in zip(words.starts, words.ends, words.rows):
        got[r].append(words.data[a:b].tobytes())
    assert got == [t.encode().split() for t in rows]
    h = lzparse.hashed(words.data, words.starts, words.ends)
    flat = [w for r in got for w in r]
    assert len({*zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


def test_very_long_words():
    text = " ".join(["x" * 200_000, "y" * 600_000, "x" * 200_000, "z", "x" * 60_000, "x" * 60_000])
    words = lzparse.Words(pa.array([text]))
    h = lzparse.hashed(words.data, words.starts, words.ends)
    assert h[0] == h[2] and h[4] == h[5] and len(np.unique(h)) == 4
