"""Phrases against a plain count of everything."""

import re
from collections import Counter

import pytest

from mediaquarry.llm import phrases

LOWER = str.maketrans(phrases.UPPER, phrases.LOWER)


def plain(rows, longest, least, limit):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 50 * counts[lang, words[i : i + k]]:
                    covered.add((lang, words[i : i + k]))
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) not in covered:
            l, r, score = min(((counts[lang, words[:k]], counts[lang, words[k:]], 10**6 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]])) for k in range(1, len(words))), key=lambda x: x[2])
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -score) for lang, each in found.items() for i, (score, a, p, l, r) in enumerate(sorted(each)[:limit], 1))


ROWS = [
    (None, "New York is new york; NEW YORK city. É new york É"), ("und", "new york"), ("en", None), ("en", ""), ("en", " \t .,;"), ("en", "a a a a a"),
    ("en", "a b c\na b c\va b c\fa b c\ra b c"), ("en", "a b c"), ("en", "a b c"), ("en", "x\ty  z x y z"), ("fr", "É é É é"), ("fr", "word" * 10000), ("de", "eins"),
    ("de", "zum Beispiel " * 3000),
]


@pytest.mark.parametrize(("longest", "least", "limit"), [(3, 2, 2000), (3, 1, 3), (4, 2, 5), (2, 3, 2000)])
def test_plain_counts(spark, longest, least, limit):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(ROWS)], "doc_id long, lang string, text string, phrase string, n long")
    assert sorted(map(tuple, phrases.best_phrases(docs, longest, least, limit).collect())) == plain(ROWS, longest, least, limit)


def test_full_bit_table_changes_nothing(spark, documents, monkeypatch):
    want = sorted(map(tuple, phrases.best_phrases(documents).collect()))
    monkeypatch.setattr(phrases, "FILTER_BLOCKS", 1)
    assert sorted(map(tuple, phrases.best_phrases(documents).collect())) == want and want


def test_large_numbers_stay_exact(spark):
    levels = [
        spark.createDataFrame([("en", "a", 3_000_000_019, "a"), ("en", "b", 4_000_000_007, "b")], "lang string, phrase string, f long, w1 string"),
        spark.createDataFrame([("en", "a b", 2_999_999_999, "a", "b")], "lang string, phrase string, f long, w1 string, w2 string"),
    ]
    (row,) = phrases.lowest_cuts(levels).collect()
    assert row.score == 10**6 * 2_999_999_999**2 // (3_000_000_019 * 4_000_000_007)


def test_no_rows(spark):
    assert phrases.best_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
