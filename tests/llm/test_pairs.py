"""Similarity joins, components and neighbours against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mediaquarry.llm import cap_filters, chosen_path, hilbert
from mediaquarry.llm.components import stars


def lowest(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(5, 5), (5, 6), (6, 5)]
    got = {r.node: r.component for r in stars(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    want = {i: c for i, c in enumerate(lowest(471, edges)) if i != c}
    assert got == want
    assert stars(spark.createDataFrame([], "u long, v long")).count() == 0


def vector_rows(rows, threshold=0.93):
    """(vec_id, n_links, component_id) by comparing all pairs."""
    fine = [i for i, (v, x, label) in enumerate(rows) if v is not None and label is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    links, edges = Counter(), []
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in fine}
    groups = defaultdict(list)
    for i in fine:
        groups[rows[i][2], len(rows[i][1])].append(i)
    for mine in groups.values():
        m = np.stack([unit[i] for i in mine])
        for a, b in np.argwhere(np.triu(m @ m.T >= threshold, 1)):
            edges.append((mine[a], mine[b]))
            links.update((mine[a], mine[b]))
    least, comp = {}, lowest(len(rows), edges)
    for i in fine:
        least[comp[i]] = min(least.get(comp[i], rows[i][0]), rows[i][0])
    return sorted(((v, links[i], least.get(comp[i], v)) for i, (v, _, _) in enumerate(rows)), key=repr)


def near(df):
    out = cap_filters.near_vectors(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) or r.vec_id is None for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=repr)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_near_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    assert near(df) == vector_rows([(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()])


def pairs_at(cosine, n, dimension, seed=4):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, dimension)), rng.normal(size=(n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


def test_recall_just_above_the_threshold(spark):
    x, y = pairs_at(0.931, 1500, 64)
    df = spark.createDataFrame([(i, z.tolist(), 1) for i, z in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>, label int")
    assert sum(n for _, n, _ in near(df)) >= 0.998 * 2 * len(x)


@pytest.mark.parametrize("dimension,classes", [(64, 500), (64, 50_000), (64, 10_000_000), (16, 50_000), (16, 10_000_000), (3, 1000), (128, 10**9)])
def test_recall_holds_at_all_sizes(dimension, classes):
    shape, codes = cap_filters.fitted(dimension, classes)
    (a, at), (b, bt) = (cap_filters.filters_of(v, shape, codes) for v in pairs_at(0.93, 2000, dimension, 7))
    met = sum(bool(np.intersect1d(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]).size) for i in range(2000))
    assert met >= 0.995 * 2000, (met, codes)
    assert codes <= 30 and len(a) < 2 * codes * cap_filters.LIST * 2000


def test_all_filters_above_the_height_are_listed():
    shape = cap_filters.shape_for(24, 600)
    x = pairs_at(0.9, 40, 24)[0]
    scores = cap_filters.scores_of(x, shape, 1)
    total = scores[0][:, :, None] + scores[1][:, None, :]
    want = {(int(r), int((1 * shape.directions + i) * shape.directions + k)) for r, i, k in np.argwhere(total >= cap_filters.height(shape))}
    row, ids = cap_filters.exceeded(x, shape, 1)
    assert set(zip(row.tolist(), ids.tolist())) == want and len(want) > 100


ODD_VECTORS = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 2.0], None),
    (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, 2.0], 1), (None, [1.0, 2.0], 1), (14, [1e-200, 2e-200], 1), (15, [1e300, 2e300], 1),
]


def test_rounded_vectors_lose_no_link():
    rng = np.random.default_rng(8)
    for dimension in (1, 3, 64, 300):
        base = rng.normal(size=dimension)
        x = base + rng.normal(size=(200, dimension)) * np.abs(base).max() * rng.choice([0.01, 0.2, 3.0], size=(200, 1))
        x[:20, 0] *= 1000  # one number dwarfs the others
        units = x / np.linalg.norm(x, axis=1, keepdims=True)
        columns = dict(zip(("short", "scale", "slack"), cap_filters.rounded(units)))
        fixed = {"label": ["a"] * 200, "dim": [dimension] * 200, "filter": [0] * 200, "c1": [0] * 200, "c2": [1] * 200, "chunk": [i % 2 for i in range(200)], "rep": list(range(200))}
        got = {r for b in cap_filters.possible(pa.table({**fixed, **columns}), np.array([0, 200]), 0.93) for r in b.column("rep").to_pylist()}
        linked = (units @ units.T >= 0.93) & (np.arange(200)[:, None] % 2 != np.arange(200) % 2)
        assert set(np.flatnonzero(linked.any(axis=1)).tolist()) <= got
        may = (units @ units.T >= 0.93 - 0.06) & (np.arange(200)[:, None] % 2 != np.arange(200) % 2)
        assert got <= set(np.flatnonzero(may.any(axis=1)).tolist())


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame([(*r, "x", 0) for r in ODD_VECTORS], "vec_id long, embedding array<double>, label int, rep string, n int")


def test_near_vectors_of_odd_rows(odd_vectors):
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_vectors(odd_vectors).collect() if r.vec_id is not None}
    assert all(got[i] == (0, i) for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13))
    assert all(got[i] == (5, 8) for i in (8, 9, 10, 14, 15))


def test_large_groups_are_cut_and_counted_once(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "GROUP", 16)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=32)
    rows = [(i, (centre + 0.1 * rng.normal(size=32)).tolist(), 1) for i in range(300)] + [(1000 + i, centre.tolist(), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert near(df) == vector_rows(rows)


def test_an_id_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.0, 0.99, 0.01], 1), (3, [1.0, 0.01, 0.0], 1), (3, [0.0, 0.0, 1.0], 1)]
    assert near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == vector_rows(rows)


def test_no_vectors(odd_vectors):
    none = odd_vectors.where("false")
    assert near(none) == [] and hilbert.nearest(none, F.lit(True)).count() == 0


def neighbours(rows, asks, top=20):
    """(query_id, rank, vec_id, score) by comparing all rows, each with all but itself."""
    fine = [(v, np.array(x, float)) for v, x in rows if v is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    out = []
    for i, (q, x) in enumerate(fine):
        if asks(q):
            with np.errstate(over="ignore", invalid="ignore"):
                scores = [(sum(a * b for a, b in zip(x, y)), v) for k, (v, y) in enumerate(fine) if len(y) == len(x) and k != i]
            found = sorted((np.inf if np.isnan(s) else -s, v) for s, v in scores)
            out += [(q, rank, v, -s) for rank, (s, v) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def found_neighbours(df, is_query):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in hilbert.nearest(df, is_query).collect()), key=repr)


def check_recall(x, got, asked, least):
    """x: id -> vector. Ranks, order and scores are exact for what is found; of the true 20 nearest at least a share is."""
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    hits = 0
    for q in asked:
        scores = m @ x[q]
        order = [i for i in np.lexsort((ids, -scores))[:21] if ids[i] != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        assert all(abs(s - float(x[q] @ x[v])) < 1e-9 for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(ids[order].tolist()))
    assert hits >= least * 20 * len(asked), hits / (20 * len(asked))


def by_query(df, every):
    got = defaultdict(list)
    for r in hilbert.nearest(df, F.col("vec_id") % every == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return got


@pytest.fixture
def windows(monkeypatch):
    """The windows that were chosen."""
    seen, choose = [], hilbert.chosen_windows
    monkeypatch.setattr(hilbert, "chosen_windows", lambda *x, **y: seen.append(choose(*x, **y)) or seen[-1])
    return seen


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_of_neighbours(spark, sf):
    df = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in df.select("vec_id", "embedding").collect()}
    got = by_query(df, 20)
    assert set(got) == {i for i in x if i % 20 == 0}
    check_recall(x, got, sorted(got), 0.9)


def test_recall_without_structure(spark, windows):
    x = np.random.default_rng(12).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    check_recall(dict(enumerate(x)), by_query(df, 10), range(0, 6000, 10), 0.9)


def test_small_windows_do_where_vectors_have_structure(spark, windows, tmp_path):
    rng = np.random.default_rng(5)
    n = 50_000
    centres = rng.normal(size=(500, 64))
    x = centres[rng.integers(0, 500, n)] + 0.25 * rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "x.parquet", row_group_size=5000)
    got = by_query(spark.read.parquet(str(tmp_path / "x.parquet")), 100)
    x = x.astype(float)
    check_recall(dict(enumerate(x)), got, range(0, n, 100), 0.9)
    assert windows[-1].rows < 0.05 * n, windows


def test_neighbours_of_odd_rows(odd_vectors):
    rows = [r[:2] for r in ODD_VECTORS]
    assert found_neighbours(odd_vectors, F.col("vec_id") % 2 == 0) == neighbours(rows, lambda q: q % 2 == 0)


def test_rows_with_the_same_id_are_candidates(spark):
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [1e200, 1e200]), (40, [1e200, 1e150]), (60, [1e200, -1e200])]
    got = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert got == neighbours(rows, lambda q: q % 20 == 0)
    assert sum(q == v == 20 for q, _, v, _ in got) == 6


def test_equal_vectors_go_by_their_ids(spark):
    rows = [(i, [1.0, 0.5]) for i in range(60)] + [(100, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found_neighbours(df, F.col("vec_id") % 20 == 0) == neighbours(rows, lambda q: q % 20 == 0)


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def text_rows(rows):
    """(doc_id, n_links, class_id) by comparing all pairs; rows with a doc_id only."""
    sets, holders = [shingle_set(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for mine in holders.values() for k, a in enumerate(mine) for b in mine[k + 1 :])
    edges = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    links, comp, least = Counter(x for e in edges for x in e), lowest(len(rows), edges), {}
    for i, (d, _) in enumerate(rows):
        least[comp[i]] = min(least.get(comp[i], d), d)
    return sorted((d, links[i], least[comp[i]]) for i, (d, _) in enumerate(rows))


def similar(df):
    return sorted((r.doc_id, r.n_links, r.class_id) for r in chosen_path.similar_texts(df).collect() if r.doc_id is not None)


def test_similar_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert similar(documents) == text_rows(rows)


def test_chains_and_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "GROUP", 16)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows, text = [], rng.choices(words, k=120)
    for i in range(150):  # each text a little further from the first
        text = list(text)
        text[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(rng.choices(words, k=80))) for i in range(100)] + [(400 + i, rows[3][1]) for i in range(30)]
    assert similar(spark.createDataFrame(rows, "doc_id long, text string")) == text_rows(rows)


def test_similar_texts_of_odd_rows(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect() if r.doc_id is not None]
    assert similar(odd_documents) == text_rows(rows)
    assert chosen_path.similar_texts(odd_documents).count() == odd_documents.count()
    kept = sorted(((r.doc_id, r.text) for r in chosen_path.one_of_each(odd_documents).collect()), key=repr)
    want = {(d, t) for d, t in [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()] if d not in (6,) and not (d is None and t)}
    assert kept == sorted(want, key=repr)
    assert chosen_path.similar_texts(no_documents).count() == 0 and chosen_path.one_of_each(no_documents).count() == 0


def test_an_id_with_different_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (5, base + " more"), (5, "quite another text of seven words"), (3, "a third text that is like no other here"), (9, base + " x"), (9, "nine alone here with words of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert similar(df) == text_rows(rows)
    kept = sorted((r.doc_id, r.text) for r in chosen_path.one_of_each(df).collect())
    assert len(kept) == 4 and sum(t.startswith("w0") for _, t in kept) == 1 and (9, rows[5][1]) in kept and (5, rows[2][1]) in kept


def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch):
    from mediaquarry.llm import components

    monkeypatch.setattr(components, "HUB", 10)
    edges = [(0, i) for i in range(1, 60)] + [(i, 100 + i) for i in range(1, 60)] + [(200, i) for i in range(201, 290)] + [(289, 300)]
    got = {r.node: r.component for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: c for i, c in enumerate(lowest(301, edges)) if i != c}


@pytest.mark.parametrize("words", [5, 6, 9, 14, 30])
def test_recall_of_short_texts(spark, words):
    rng = random.Random(words)
    rows = []
    for i in range(300):  # pairs whose similarity is just over the threshold, or as near as texts so short can be
        a = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        extra = max(0, (words - 4) // 5)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join([*a, *(f"x{rng.randrange(10**6)}" for _ in range(extra))]))]
    assert similar(spark.createDataFrame(rows, "doc_id long, text string")) == text_rows(rows)


def test_one_of_each(documents):
    want = {d for d, _, c in text_rows([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]) if d == c}
    assert sorted(r.doc_id for r in chosen_path.one_of_each(documents).collect()) == sorted(want)
