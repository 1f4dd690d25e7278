"""Operators whose steps depend on one another, against plain models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import folds, sequential, series


def test_planted_clusters(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 32))
    rows = []
    for i in range(80):
        v = centres[i % 4] + rng.normal(size=32) * 0.15
        rows.append(("f", i, 0, [float(x) for x in v / np.linalg.norm(v)], i))
    got = sequential.clustered(spark.createDataFrame(rows, "file string, t long, idx long, embedding array<float>, area long")).toPandas()
    assert got.groupby(got.t % 4).cluster.nunique().eq(1).all() and got.cluster.nunique() == 4
    chars = sequential.extracted(spark.createDataFrame(rows, "file string, t long, idx long, embedding array<float>, area long")).toPandas()
    assert sorted(chars.memberCount) == [20] * 4 and set(chars.bestT) == {76, 77, 78, 79}


def unit_mean(rows):
    m = np.mean(np.array(rows, float), axis=0)
    return m / np.linalg.norm(m)


def apart(x, y):
    return float(np.sqrt(max(0.0, 2 - 2 * float(np.dot(x, y)))))


def cluster_model(vectors, threshold):
    """Number of each vector's cluster, or None, one step after another."""
    groups = []
    for i, v in enumerate(vectors):
        d = [apart(unit_mean(vectors[g]), v) for g in groups]
        if d and min(d) < threshold:
            groups[d.index(min(d))].append(i)
        else:
            groups.append([i])
    kept = []
    for g in groups:
        centre = unit_mean(vectors[g])
        medoid = vectors[min(g, key=lambda i: (apart(vectors[i], centre), i))]
        kept.append([i for i in g if apart(vectors[i], medoid) < threshold])
    merging = True
    while merging:
        merging = False
        for a in range(len(kept)):
            for b in range(a + 1, len(kept)):
                if not merging and apart(unit_mean(vectors[kept[a]]), unit_mean(vectors[kept[b]])) < threshold:
                    kept[a], merging = kept[a] + kept.pop(b), True
                    break
            if merging:
                break
    out = [None] * len(vectors)
    for n, g in enumerate(sorted(kept, key=len, reverse=True)):
        for i in g:
            out[i] = n
    return out


def some_units(rng, n, dimension):
    x = rng.normal(size=(n, dimension)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float32)


def test_clusters_by_a_plain_model(spark):
    """Vectors without structure, so that faces leave and clusters merge; one file has most rows, over several batches; a file of one row, faces without vectors."""
    rng = np.random.default_rng(12)
    data = {"hot": some_units(rng, 260, 6), "b": some_units(rng, 60, 6), "one": some_units(rng, 1, 6)}
    rows = [(f, i // 2, i % 2, [float(x) for x in v]) for f, vs in data.items() for i, v in enumerate(vs)] + [("b", 99, 0, None), (None, 0, 0, [1.0] * 6)]
    rng.shuffle(rows := np.array([*rows, None], object)[:-1])
    df = spark.createDataFrame(rows.tolist(), "file string, t long, idx long, embedding array<float>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for threshold in (0.7, 1.0):
            got = {(r.file, r.t, r.idx): r.cluster for r in sequential.clustered(df, threshold).collect()}
            assert len(got) == len(rows) and got["b", 99, 0] is None and got[None, 0, 0] is None
            for f, vs in data.items():
                assert [got[f, i // 2, i % 2] for i in range(len(vs))] == cluster_model(vs, threshold), (f, threshold)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sequential.clustered(df.limit(0)).count() == 0


def merge_model(rows, threshold):
    """(group, representative) by characterIdx of one file's (idx, members, score, vector)."""
    groups = []
    for i, _, _, v in sorted(rows, key=lambda r: (-r[2], -r[1], r[0])):
        d = [apart(g[0][1], v) for g in groups]
        if d and min(d) < threshold:
            groups[d.index(min(d))].append((i, v))
        else:
            groups.append([(i, v)])
    groups.sort(key=lambda g: min(i for i, _ in g))
    return {i: (n, g[0][0]) for n, g in enumerate(groups) for i, _ in g}


def test_merged_faces_by_a_plain_model(spark):
    rng = np.random.default_rng(13)
    data = {f: [(i, int(rng.integers(1, 4)), float(rng.integers(5)), v) for i, v in enumerate(some_units(rng, n, 5))] for f, n in (("hot", 200), ("b", 9), ("one", 1))}
    rows = [(f, i, m, s, [float(x) for x in v]) for f, own in data.items() for i, m, s, v in own] + [("b", 50, 3, 1.0, None)]
    df = spark.createDataFrame(rows, "fileKey string, characterIdx int, memberCount int, bestFaceScore double, bestFaceEmbedding array<float>")
    got = sequential.merged_faces(df, 0.9, 2).collect()
    for f, own in data.items():
        assert {r.characterIdx: (r.groupId, r.representative) for r in got if r.fileKey == f} == merge_model([r for r in own if r[1] >= 2], 0.9)


def scene_model(points, gap, end=0):
    points = sorted(points)
    out, at = [], 0
    while at < len(points):
        inside, last, held, k = {points[at][1]}, points[at][0], [], at + 1
        while k < len(points) and points[k][0] - last <= gap:
            if points[k][1] in inside:
                inside.update(points[i][1] for i in held)
                held, last = [], points[k][0]
            else:
                held.append(k)
            k += 1
        before = [t for t, _ in points if t < points[at][0]]
        after = [t for t, _ in points if t > last]
        out.append((points[at][0], last, max(before, default=0), min(after, default=max(end, last)), tuple(sorted(inside))))
        at = held[0] if held else k
    return out


@pytest.mark.parametrize("seed", range(4))
def test_scenes(spark, seed):
    rng = random.Random(seed)
    data = {f"f{i}": [(rng.randrange(200), rng.choice("abcd")) for _ in range(rng.randrange(1, 40))] for i in range(6)}
    df = spark.createDataFrame([(f, g, t) for f, p in data.items() for t, g in p], "file string, grp string, t long")
    got = sequential.scenes(df, 9).collect()
    for f, p in data.items():
        mine = sorted((r.firstFace, r.lastFace, r.start, r.end, tuple(r.groups)) for r in got if r.file == f)
        assert mine == sorted(scene_model(p, 9))


def test_scenes_of_a_file_with_most_rows(spark):
    """One file has nearly all rows, in many sections and ranges; ties, lengths of files, nulls and files of one row."""
    rng = random.Random(9)
    t, hot = 0, []
    for _ in range(3000):
        t += rng.choice([0, 1, 2, 3, 9, 10, 11, 60])
        hot.append((t, rng.choice("abcdef")))
    data = {"hot": hot, "one": [(5, "a")], "ties": [(7, "a"), (7, "b"), (7, "a"), (16, "b"), (16, "c")]}
    rows = [(f, g, x, {"hot": 10**6, "one": 3, "ties": None}[f]) for f, p in data.items() for x, g in p] + [("none", "a", None, 9)]
    df = spark.createDataFrame(rows, "file string, grp string, t long, duration long")
    got = sequential.scenes(df, 9, "duration").collect()
    for f, p in data.items():
        mine = sorted((r.firstFace, r.lastFace, r.start, r.end, tuple(r.groups)) for r in got if r.file == f)
        assert mine == sorted(scene_model(p, 9, {"hot": 10**6, "one": 3, "ties": 0}[f]))
    assert {r.file for r in got} == set(data)


def test_packing_never_overlaps(spark):
    rng = random.Random(1)
    rows = [("f", f"g{i}", (s := rng.randrange(300)), s + rng.randrange(20), rng.randrange(1, 5)) for i in range(40) for _ in range(1)]
    got = sequential.packed(spark.createDataFrame(rows, "file string, grp string, start long, end long, points long")).toPandas().set_index("grp").row
    for a in rows:
        for b in rows:
            if a[1] < b[1] and got[a[1]] == got[b[1]]:
                assert a[3] < b[2] or b[3] < a[2]
    first = max(rows, key=lambda r: (r[4], [-ord(c) for c in r[1]]))
    assert got[first[1]] == 0


def test_packing_is_first_fit(spark):
    rng = random.Random(8)
    rows = [("f", f"g{rng.randrange(60)}", (s := rng.randrange(2000)), s + rng.choice([0, 1, 5, 30]), rng.randrange(1, 5)) for _ in range(400)]
    groups = {}
    for _, g, s, e, n in rows:
        groups.setdefault(g, [0, []])
        groups[g][0] += n
        groups[g][1].append((s, e))
    lines, want = [], {}
    for g, (_, spans) in sorted(groups.items(), key=lambda x: (-x[1][0], x[0])):
        i = next((i for i, r in enumerate(lines) if not any(a <= d and c <= b for a, b in r for c, d in spans)), len(lines))
        lines += [[]] * (i == len(lines))
        lines[i] = lines[i] + spans
        want[g] = i
    got = sequential.packed(spark.createDataFrame(rows, "file string, grp string, start long, end long, points long")).collect()
    assert {r.grp: r.row for r in got} == want and max(want.values()) > 3


def test_thinning(spark):
    times = sorted(random.Random(2).sample(range(60_000), 60))
    kept = []
    for t in times:
        if not kept or t - kept[-1] >= 3000:
            kept.append(t)
    df = spark.createDataFrame([("f", t) for t in times], "file string, t long")
    assert sorted(r.t for r in folds.thinned(df, "file").collect()) == kept


@pytest.mark.parametrize("spans", [1, 2, 7, 1000])
def test_thinning_over_blocks(spark, spans):
    """One group has most times; blocks of any width give what one fold gives."""
    draw = random.Random(spans)
    data = {"hot": [draw.randrange(-5000, 40_000) for _ in range(3000)], "thin": [draw.randrange(10**6) for _ in range(40)], "one": [7], "close": [1, 1, 2, 3]}
    df = spark.createDataFrame([(f, t) for f, ts in data.items() for t in ts] + [("none", None)], "file string, t long")
    want = set()
    for f, ts in data.items():
        last = None
        for t in sorted(ts):
            if last is None or t - last >= 50:
                want.add((f, t))
                last = t
    assert {(r.file, r.t) for r in folds.thinned(df, "file", 50, spans).collect()} == want


@pytest.mark.parametrize(("weight", "block"), [(0.3, 7), (0.9, 100), (1.0, 10), (0.05, 10_000)])
def test_averages_over_blocks(spark, weight, block):
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.7 else draw.choice("abc"), draw.randrange(50), i, draw.random() * 100) for i in range(900)] + [("one", 0, 900, 5.0)]
    got = {r.k: r.rate for r in folds.smoothed(spark.createDataFrame(rows, "k string, t long, event_id long, x double"), "k", weight, block).collect()}
    want = {}
    for k, _, _, x in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[k] = x if k not in want else (1 - weight) * want[k] + weight * x
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_saved_positions(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), i, draw.choice([None, draw.random() * 30, float(i % 60)]), draw.random() < 0.02) for i in range(2000)]
    got = sorted(((r.key, r.at) for r in folds.saved_positions(spark.createDataFrame(rows, "key string, at long, sec double, forced boolean")).collect()), key=repr)
    last, want = {}, []
    for k, at, sec, forced in rows:
        if forced or (sec is not None and abs(sec - last.get(k, 0.0)) >= 5):
            last[k] = last.get(k, 0.0) if sec is None else sec
            want.append((k, at))
    assert got == sorted(want, key=repr)


def test_suppression(spark):
    rows = [("f", 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("f", 0, 1, 1.0, 1.0, 11.0, 11.0, 0.8), ("f", 0, 2, 30.0, 30.0, 40.0, 40.0, 0.7), ("f", 1, 3, 0.0, 0.0, 10.0, 10.0, 0.1)]
    df = spark.createDataFrame(rows, "file string, frame long, idx long, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.idx for r in sequential.suppressed(df).collect()) == [0, 2, 3]


def test_merging_does_not_chain(spark):
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [("f", 0, 5, 0.5, angle(0.0)), ("f", 1, 5, 0.9, angle(1.0)), ("f", 2, 5, 0.4, angle(2.0)), ("f", 3, 1, 0.95, angle(2.0))]
    got = sequential.merged_faces(spark.createDataFrame(rows, "fileKey string, characterIdx int, memberCount int, bestFaceScore double, bestFaceEmbedding array<double>"), 1.1, 2).collect()
    assert {r.characterIdx: (r.groupId, r.representative) for r in got} == {0: (0, 1), 1: (0, 1), 2: (0, 1)}


def lone_model(paths):
    by = {}
    for p in paths:
        if "/" in p:
            by.setdefault(p.rpartition("/")[0], []).append(p)
    while True:
        depth = max([1] + [f.count("/") + 1 for f, v in by.items() if len(v) == 1])
        if depth <= 1:
            return {p: f for f, v in by.items() for p in v}
        for f in [f for f, v in by.items() if len(v) == 1 and f.count("/") + 1 == depth]:
            by.setdefault(f.rpartition("/")[0], []).extend(by.pop(f))


@pytest.mark.parametrize("seed", range(3))
def test_lone_videos_move_up(spark, seed):
    rng = random.Random(seed)
    paths = list({"/".join([rng.choice("abc") for _ in range(rng.randrange(0, 5))] + [f"v{i}.mkv"]) for i in range(30)})
    df = spark.createDataFrame([(p, p) for p in paths], "key string, relativePath string")
    got = {r.key: r.folder for r in series.with_folder(df).collect() if r.folder}
    assert got == lone_model(paths)
