"""Walks against a plain one; results whose vectors are torn."""

import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import ingest, walk
from mediaquarry.sources import codecs


def plain(paths, empty, budget, bonus, depth, most):
    """A walk by a queue: files, files and videos of each folder, and whether something was left out."""
    below, held = {}, {}
    for folder in [p.rpartition("/")[0] for p in paths] + empty:
        parts = folder.split("/") if folder else []
        for i in range(len(parts)):
            below.setdefault("/".join(parts[:i]), set()).add("/".join(parts[: i + 1]))
    for p in paths:
        held.setdefault(p.rpartition("/")[0], []).append(p)
    queue, pushed, left, over, truncated = [""], 1, {}, set(), False
    seen, stats = [], {}
    while queue:
        folder = queue.pop(0)
        top, level = folder.split("/")[0], folder.count("/") + 1 if folder else 0
        if top in over:
            continue
        counts = [0, 0]
        for p in sorted(held.get(folder, []), key=lambda p: p.rpartition("/")[2]):
            if top and left.setdefault(top, budget) <= 0:
                break
            video = p.lower().endswith(".mkv")
            left[top] = left.get(top, budget) - 1 + bonus * video
            seen.append(p)
            counts = [counts[0] + 1, counts[1] + video]
        stats[folder] = tuple(counts)
        if top and left.get(top, budget) <= 0:
            over.add(top)
            truncated = True
        children = sorted(below.get(folder, ()), key=lambda f: f.split("/"))
        if level + 1 > depth:
            truncated = truncated or bool(children)
        elif top not in over or not top:
            for c in children:
                if pushed >= most:
                    truncated = True
                    break
                queue.append(c)
                pushed += 1
    return sorted(seen), stats, truncated


@pytest.mark.parametrize("block", [3, 7, 100_000])
def test_walks_in_blocks(spark, block):
    rng = random.Random(block)
    deep = lambda least, most: "/".join(rng.choice("abc") for _ in range(rng.randint(least, most)))
    paths = sorted({"/".join([x for x in (deep(0, 5),) if x] + [f"f{rng.randrange(60)}.{rng.choice(['mkv', 'txt', 'srt', 'nfo'])}"]) for _ in range(250)})
    empty = [deep(1, 6) for _ in range(15)] + ["only/empty/ones"]
    files, more = spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in empty], "folder string")
    for budget, bonus, depth, most in ((5, 2, 20, 1000), (3, 4, 3, 1000), (1000, 1, 20, 9), (1, 0, 2, 1000), (1000, 0, 20, 1)):
        got = walk.walk(files, None, more, budget, bonus, depth, most, block)
        seen, stats, truncated = plain(paths, empty, budget, bonus, depth, most)
        case = (budget, bonus, depth, most)
        assert sorted(r.path for r in got.files.collect()) == seen and {r.folder: (r.files, r.videos) for r in got.folders.collect()} == stats, case
        assert tuple(got.summary.first()) == (len(stats), len(seen), sum(v for _, v in stats.values()), truncated), case


def test_walk_of_nothing(spark):
    got = walk.walk(spark.createDataFrame([], "path string"))
    assert got.files.count() == 0 and [tuple(r) for r in got.folders.collect()] == [("", 0, 0)] and tuple(got.summary.first()) == (1, 0, 0, False)
    ignored = spark.createDataFrame([("a",)], "key string")
    files = spark.createDataFrame([("a/b/x.mkv",), ("ab/y.mkv",), ("z.txt",)], "path string")
    assert sorted(r.path for r in walk.walked(files, ignored).collect()) == ["ab/y.mkv", "z.txt"]


def test_listing_reads_names_and_sizes(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.mkv").write_bytes(b"123")
    (tmp_path / "a" / "b" / "y.txt").write_bytes(b"1")
    got = sorted(map(tuple, walk.listing(spark, str(tmp_path)).collect()))
    assert got == [("a/b/y.txt", 1), ("a/x.mkv", 3)]


def test_torn_vectors_are_rejected_and_strips_say_so(spark):
    person = '{"characterIdx":0,"memberCount":%d,"bestFaceTimeMs":1,"bestFaceEmbedding_b64":"%s","embeddings_b64":"%s","frameTimes_b64":"AAAAAA=="}'
    one = "AAAAAAAAAAA="  # two numbers
    lines = ['{"fileKey":"%s","characters":[%s]}' % x for x in (("torn", person % (1, "AAAA", one)), ("good", person % (1, one, one)), ("few", person % (2, one, one)), ("odd", person % (1, "!!", one)))]
    found = ingest.results(spark.createDataFrame([(x,) for x in [*lines, "broken", "{}", '{"fileKey":"bare"}']], "value string"))
    none = spark.createDataFrame([], "key string, thumbSource string, keyframesVersion int")
    got = ingest.ingested(found, none, none, 2, 0)
    assert {r.fileKey: r.reason for r in got.rejected.collect()} == {"torn": "characters of the wrong length", "odd": "characters of the wrong length", "few": "frames of the wrong length"}
    assert [r.key for r in got.characters.collect()] == ["good#00"] == [r.key for r in got.frames.collect()] and {r.key for r in got.files.collect()} == {"good", "bare"}
    strip = spark.range(1).select(codecs.strip_bytes(F.lit(2.0), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(b"abc"), F.lit(b"de"))).alias("s"))
    r = strip.select(codecs.strip_parts("s").alias("p"), codecs.strip_parts(F.expr("substring(s, 1, octet_length(s) - 1)")).alias("q"), codecs.strip_parts(F.lit(b"short")).alias("z"), "s").first()
    assert r.p.complete and not r.q.complete and r.z["count"] is None and list(r.p.times) == [0.0, 2.0]
    assert bytes(r.s[r.p.offsets[1] : r.p.offsets[2]]) == b"de"
