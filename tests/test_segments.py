"""Segments of lists that hold more tiles than a page."""

from pyspark.sql import functions as F

from mediaquarry.plans import library


def test_segments_of_many_files(spark, monkeypatch):
    n = 600_000
    key = F.concat(F.lit("d/"), "id")
    files = spark.range(n).select(key.alias("key"), key.alias("relativePath"), key.alias("name"), F.col("id").alias("n"), *(F.lit(0).cast(t).alias(c) for c, t in (("fileModifiedAt", "long"), ("durationSec", "double"), ("positionUpdatedAt", "long"))))
    monkeypatch.setattr(library.adapters, "files", lambda spark, sf_dir: files)
    first = len(range(0, n, 13))
    second = len(range(0, n, 7)) - len(range(0, n, 91))
    assert first + second > 100_000
    got = sorted(tuple(r) for r in library.list_segments(spark, "").select("grp", "start", "end").collect())
    assert got == [(0, 0, first), (1, first, first + second)]


def test_long_spans_have_few_copies(spark):
    """A span of a year beside many of a second: both joins give what plain loops give, and the plans make few rows."""
    import random

    from mediaquarry.operators import intervals

    draw, year = random.Random(2), 365 * 86_400_000
    spans = [("a", i, s, s + draw.choice([0, 1, 999, 1000, 5000, 90_000])) for i, s in enumerate(draw.randrange(year) for _ in range(400))] + [("a", 400, 0, year), ("b", 401, -5, year), ("a", 402, 7, 3)]
    points = [("a", i, draw.choice(spans)[2] + draw.choice([-2, -1, 0, 1, 998])) for i in range(300)] + [("c", 300, 5)]
    p, s = spark.createDataFrame(points, "k string, n int, t long"), spark.createDataFrame(spans, "k string, m int, start long, end long")
    for early, closed in ((0, True), (2, False)):
        got = sorted((r.n, r.m) for r in intervals.containing(p, s, "k", 1000, early, closed).collect())
        assert got == sorted((n, m) for k, n, t in points for j, m, a, b in spans if k == j and a - early <= t and (t <= b if closed else t < b))
    other = s.where("m % 3 = 0")
    got = sorted((r.m1, r.m2) for r in intervals.overlapping(s, other, "k", 1000).collect())
    assert got == sorted((m, n) for k, m, a, b in spans for j, n, c, d in spans if k == j and n % 3 == 0 and a <= d and c <= b and a <= b and c <= d)
