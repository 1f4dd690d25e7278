"""Lone videos move up: the plan stays small at any depth, and the folders are those of a plain model."""

import random
from collections import Counter

from pyspark.sql import functions as F

from mediaquarry.operators import series


def model(paths):
    folder = {p: p.rsplit("/", 1)[0] if "/" in p else None for p in paths}
    for depth in range(max((f.count("/") + 1 for f in folder.values() if f), default=0), 1, -1):
        n = Counter(folder.values())
        moving = [p for p, f in folder.items() if f and f.count("/") + 1 == depth and n[f] == 1]
        for p in moving:
            folder[p] = folder[p].rsplit("/", 1)[0]
    return folder


def test_folders_of_a_deep_tree(spark):
    rng = random.Random(5)
    paths = sorted({"/".join([rng.choice("ab") for _ in range(rng.randint(0, 20))] + [f"v{i}.mkv"]) for i in range(120)})
    df = spark.createDataFrame([(p,) for p in paths], "relativePath string").withColumn("key", F.col("relativePath"))
    out = series.with_folder(df)
    assert {r.key: r.folder for r in out.collect()} == model(paths)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 3
