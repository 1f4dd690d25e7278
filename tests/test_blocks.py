"""Theta joins whose right side is larger than one broadcast."""

import numpy as np
import pytest

from mediaquarry.operators import faces


@pytest.mark.parametrize("n,most", [(40, 7), (42, 7), (7, 7)])
def test_blacklists_by_blocks(spark, n, most):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(30 + n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[-1] = x[31]  # a tie in another block
    rows = spark.createDataFrame([(f"a{i:02}", v.tolist()) for i, v in enumerate(x[:30])], "key string, embedding array<double>")
    black = spark.createDataFrame([(f"b{i:02}", v.tolist()) for i, v in enumerate(x[30:])], "key string, embedding array<double>").repartition(5)
    d = np.sqrt(np.maximum(0, 2 - 2 * x[:30] @ x[30:].T)).round(12)
    want = {f"a{i:02}": (f"b{k:02}", d[i, k]) for i, k in enumerate(d.argmin(axis=1)) if d[i, k] < 0.9}
    got = {r.key: (r.other, r.distance) for r in faces.theta_nearest(rows, black, 0.9, most=most).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
    assert 0 < len(want) < 30
