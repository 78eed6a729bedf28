"""The search among many centers."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators.points import nearest_of_array


def test_many_centers_are_searched_in_batches(spark):
    """Ties go to the smallest id; a missing coordinate has no distance, NaN is farther than all else."""
    rng = np.random.default_rng(4)
    centers = [tuple(c) for c in rng.integers(0, 9, (200, 4)) / 8]
    rows = [[float(x) for x in r] for r in rng.integers(0, 17, (3000, 4)) / 16]
    want = [min((sum(((a - b) * (a - b) for a, b in zip(c, r, strict=True)), 0.0), i) for i, c in enumerate(centers)) for r in rows]
    odd = [[None, 0.0, 0.0, 0.0], None, [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [0.0]]
    df = spark.createDataFrame(list(enumerate(rows + odd)), "k int, v array<double>").repartition(3)
    near = nearest_of_array(df, F.col("v"), centers)
    assert "array_min" not in near._jdf.queryExecution().executedPlan().toString()  # that runs uncompiled, row by row
    got = {r.k: (r.d2, r.cid) for r in near.collect()}
    assert [got[k] for k in range(len(rows))] == want
    assert [got[len(rows) + k] for k in (0, 1, 3, 4)] == [(None, 0), (None, 0), (float("inf"), 0), (None, 0)]
    assert np.isnan(got[len(rows) + 2][0]) and got[len(rows) + 2][1] == 0
    assert near.select("k").count() == len(got) and near.where(F.col("cid") == want[0][1]).count() == [g[1] for g in got.values()].count(want[0][1])
