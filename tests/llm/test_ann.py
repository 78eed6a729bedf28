import math

import numpy as np
from pyspark.sql import functions as F

from lumenfold.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def nearest(df):
    return ann.nearest(df, F.col("vec_id") % 10 == 0)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q, v in zip(ids.tolist(), x, strict=True):
        if q % 10 == 0:
            d = np.sqrt(((x - v) ** 2).sum(1))
            out[q] = [(i, s) for s, i in sorted((s, i) for s, i in zip(d.tolist(), ids.tolist(), strict=True) if i != q)][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_order_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    got, want = found(nearest(table(spark, rows))), exact(rows)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near, key=lambda p: (p[1], p[0]))
        for i, s in near:
            assert abs(s - math.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(500)] + [(1000 + i, [0.0, 1.0]) for i in range(5)]
    got = found(nearest(table(spark, rows)))
    assert [i for i, _ in got[0]] == list(range(1, 11))
    assert [i for i, _ in got[10]] == list(range(10))
    assert all(s == 0 for _, s in got[20])


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 2.0]), (3, [2.0, 2.0])]
    odd = [(10, None), (20, []), (30, [0.0, 0.0]), (40, [float("nan"), 1.0]), (50, [float("inf"), 1.0]), (60, [None, 1.0]), (70, [1.0, 2.0, 3.0]), (1, [2.0, 2.0]), (None, [1.0, 1.0])]
    assert found(nearest(table(spark, rows + odd))) == {0: [(1, 1.0), (3, 1.0)]}
    assert nearest(table(spark, odd[:6])).count() == 0
    assert nearest(table(spark, []).limit(0)).count() == 0
    assert nearest(table(spark, [(0, [1.0])])).count() == 0


def test_every_row_is_in_a_list_and_lists_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 8))
    parts = ann._balanced(x, 64, rng)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000))
    assert max(map(len, parts)) <= 64 and min(map(len, parts)) >= 31
    centroids = np.array([x[p].mean(0) for p in parts])
    index = ann.Index(centroids, ann._graph(centroids, 12), 1.2, 8)
    for v in x[:50]:
        own = ann.lists_of(index, v, ann.Ann())
        assert 1 <= len(own) <= 4 and own[0] == int(np.linalg.norm(centroids - v, axis=1).argmin())


def test_equal_vectors_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    got, want = found(nearest(table(spark, rows))), exact(rows)
    for q in range(0, 400, 10):
        assert got[q] == want[q]
    # the smallest vector of an id counts, however the rows lie
    twice = table(spark, [*rows, (0, [0.9, 0.0, 0.5]), (1005, [-9.0, 0.0, 0.0])])
    assert found(nearest(twice)) == found(nearest(twice.repartition(5)))


def test_large_lists_are_dealt_over_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1500)]
    whole = found(ann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0))
    dealt = found(ann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, ann.Ann(block_rows=40)))
    assert whole == dealt
    blocks = ann.Blocks.of(3000, 11, 40)
    assert blocks.splits == 7 and blocks.count == 77 and ann.Blocks.of(3000, 100, 40).splits == 1


def test_the_graph_gives_each_centroid_once():
    c = np.random.default_rng(3).normal(size=(16, 8))
    index = ann.Index(c, ann._graph(c, 24), 1.3, 8)
    for q in np.random.default_rng(4).normal(size=(20, 8)):
        near = ann.probes_of(index, q)
        assert len(near) == len(set(near)) and near[0] == int(np.linalg.norm(c - q, axis=1).argmin())
