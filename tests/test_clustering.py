import itertools
import math
import random

import numpy as np
import pytest

from lumenfold import errors
from lumenfold.operators import clustering as cl
from lumenfold.operators import otsu, palette
from lumenfold.operators.points import Points, median_split


def points(spark, x, parts=3):
    x = np.asarray(x, float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return Points.of(spark.createDataFrame(rows, "id long, v array<double>").repartition(parts), "v", dims=x.shape[1])


def blobs(k=3, n=60, dims=2, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(size=(n, dims)) * 0.3 + rng.random(dims) * 20 for _ in range(k)])


# ---------------------------------------------------------------- plain numpy counterparts


def np_assign(x, centers):
    d = ((x[:, None] - np.array(centers)[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


def np_farthest(x, centers, maximin=False):
    d = ((x[:, None] - np.array(centers)[None]) ** 2).sum(-1)
    score = d.min(1) if maximin else d.sum(1)
    score[d.min(1) == 0] = -1
    return tuple(x[score.argmax()])


def np_initial(x, k):
    centers = [tuple(x.mean(0))]
    while len(centers) < k:
        centers = sorted([*centers, np_farthest(x, centers)])
    return centers


def np_k_means(x, k, limit=0.95, most=1000):
    centers, error, done = np_initial(x, k), math.inf, 0
    while done < most:
        cid, d = np_assign(x, centers)
        means = sorted({tuple(x[cid == c].mean(0)) for c in set(cid.tolist())})
        while len(means) < k:
            means = sorted([*means, np_farthest(x, means)])
        if error * limit <= d.sum():
            return means, d.sum()
        centers, error, done = means, d.sum(), done + 1
    return centers, error


# ---------------------------------------------------------------- points


@pytest.mark.parametrize("seed", range(6))
def test_nearest_centers_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    dims = 1 + seed % 4
    x, centers = rng.random((150, dims)), [tuple(c) for c in rng.random((10 if seed else 700, dims))]
    p = points(spark, np.vstack([x, centers[:3], centers[:1]]))
    got = {r.id: (r.cid, r.d2) for r in p.assign([*centers, centers[0]]).select("id", "cid", "d2").collect()}
    cid, d = np_assign(np.vstack([x, centers[:3], centers[:1]]), centers)
    assert [got[i][0] for i in range(len(cid))] == cid.tolist()
    assert np.allclose([got[i][1] for i in range(len(d))], d)


def test_statistics(spark):
    x = blobs()
    p = points(spark, x)
    assert p.size() == 180 and np.allclose(p.mean(), x.mean(0)) and np.allclose(p.deviation(), x.std(0)) and np.allclose(p.sums(), x.sum(0))
    assert np.allclose(p.bounds(), [x.min(0), x.max(0)]) and p.widest_dimension() == int(np.ptp(x, axis=0).argmax())
    assert np.allclose(p.distance_sum((1.0, 2.0)), ((x - [1, 2]) ** 2).sum())
    assert np.allclose(p.deviation((0.0, 0.0)), np.sqrt((x**2).mean(0)))
    empty = Points(p.df.where("id < 0"), 2)
    for f in (empty.mean, empty.deviation):
        with pytest.raises(errors.EmptySetError):
            f()
    with pytest.raises(errors.NonFiniteError):
        points(spark, [[1.0, math.inf]]).sums()
    with pytest.raises(errors.NonFiniteError):
        points(spark, [[1.0, math.nan]]).check_finite()


def test_farthest_and_random(spark):
    x = blobs()
    p = points(spark, x)
    centers = [tuple(x[0]), tuple(x[70])]
    for maximin in (False, True):
        assert np.allclose(p.farthest(centers, maximin), np_farthest(x, centers, maximin))
    one = p.random_point(centers, 3)
    assert one == p.random_point(centers, 3) and one not in centers and any(np.allclose(one, r) for r in x)
    same = points(spark, [[1.0, 1.0]] * 5)
    for f in (lambda: same.farthest([(1.0, 1.0)]), lambda: same.random_point([(1.0, 1.0)], 0)):
        with pytest.raises(errors.EmptyClusterError):
            f()
    assert len(set(p.random_distinct(7, 1))) == 7


@pytest.mark.parametrize("divisor", [1, 2, 3, 4, 8])
def test_median_split(divisor):
    for n in range(7):
        for order in itertools.permutations(range(n)):
            values = [v // divisor for v in order]
            a, b = median_split(values)
            assert min(len(a), len(b)) == n // 2 and sorted(a + b) == sorted(values) and (not a or not b or max(a) <= min(b))


# ---------------------------------------------------------------- k-means, searches


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_k_means_equals_numpy(spark, k):
    x = blobs(seed=k)
    got = cl.k_means(k)(points(spark, x))
    centers, error = np_k_means(x, k)
    assert np.allclose(got.vectors, centers) and np.isclose(got.error, error)


def test_k_means_limits(spark):
    x = blobs()
    assert cl.k_means(3, max_iterations=0)(points(spark, x)).error == math.inf
    one = cl.k_means(3, max_iterations=1)(points(spark, x))
    want, error = np_k_means(x, 3, most=1)
    assert np.allclose(one.vectors, want) and np.isclose(one.error, error)
    for bad in (0, 181):
        with pytest.raises(errors.CannotSelectInitialCentersError):
            cl.k_means(bad)(points(spark, x))
    with pytest.raises(errors.EmptyClusterError):
        cl.k_means(2)(points(spark, [[1.0]] * 9))
    exact = cl.k_means(2)(points(spark, [[0.0]] * 4 + [[6.0]] * 4))
    assert exact.vectors == [(0.0,), (6.0,)] and exact.error == 0


def test_other_starts(spark):
    x = blobs(k=4, n=80, seed=3)
    p = points(spark, x)
    best = min(np_k_means(x, 4)[1], 1e9)
    tree = cl.k_means(4, initial=cl.kd_tree_centers(max_leaf=20))(p)
    rand = cl.k_means(4, initial=cl.random_centers(1), more=cl.random_replacement(1))(p)
    assert len(tree.vectors) == len(rand.vectors) == 4 and tree.error < 3 * best
    assert len(cl.kd_tree_centers(max_leaf=10_000)(p, 3, cl.farthest())) == 3
    with pytest.raises(errors.CannotSelectInitialCentersError):
        cl.random_centers(0)(points(spark, [[1.0]] * 9), 2, cl.farthest())


def _fixed(errors_by_k):
    def make(k):
        def strategy(points):
            e = errors_by_k[k]
            if isinstance(e, Exception):
                raise e
            return cl.Clusters(((float(k),),) * k, e)

        return strategy

    return make


def test_elbow_and_best():
    chosen = lambda by, most=5: len(cl.elbow(0.95, most, 2, _fixed(by))(None).centers)
    assert chosen({2: 100, 3: 50, 4: 48, 5: 1}) == 3
    assert chosen({2: 100, 3: 95, 4: 1}) == 2
    assert chosen({2: 100, 3: 50, 4: 20, 5: 10}) == 5
    assert chosen({2: 100, 3: 50, 4: errors.EmptyClusterError()}) == 3
    assert chosen({2: 100, 3: errors.CannotSelectInitialCentersError()}) == 2
    for by in ({2: errors.EmptyClusterError()}, {2: 100, 3: errors.EmptySetError()}):
        with pytest.raises(type(next(e for e in by.values() if isinstance(e, Exception)))):
            chosen(by)
    one, two = _fixed({1: 5, 2: 5})(1), _fixed({1: 5, 2: 5})(2)
    assert len(cl.best([one, two])(None).centers) == 1 and cl.best([two]) is two
    with pytest.raises(ValueError):
        cl.best([])
    with pytest.raises(errors.EmptyClusterError):
        cl.best([one, _fixed({1: errors.EmptyClusterError()})(1)])(None)


# ---------------------------------------------------------------- ISODATA


def test_isodata_parts():
    g = [cl._Group((0.0,), 10), cl._Group((1.0,), 30), cl._Group((1.5,), 10), cl._Group((9.0,), 5)]
    assert cl.lump_pairs(g, 3.0, 9) == [(1, 2), (0, 1), (0, 2)] and cl.lump_pairs(g, 0.25, 9) == []
    out, made = cl.lumped(g, 3.0, 3)
    assert made == 1 and sorted(x.center for x in out) == [(0.0,), (1.125,), (9.0,)]
    assert cl.lumped(g[:2], 3.0, 3)[1] == 0
    s = cl.IsodataSettings(2, 4, std_deviation=1.0)
    wide = cl._Group((5.0, 5.0), 100, 9.0, (0.5, 2.0))
    out, made = cl.split_up([wide, cl._Group((0.0, 0.0), 100, 1.0, (0.1, 0.1)), cl._Group((9.0, 0.0), 100, 1.0, (0.1, 0.1))], 4.0, s, 5)
    assert made == 1 and {x.center for x in out} >= {(5.0, 7.0), (5.0, 3.0)}
    assert cl.split_up([wide] * 3, 10.0, s, 5)[1] == 0 and cl.split_up([wide] * 2, 10.0, s, 500)[1] == 2


def test_isodata_finds_blobs(spark):
    x = blobs(k=4, n=60, seed=5)
    got = cl.isodata(cl.IsodataSettings(2, 5, max_iterations=20, lumping=1.0, std_deviation=1.0))(points(spark, x))
    assert {"iteration", "number_of_cluster", "distribute", "splitted_cluster"} <= set(got.stats) and got.stats["splitted_cluster"] >= 1
    means = [x[60 * i : 60 * i + 60].mean(0) for i in range(4)]
    assert all(min(np.linalg.norm(m - c) for c in got.vectors) < 1.5 for m in means)
    for bad in (0, 500):
        with pytest.raises(errors.CannotSelectInitialCentersError):
            cl.isodata(cl.IsodataSettings(bad, 5))(points(spark, x))
    none = cl.isodata(cl.IsodataSettings(3, 5, max_iterations=0))(points(spark, x))
    assert len(none.centers) == 3 and none.error == 0


# ---------------------------------------------------------------- Otsu


def density(valleys):
    out = []
    for i in range(101):
        v = i / 100.0
        out += [np.float32(v)] * int(100.0 * min(abs(v - m) for m in valleys))
    return [[float(v)] for v in out]


@pytest.mark.parametrize(
    ("make", "k", "valleys", "want"),
    [
        (otsu.circular, 2, (0.0, 0.5, 1.0), [(0.0, 0.5), (0.5, 1.0)]),
        (otsu.circular, 3, (0.2, 0.8), [(0.0, 0.2, 0.8, 1.0), (0.2, 0.5), (0.5, 0.8)]),
        (otsu.circular, 2, (0.2, 0.8), [(0.0, 0.2, 0.8, 1.0), (0.2, 0.8)]),
        (otsu.linear, 3, (0.2, 0.8), [(0.0, 0.2), (0.2, 0.8), (0.8, 1.0)]),
    ],
)
def test_otsu_on_densities(spark, make, k, valleys, want):
    got = make(10, k)(points(spark, density(valleys)))
    centers = sorted(tuple(sorted(v[0] for v in c)) for c in got.centers)
    assert len(centers) == len(want)
    for a, b in zip(centers, want, strict=True):
        assert np.allclose(a, b, atol=0.01)


@pytest.mark.parametrize("seed", range(8))
def test_otsu_search_equals_exhaustive(seed):
    random.seed(seed)
    b, k = 12, 2 + seed % 4
    counts = [random.choice([0, 0, 1, 5, 20]) for _ in range(b)]
    h = otsu.Histogram(tuple(map(float, range(b + 1))), tuple(counts), tuple(float(c * i) for i, c in enumerate(counts)), tuple(float(c * i * i) for i, c in enumerate(counts)))
    cost = otsu.class_costs(h)
    best = min((round(sum(cost[a][c] for a, c in zip((0, *t), (*t, b), strict=True)), otsu.ROUND), t) for t in itertools.combinations(range(1, b), k - 1))
    error, cuts = otsu.thresholds(h, k)
    assert (round(error, otsu.ROUND), tuple(cuts)) == best


def test_histogram(spark):
    x = np.random.default_rng(2).normal(size=(500, 1))
    h = otsu.histogram(points(spark, x), 16)
    at = np.clip(np.searchsorted(h.edges, x[:, 0], "right") - 1, 0, 15)
    assert list(h.counts) == np.bincount(at, minlength=16).tolist() and np.isclose(sum(h.first), x.sum()) and np.isclose(sum(h.second), (x**2).sum())
    turned = h.rotated(3)
    assert turned.counts[3] == h.counts[0] and turned.first[5] == 5 * turned.counts[5]
    same = otsu.bin_edges(1.0, 1.0, 5)
    assert all(a < b for a, b in zip(same, same[1:]))
    for f in (otsu.linear, otsu.circular):
        with pytest.raises(ValueError):
            f(4, 5)(points(spark, x))
        with pytest.raises(ValueError):
            f(4, 2)(points(spark, blobs()))


# ---------------------------------------------------------------- palettes


def test_palettes():
    c = cl.Clusters((((0.9, 0.1, 0.1),), ((0.1, 0.1, 0.9),), ((0.1, 0.9, 0.1),)), 0.0)
    got = palette.false_colors(0, 1, 2)(c, 1.0)  # vectors and colours in blue, green, red
    assert np.allclose(got, [(1, 0, 0), (0, 0, 1), (0, 1, 0)], atol=1e-9)
    assert palette.false_colors(0, 1, 2)(cl.Clusters(tuple((tuple(255 * x for x in v[0]),) for v in c.centers), 0.0), 255.0) == got
    grays = palette.false_grays(3)(cl.Clusters((((0.8,),), ((0.1,),), ((0.5,),)), 0.0), 1.0)
    assert grays == [(1.0,) * 3, (0.0,) * 3, (0.5,) * 3]
    with pytest.raises(ValueError):
        palette.false_grays(1)(cl.Clusters((((0.8,),),), 0.0), 1.0)
