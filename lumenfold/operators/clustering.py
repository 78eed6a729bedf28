"""Clusterings: k-means, ISODATA, initial centers, replacement of empty clusters, elbow and best.

Every pass over the points is one job that returns a few rows for each center; decisions are made
on the driver from those rows. Centers are kept in lexicographic order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

from ..errors import CannotSelectInitialCentersError, EmptyClusterError
from .points import Points, Vector


@dataclass(frozen=True)
class Clusters:
    """Centers of each cluster (a cluster may own several), the error, and figures of the run."""

    centers: tuple[tuple[Vector, ...], ...]
    error: float
    stats: dict[str, float] = field(default_factory=dict, compare=False)

    @property
    def vectors(self) -> list[Vector]:
        return [v for c in self.centers for v in c]

    @property
    def owners(self) -> list[int]:
        """The cluster of each of ``vectors``."""
        return [i for i, c in enumerate(self.centers) for _ in c]


Strategy = Callable[[Points], Clusters]
Replacement = Callable[[Points, Sequence[Vector]], Vector]
InitialCenters = Callable[[Points, int, Replacement], list[Vector]]


# ---------------------------------------------------------------- one more center, first centers


def farthest(maximin: bool = False) -> Replacement:
    return lambda points, centers: points.farthest(centers, maximin)


def random_replacement(seed: int = 0) -> Replacement:
    return lambda points, centers: points.random_point(centers, seed + len(centers))


def filled_up(points: Points, centers: Sequence[Vector], k: int, more: Replacement) -> list[Vector]:
    """Centers until there are k different ones; an error if a known one is proposed."""
    found = sorted(set(centers))
    while len(found) < k:
        new = more(points, found)
        if new in found:
            raise CannotSelectInitialCentersError("a center was proposed twice")
        found = sorted([*found, new])
    return found


def mean_and_farthest(maximin: bool = False) -> InitialCenters:
    """The mean of all points, then the farthest ones.

    More centers only add to fewer, so what is found once for some points is kept with them: a
    search over the number of clusters looks for each center once.
    """
    def select(points: Points, k: int, _: Replacement) -> list[Vector]:
        found = points.known.setdefault(("mean and farthest", maximin), [])
        while len(found) < k:
            new = points.farthest(found, maximin) if found else points.mean()
            if new in found:
                raise CannotSelectInitialCentersError("a center was proposed twice")
            found.append(new)
        return sorted(found[:k])

    return select


def random_centers(seed: int = 0) -> InitialCenters:
    def select(points: Points, k: int, _: Replacement) -> list[Vector]:
        found = points.random_distinct(k, seed)
        if len(found) < k:
            raise CannotSelectInitialCentersError(f"{len(found)} different points for {k} centers")
        return sorted(found)

    return select


def kd_tree_centers(max_leaf: int = 4096, last_dimension_only: bool = False, accuracy: int = 100_000) -> InitialCenters:
    """Means of the nodes got by splitting, again and again, the node of largest variance at the
    median of its widest dimension; nodes of at most ``max_leaf`` points are not split.

    ``last_dimension_only`` takes the variance of the last dimension instead of the sum over all.
    Missing centers are the farthest points.
    """
    def select(points: Points, k: int, _: Replacement) -> list[Vector]:
        x = points.coordinates

        def node(rows):
            r = rows.agg(F.count("*"), *[f(c) for f in (F.min, F.max, F.avg, F.var_pop) for c in x]).first()
            d = points.dims
            low, high, mean, var = (r[1 + i * d : 1 + (i + 1) * d] for i in range(4))
            return {"rows": rows, "n": r[0], "low": low, "high": high, "mean": tuple(mean), "var": (var[-1] if last_dimension_only else sum(var)) if r[0] else -1.0}

        nodes = [node(points.df)]
        while len(nodes) < k:
            top = max(nodes, key=lambda m: m["var"])
            if top["n"] <= max_leaf or top["var"] <= 0:
                break
            spans = [b - a for a, b in zip(top["low"], top["high"], strict=True)]
            at = spans.index(max(spans))
            cut = top["rows"].agg(F.percentile_approx(x[at], 0.5, accuracy)).first()[0]
            # a cut at the top value would leave the upper half empty
            below = (x[at] <= cut) if cut < top["high"][at] else (x[at] < cut)
            nodes.remove(top)
            nodes += [node(top["rows"].where(below)), node(top["rows"].where(~below))]
        return filled_up(points, [m["mean"] for m in nodes if m["n"]], k, farthest())

    return select


# ---------------------------------------------------------------- k-means


def k_means(k: int, error_limit: float = 0.95, initial: InitialCenters = mean_and_farthest(), max_iterations: int = 1000, more: Replacement = farthest()) -> Strategy:
    """Lloyd's iterations until the error falls by less than ``error_limit`` asks.

    The result holds the newest centers and the error measured against the ones before.
    """
    def cluster(points: Points) -> Clusters:
        n = points.size()
        if k <= 0 or n < k:
            raise CannotSelectInitialCentersError(f"{n} points for {k} clusters")
        centers, error, done = initial(points, k, more), math.inf, 0
        while done < max_iterations:
            sums = points.cluster_sums(centers)
            now = sum(s[2] for s in sums.values())
            means = sorted({tuple(v / s[0] for v in s[1]) for s in sums.values()})
            while len(means) < k:
                means = sorted({*means, more(points, means)})
            if error * error_limit <= now:
                return Clusters(tuple((c,) for c in means), now, {"iterations": done + 1})
            centers, error, done = means, now, done + 1
        return Clusters(tuple((c,) for c in centers), error, {"iterations": done})

    return cluster


# ---------------------------------------------------------------- ISODATA


@dataclass(frozen=True)
class IsodataSettings:
    """``start`` clusters at first, ``desired`` in the end; ``smallest`` as a share of all points."""

    start: int
    desired: int
    error_limit: float = 0.95
    max_iterations: int = 1000
    smallest: float = 0.05
    lumping: float = 3.0
    lump_pairs: int = 3
    std_deviation: float = 0.0


@dataclass
class _Group:
    center: Vector
    size: int = 0
    distance: float = 0.0
    sigma: Vector = ()


def lump_pairs(groups: Sequence[_Group], limit: float, most: int) -> list[tuple[int, int]]:
    """The nearest pairs of centers below the squared distance ``limit``, nearest first."""
    pairs = [(sum((a - b) ** 2 for a, b in zip(groups[i].center, groups[j].center, strict=True)), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    return [(i, j) for d, i, j in sorted(pairs) if d < limit][:most]


def lumped(groups: list[_Group], limit: float, most: int) -> tuple[list[_Group], int]:
    """Groups after merging near pairs, each group once, while more than two are left."""
    gone: set[int] = set()
    made: list[_Group] = []
    for i, j in lump_pairs(groups, limit, most):
        if i in gone or j in gone or len(groups) - len(made) <= 2:
            continue
        a, b = max(1, groups[i].size), max(1, groups[j].size)
        made.append(_Group(tuple((x * a + y * b) / (a + b) for x, y in zip(groups[i].center, groups[j].center, strict=True)), a + b))
        gone |= {i, j}
    return [g for i, g in enumerate(groups) if i not in gone] + made, len(made)


def split_up(groups: list[_Group], overall: float, s: IsodataSettings, theta: int) -> tuple[list[_Group], int]:
    """Groups after splitting those that are too wide along their widest dimension."""
    out: list[_Group] = []
    for g in groups:
        sigma = max(g.sigma, default=0.0)
        wide = sigma > s.std_deviation
        if wide and ((g.distance > overall and g.size > 2 * (theta + 1)) or len(groups) <= s.desired // 2):
            at = g.sigma.index(sigma)
            out += [replace(g, center=tuple(x + side * sigma * (i == at) for i, x in enumerate(g.center))) for side in (1, -1)]
        else:
            out.append(g)
    return out, len(out) - len(groups)


def isodata(settings: IsodataSettings, initial: InitialCenters = mean_and_farthest(), more: Replacement = farthest()) -> Strategy:
    """ISODATA: k-means that drops, splits and lumps clusters as it goes. One job for each iteration.

    A pass gives count, sums and sums of squares of each cluster; means, mean squared distances and
    deviations follow from them. A cluster that is kept without points keeps its center.
    """
    s = settings

    def cluster(points: Points) -> Clusters:
        n = points.size()
        if s.start <= 0 or n < s.start:
            raise CannotSelectInitialCentersError(f"{n} points for {s.start} clusters")
        theta = int(s.smallest * n)
        groups = [_Group(c) for c in initial(points, s.start, more)]
        before = now = 0.0
        limit, it = s.lumping, 0
        stats = dict.fromkeys(("distribute", "discard_sample", "discarded_cluster", "lumping", "lumped_cluster", "split_cluster", "splitted_cluster", "update_centers"), 0)
        while True:
            if s.max_iterations <= it or (now > 0 and before > 0 and now > before * s.error_limit):
                centers = sorted({g.center for g in groups})
                return Clusters(tuple((c,) for c in centers), now, {**stats, "error": now, "iteration": it, "number_of_cluster": len(centers)})
            groups = [_Group(c) for c in sorted({g.center for g in groups})]
            sums = points.cluster_sums([g.center for g in groups], squares=True)
            stats["distribute"] += 1
            for i, g in enumerate(groups):
                g.size = sums[i][0] if i in sums else 0
            # small clusters go while more than two are left; their points belong nowhere this time
            stats["discard_sample"] += 1
            kept = []
            for i, g in enumerate(groups):
                if g.size < theta and len(groups) - (i - len(kept)) > 2:
                    stats["discarded_cluster"] += 1
                else:
                    kept.append((i, g))
            for i, g in kept:
                if g.size:
                    count, total, _, squares = sums[i]
                    g.center = tuple(t / count for t in total)
                    var = [max(0.0, q / count - m * m) for q, m in zip(squares, g.center, strict=True)]
                    g.distance, g.sigma = sum(var), tuple(math.sqrt(v) for v in var)
                else:
                    g.distance, g.sigma = 0.0, (0.0,) * points.dims
            groups = [g for _, g in kept]
            stats["update_centers"] += 1
            before, now = now, sum(g.size * g.distance for g in groups)
            overall = now / n
            last = it + 1 == s.max_iterations
            if last:
                limit = 0.0
            lump = last or not (len(groups) <= s.desired // 2) and (it % 2 == 0 or len(groups) >= 2 * s.desired)
            if not lump:
                stats["split_cluster"] += 1
                groups, made = split_up(groups, overall, s, theta)
                stats["splitted_cluster"] += made
                if made:
                    it += 1
                    continue
            stats["lumping"] += 1
            groups, made = lumped(groups, limit, s.lump_pairs)
            stats["lumped_cluster"] += made
            it += 1

    return cluster


# ---------------------------------------------------------------- searches


def best(strategies: Sequence[Strategy]) -> Strategy:
    """The result of the smallest error, the first of equal ones; every strategy must succeed."""
    if not strategies:
        raise ValueError("there are no strategies")
    if len(strategies) == 1:
        return strategies[0]
    return lambda points: min((s(points) for s in strategies), key=lambda c: c.error)


def elbow(error_limit: float, most: int, least: int, strategy: Callable[[int], Strategy]) -> Strategy:
    """More clusters, one by one, as long as each lowers the error below ``error_limit`` times the last."""
    def cluster(points: Points) -> Clusters:
        chosen = strategy(least)(points)
        for k in range(least + 1, most + 1):
            try:
                following = strategy(k)(points)
            except EmptyClusterError:
                break
            if not chosen.error * error_limit > following.error:
                break
            chosen = following
        return chosen

    return cluster


def with_persisted(strategy: Strategy) -> Strategy:
    """Keep the points in memory, spilling to disk, for all passes of the strategy."""
    def cluster(points: Points) -> Clusters:
        points.persist()
        try:
            return strategy(points)
        finally:
            points.unpersist()

    return cluster
