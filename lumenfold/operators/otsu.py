"""Otsu thresholds of one-dimensional points: one job for the range, one for the histogram, the
search on the driver over the bins.

The objective is the *unweighted* sum of the classes' variances (``weighted=True`` for the textbook
one), so an empty class costs nothing. The search is a dynamic programme over bins, k times bins
squared, that returns the lexicographically smallest thresholds of the smallest objective.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CannotSelectInitialCentersError
from .clustering import Clusters, Strategy
from .points import Points

#: decimals up to which two objectives count as equal
ROUND = 9


@dataclass(frozen=True)
class Histogram:
    """Bins with counts and moments; ``edges`` has one more entry than there are bins."""

    edges: tuple[float, ...]
    counts: tuple[int, ...]
    first: tuple[float, ...]
    second: tuple[float, ...]

    @property
    def bins(self) -> int:
        return len(self.counts)

    def rotated(self, by: int) -> Histogram:
        """Counts turned right; the moments are those of the bins' numbers."""
        counts = tuple(self.counts[(i - by) % self.bins] for i in range(self.bins))
        return Histogram(self.edges, counts, tuple(float(c * i) for i, c in enumerate(counts)), tuple(float(c * i * i) for i, c in enumerate(counts)))


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Evenly spaced edges from ``low`` to just above ``high``, each above the one before."""
    high = high + math.ulp(high)
    edges = [((bins - i) * low + i * high) / bins for i in range(bins + 1)]
    for i in range(1, len(edges)):
        if edges[i] <= edges[i - 1]:
            edges[i] = edges[i - 1] + math.ulp(edges[i - 1])
    return edges


def bin_rows(points: Points, edges: Sequence[float]) -> DataFrame:
    """(bin, n, sum1, sum2) of the points between the edges."""
    bins, x = len(edges) - 1, F.col("x0")
    # a binary search in generated code: halves of the inner edges
    def place(a: int, b: int):
        if a == b:
            return F.lit(a)
        middle = (a + b + 1) // 2
        return F.when(x >= F.lit(float(edges[middle])), place(middle, b)).otherwise(place(a, middle - 1))
    return points.df.withColumn("bin", place(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"), F.sum(x).alias("sum1"), F.sum(x * x).alias("sum2"))


def histogram(points: Points, bins: int) -> Histogram:
    if points.dims != 1:
        raise ValueError("a histogram needs one dimension")
    (low,), (high,) = points.bounds()
    if low is None:
        raise CannotSelectInitialCentersError("a histogram of no points")
    edges = bin_edges(low, high, bins)
    rows = {r["bin"]: r for r in bin_rows(points, edges).collect()}
    of = lambda name, zero: tuple(rows[i][name] if i in rows else zero for i in range(bins))
    return Histogram(tuple(edges), of("n", 0), of("sum1", 0.0), of("sum2", 0.0))


def class_costs(h: Histogram, weighted: bool = False) -> list[list[float]]:
    """cost[a][b]: variance of the bins from a up to before b; 0 without points."""
    c, m1, m2 = [0], [0.0], [0.0]
    for n, s, q in zip(h.counts, h.first, h.second, strict=True):
        c.append(c[-1] + n)
        m1.append(m1[-1] + s)
        m2.append(m2[-1] + q)
    def cost(a: int, b: int) -> float:
        n = c[b] - c[a]
        if not n:
            return 0.0
        mean = (m1[b] - m1[a]) / n
        return max(0.0, (m2[b] - m2[a]) / n - mean * mean) * (n if weighted else 1)
    return [[cost(a, b) if b > a else 0.0 for b in range(h.bins + 1)] for a in range(h.bins)]


def thresholds(h: Histogram, k: int, weighted: bool = False) -> tuple[float, list[int]]:
    """(objective, the k-1 thresholds): ascending bin numbers, the smallest of equal solutions."""
    b, cost = h.bins, class_costs(h, weighted)
    # rest[j][a]: the smallest objective of the bins from a on in j classes
    rest: list[dict[int, float]] = [{}, {a: cost[a][b] for a in range(b)}]
    for j in range(2, k + 1):
        rest.append({a: min(cost[a][t] + rest[j - 1][t] for t in range(a + 1, b - j + 2)) for a in range(b - j + 1)})
    found, a = [], 0
    for j in range(k, 1, -1):
        goal = round(rest[j][a], ROUND)
        a = next(t for t in range(a + 1, b - j + 2) if round(cost[a][t] + rest[j - 1][t], ROUND) <= goal)
        found.append(a)
    return rest[k][0], found


def _check(points: Points, bins: int, k: int) -> None:
    if k < 2 or bins < k:
        raise ValueError(f"{bins} bins for {k} classes; at least two classes and a bin for each are needed")
    if points.dims != 1:
        raise ValueError("Otsu needs one dimension")


def _below(x: float) -> float:
    return x - math.ulp(x)


def linear(bins: int, k: int, weighted: bool = False) -> Strategy:
    """Each class is the pair of its first and its last value."""
    def cluster(points: Points) -> Clusters:
        _check(points, bins, k)
        h = histogram(points, bins)
        error, cuts = thresholds(h, k, weighted)
        ends = [0, *cuts, bins]
        return Clusters(tuple(((h.edges[a],), (_below(h.edges[b]),)) for a, b in zip(ends, ends[1:], strict=False)), error)

    return cluster


def circular(bins: int, k: int, weighted: bool = False) -> Strategy:
    """On a circle: the best of all rotations, the first of equal ones; a class may run through the end."""
    def cluster(points: Points) -> Clusters:
        _check(points, bins, k)
        h = histogram(points, bins)
        tried = [(*thresholds(h.rotated(s), k, weighted), s) for s in range(bins)]
        error = min(round(t[0], ROUND) for t in tried)
        value, cuts, shift = next(t for t in tried if round(t[0], ROUND) <= error)
        ends, classes = [0, *cuts, bins], []
        for a, b in zip(ends, ends[1:], strict=False):
            a, b = (a - shift) % bins, (b - shift) % bins or bins
            if a < b:
                classes.append(((h.edges[a],), (_below(h.edges[b]),)))
            else:
                classes.append(((h.edges[0],), (_below(h.edges[b]),), (h.edges[a],), (_below(h.edges[bins]),)))
        return Clusters(tuple(classes), value)

    return cluster
