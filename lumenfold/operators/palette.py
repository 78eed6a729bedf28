"""Colours for clusters: evenly spaced hues or grays, matched greedily to the clusters.

The closest pair of a free candidate and a free cluster is taken again and again, candidates in
ascending order and clusters in lexicographic order, the first of equal pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from ..functions.colors import hsv_to_rgb, hue_of
from .clustering import Clusters
from .points import Vector

#: From clusters and the largest raw value of their storage: the colour of each cluster, in [0, 1].
Palette = Callable[[Clusters, float], list[Vector]]


def _matched(candidates: int, clusters: Clusters, most: float, distance: Callable[[int, Vector], float]) -> list[int]:
    if candidates < 2:
        raise ValueError("a palette needs at least two clusters")
    scaled = sorted(range(candidates), key=lambda i: clusters.centers[i])
    apart = {(c, i): min(distance(c, tuple(x / most for x in v)) for v in clusters.centers[i]) for c in range(candidates) for i in scaled}
    free, chosen = set(range(candidates)), [-1] * candidates
    left = list(scaled)
    while left:
        _, c, _, i = min((apart[c, i], c, left.index(i), i) for c in free for i in left)
        chosen[i] = c
        free.remove(c)
        left.remove(i)
    return chosen


def false_colors(blue: int, green: int, red: int) -> Palette:
    """Full hues, (blue, green, red), matched to the hue of the named channels; missing ones count as 0."""
    def colors(clusters: Clusters, most: float = 1.0) -> list[Vector]:
        n = len(clusters.centers)
        def apart(c: int, v: Vector) -> float:
            at = lambda d: v[d] if d < len(v) else 0.0
            gap = abs(2 * math.pi * c / n - hue_of(at(red), at(green), at(blue)))
            return min(gap, 2 * math.pi - gap)
        return [tuple(reversed(hsv_to_rgb(2 * math.pi * c / n, 1.0, 1.0))) for c in _matched(n, clusters, most, apart)]

    return colors


def false_grays(dims: int) -> Palette:
    """Grays of ``dims`` equal channels, matched to the root mean square of the vectors."""
    def colors(clusters: Clusters, most: float = 1.0) -> list[Vector]:
        n = len(clusters.centers)
        def apart(c: int, v: Vector) -> float:
            return abs(c / (n - 1) - math.sqrt(sum(x * x for x in v) / len(v)))
        return [(c / (n - 1),) * dims for c in _matched(n, clusters, most, apart)]

    return colors
