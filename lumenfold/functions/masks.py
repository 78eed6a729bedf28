"""Masks: predicates on a pixel's place. They restrict what is fitted, never what is written."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def everything() -> Column:
    return F.lit(True)


def half_plane(cx: float, cy: float, c: float, x: str = "x", y: str = "y") -> Column:
    return F.col(x) * F.lit(float(cx)) + F.col(y) * F.lit(float(cy)) + F.lit(float(c)) >= 0


def half_plane_through(x1: float, y1: float, x2: float, y2: float, **names: str) -> Column:
    """The half plane on one side of the line from (x1, y1) to (x2, y2)."""
    dx, dy = x2 - x1, y2 - y1
    return half_plane(dy, -dx, y1 * dx - x1 * dy, **names)


def all_of(masks: Sequence[Column]) -> Column:
    return reduce(and_, masks) if masks else everything()


def parse_mask(text: str | None) -> Column:
    """A mask of lines ``x1,y1,x2,y2,...``; without text everything."""
    if not text or not text.strip():
        return everything()
    parts = [float(p) for p in text.split(",")]
    if len(parts) % 4:
        raise ValueError("a mask needs four numbers for each line")
    return all_of([half_plane_through(*parts[i : i + 4]) for i in range(0, len(parts), 4)])
