"""Points: a table of vectors as scalar columns, and the operators that clustering is made of.

Centers are always few and are compiled into the plan as literals, so assigning points needs no join
and no shuffle; all aggregates are partial before they are shuffled, so that what moves between
tasks is a few rows for each center.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyClusterError, EmptySetError, NonFiniteError

Vector = tuple[float, ...]

#: up to so many center coordinates the distances are unrolled into generated code
UNROLLED = 600


@dataclass
class Points:
    """Rows of ``id`` and x0 to x{dims-1}, in raw units."""

    df: DataFrame
    dims: int
    _size: int | None = field(default=None, repr=False)
    #: what strategies have found out about these points
    known: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of(cls, df: DataFrame, vector: str | Sequence[Column], id_: str | Column = "id", dims: int | None = None, mask: Column | None = None) -> Points:
        """From a vector column (``dims`` long) or a list of channel columns; rows outside ``mask`` stay out."""
        if isinstance(vector, str):
            if dims is None:
                first = df.select(F.size(vector)).first()
                dims = first[0] if first else 0
            vector = [F.col(vector).getItem(i) for i in range(dims)]
        if mask is not None:
            df = df.where(mask)
        return cls(df.select(F.col(id_).alias("id") if isinstance(id_, str) else id_.alias("id"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(vector)]), len(vector))

    @property
    def coordinates(self) -> list[Column]:
        return [F.col(f"x{i}") for i in range(self.dims)]

    def persist(self) -> Points:
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.df.unpersist()

    def size(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    # ------------------------------------------------------------ distances

    def squared_distance(self, center: Vector) -> Column:
        return squared_distance(self.coordinates, center)

    def _distances(self, centers: Sequence[Vector]) -> DataFrame:
        """With d0 to d{k-1}, the squared distances."""
        return self.df.withColumns({f"d{i}": self.squared_distance(c) for i, c in enumerate(centers)})

    def assign(self, centers: Sequence[Vector]) -> DataFrame:
        """With cid, the first of the nearest centers, and d2, its squared distance. Row-local."""
        return assign_columns(self.df, self.coordinates, centers)

    # ------------------------------------------------------------ aggregates

    def check_finite(self) -> None:
        bad = F.lit(False)
        for x in self.coordinates:
            bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        if self.df.where(bad).limit(1).count():
            raise NonFiniteError("a coordinate is not finite")

    def sums(self) -> Vector:
        """Sum of each coordinate; an error if any is not finite."""
        row = self.df.agg(*[F.sum(x) for x in self.coordinates]).first()
        if any(v is not None and not math.isfinite(v) for v in row):
            raise NonFiniteError("a sum is not finite")
        return tuple(v or 0.0 for v in row)

    def mean(self) -> Vector:
        row = self.df.agg(F.count("*"), *[F.avg(x) for x in self.coordinates]).first()
        if not row[0]:
            raise EmptySetError("the mean of no points")
        return tuple(row[1:])

    def deviation(self, mean: Vector | None = None) -> Vector:
        """Population deviation around the given mean, else around the points' own."""
        mean = mean or self.mean()
        row = self.df.agg(F.count("*"), *[F.avg((x - F.lit(m)) * (x - F.lit(m))) for x, m in zip(self.coordinates, mean, strict=True)]).first()
        if not row[0]:
            raise EmptySetError("the deviation of no points")
        return tuple(math.sqrt(v) for v in row[1:])

    def distance_sum(self, center: Vector) -> float:
        return self.df.agg(F.sum(self.squared_distance(center))).first()[0] or 0.0

    def bounds(self) -> tuple[Vector, Vector]:
        row = self.df.agg(*[f(x) for f in (F.min, F.max) for x in self.coordinates]).first()
        return tuple(row[: self.dims]), tuple(row[self.dims :])

    def widest_dimension(self) -> int:
        low, high = self.bounds()
        spans = [b - a for a, b in zip(low, high, strict=True)]
        return spans.index(max(spans))

    def cluster_sums(self, centers: Sequence[Vector], squares: bool = False) -> dict[int, tuple]:
        """For each center with points: (count, sums, sum of squared distances, sums of squares). One job."""
        squared = [F.sum(x * x) for x in self.coordinates] if squares else []
        rows = self.assign(centers).groupBy("cid").agg(F.count("*"), F.sum("d2"), *[F.sum(x) for x in self.coordinates], *squared).collect()
        return {r[0]: (r[1], tuple(r[3 : 3 + self.dims]), r[2], tuple(r[3 + self.dims :])) for r in rows}

    # ------------------------------------------------------------ selection

    def farthest(self, centers: Sequence[Vector], maximin: bool = False) -> Vector:
        """The point with the largest sum (or smallest one, ``maximin``) of squared distances to the centers.

        Points that are a center take no part; of equal ones the smallest id wins.
        """
        d = [F.col(f"d{i}") for i in range(len(centers))]
        least = F.least(*d) if len(d) > 1 else d[0]
        score = least if maximin else sum(d[1:], d[0])
        found = self._distances(centers).where(least > 0).orderBy(score.desc(), "id").select(*self.coordinates).first()
        if found is None:
            raise EmptyClusterError("every point is a center already")
        return tuple(found)

    def random_point(self, besides: Sequence[Vector], seed: int) -> Vector:
        """A point that is none of ``besides``; the same one for the same seed."""
        rows = self.df
        for c in besides:
            same = F.lit(True)
            for x, v in zip(self.coordinates, c, strict=True):
                same = same & (x == F.lit(float(v)))
            rows = rows.where(~same)
        found = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").select(*self.coordinates).first()
        if found is None:
            raise EmptyClusterError("every point is a center already")
        return tuple(found)

    def random_distinct(self, k: int, seed: int) -> list[Vector]:
        names = [f"x{i}" for i in range(self.dims)]
        rows = self.df.select(*names).distinct().orderBy(F.xxhash64(*names, F.lit(seed)), *names).limit(k).collect()
        return [tuple(r) for r in rows]


def squared_distance(coordinates: Sequence[Column], center: Vector) -> Column:
    """Sum of squared differences, in generated code."""
    out = F.lit(0.0)
    for x, c in zip(coordinates, center, strict=True):
        out = out + (F.lit(float(c)) - x) * (F.lit(float(c)) - x)
    return out


def assign_columns(df: DataFrame, coordinates: Sequence[Column], centers: Sequence[Vector], cid: str = "cid", d2: str = "d2") -> DataFrame:
    """``df`` with the first of the nearest centers and its squared distance."""
    if not centers:
        raise ValueError("there are no centers")
    if len(centers) * len(coordinates) > UNROLLED:
        return nearest_of_array(df, F.array(*coordinates), centers, cid, d2)
    d = [F.col(f"__to{i}") for i in range(len(centers))]
    near = df.withColumns({f"__to{i}": squared_distance(coordinates, c) for i, c in enumerate(centers)}).withColumn(d2, F.least(*d) if len(d) > 1 else d[0])
    which = F.lit(len(d) - 1)
    for i in range(len(d) - 2, -1, -1):
        which = F.when(d[i] == F.col(d2), F.lit(i)).otherwise(which)
    return near.withColumn(cid, which).drop(*[f"__to{i}" for i in range(len(d))])


def nearest_of_array(df: DataFrame, vector: Column, centers: Sequence[Vector], cid: str = "cid", d2: str = "d2") -> DataFrame:
    """cid and d2 by whole batches of rows in Arrow, for many center coordinates.

    Sums run in the order of the coordinates, as in generated code. A vector with a missing coordinate
    has no distance; NaN is farther than all else.
    """
    near = F.arrow_udf(_nearest(tuple(tuple(float(x) for x in c) for c in centers)), "cid int, d2 double")
    return df.withColumn("__near", near(vector)).withColumn(cid, F.col("__near.cid")).withColumn(d2, F.col("__near.d2")).drop("__near")


def _nearest(centers: tuple[Vector, ...]) -> Callable[[pa.Array], pa.Array]:
    dims = len(centers[0])

    def run(vectors: pa.Array) -> pa.Array:
        whole = (vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims) & vectors.is_valid().to_numpy(zero_copy_only=False)
        flat = vectors.filter(pa.array(whole)).flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dims).all(axis=1)
        rows = np.flatnonzero(whole)[known]
        points = np.ascontiguousarray(flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, dims)[known].T)
        cid, d2, missing = np.zeros(len(whole), np.int32), np.zeros(len(whole)), np.ones(len(whole), bool)
        best, least = np.zeros(len(rows), np.int32), np.full(len(rows), np.nan)
        with np.errstate(all="ignore"):
            for i, c in enumerate(centers):
                d = np.zeros(len(rows))
                for x, v in zip(points, c, strict=True):
                    d += (v - x) * (v - x)
                nearer = (d < least) | (np.isnan(least) & ~np.isnan(d))
                np.copyto(best, i, where=nearer)
                np.copyto(least, d, where=nearer)
        cid[rows], d2[rows], missing[rows] = best, least, False
        return pa.StructArray.from_arrays([pa.array(cid, pa.int32()), pa.array(d2, pa.float64(), mask=missing)], names=["cid", "d2"])

    return run


def median_split(values: Sequence) -> tuple[list, list]:
    """Two halves of a list, no value of the first above any of the second; sizes differ by one at most."""
    ordered = sorted(values)
    half = len(ordered) // 2
    return ordered[:half], ordered[half:]
