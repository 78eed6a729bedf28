"""Stages of an image plan over pixel rows (image_id, y, x, v).

Every stage is a Spark ML transformer or estimator, so plans are ``pyspark.ml.Pipeline``s. The
number of channels and their storage travel in the metadata of ``v``; a stage works on scalar
channel columns, so a whole chain of projections stays in generated code without a shuffle.
Masks restrict what is fitted; every pixel is written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmptyClusterError
from ..functions import pixels as px
from ..operators import palette as pal
from ..operators.clustering import Clusters, Strategy, with_persisted
from ..operators.points import Points, assign_columns


def with_storage(df: DataFrame, dims: int, storage: str) -> DataFrame:
    """Pixel rows whose ``v`` says how many channels it has and how they are stored."""
    return df.withColumn("v", F.col("v").alias("v", metadata={"dims": dims, "storage": storage}))


def shape_of(df: DataFrame) -> tuple[int, str]:
    """(channels, storage); looked up in a row where the metadata doesn't tell."""
    meta = df.schema["v"].metadata or {}
    if "dims" in meta:
        return meta["dims"], meta["storage"]
    first = df.select(F.size("v")).first()
    return (first[0] if first else 0), "u8"


def _set(df: DataFrame, channels: list[Column], storage: str) -> DataFrame:
    return df.withColumn("v", F.array(*channels).alias("v", metadata={"dims": len(channels), "storage": storage}))


class Projection(Transformer):
    """A stateless projection; ``storage`` None keeps the storage of what comes in."""

    def __init__(self, name: str, project: Callable[[px.Channels], px.Channels], storage: str | None = None):
        super().__init__()
        self.name, self.project, self.storage = name, project, storage

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dims, storage = shape_of(dataset)
        storage = self.storage or storage
        return _set(dataset, px.quantize(self.project(px.channels(F.col("v"), dims)), storage), storage)


def select(*dims: int) -> Projection:
    return Projection(f"select({','.join(map(str, dims))})", lambda ch: px.select(ch, dims))


def hue() -> Projection:
    return Projection("hue", px.hue)


def hyper_hue() -> Projection:
    return Projection("hyper-hue", px.hyper_hue, "f32")


def normalized_hyper_hue(max_zero: float = 0.01) -> Projection:
    return Projection(f"normalized-hyper-hue({max_zero})", lambda ch: px.normalized_hyper_hue(ch, max_zero), "f32")


def intensity() -> Projection:
    return Projection("intensity", px.intensity)


def vegetation_index() -> Projection:
    return Projection("normalized-difference-vegetation-index", px.vegetation_index)


@dataclass(frozen=True)
class Ranges:
    lows: tuple[float, ...]
    lengths: tuple[float, ...]


def min_max_ranges(df: DataFrame, dims: int) -> Ranges:
    """Smallest and largest value of each channel; a range of none or one value has length 1."""
    ch = px.channels(F.col("v"), dims)
    row = df.agg(*[F.min(c) for c in ch], *[F.max(c) for c in ch]).first()
    lows = [min(1.0, v) if v is not None else 1.0 for v in row[:dims]]
    highs = [max(0.0, v) if v is not None else 0.0 for v in row[dims:]]
    return Ranges(tuple(lows), tuple(b - a if b > a else 1.0 for a, b in zip(lows, highs, strict=True)))


def deviation_ranges(df: DataFrame, dims: int, sigma: float) -> Ranges:
    """``sigma`` population deviations around the mean, inside [0, 1]."""
    ch = px.channels(F.col("v"), dims)
    row = df.agg(*[F.avg(c) for c in ch], *[F.var_pop(c) for c in ch]).first()
    lows, lengths = [], []
    for mean, var in zip(row[:dims], row[dims:], strict=True):
        reach = sigma * max(0.0, var) ** 0.5 if mean is not None else 0.0
        low, high = (max(0.0, mean - reach), min(1.0, mean + reach)) if mean is not None else (0.0, 1.0)
        lows.append(low)
        lengths.append(high - low if high > low else 1.0)
    return Ranges(tuple(lows), tuple(lengths))


class Normalize(Estimator):
    """Stretch each channel to [0, 1] by its smallest and largest value, or around its mean."""

    def __init__(self, mask: Column | None = None, sigma: float | None = None):
        super().__init__()
        self.mask, self.sigma = mask, sigma
        self.name = "normalize-min-max" if sigma is None else f"normalize-deviation({sigma})"

    def _fit(self, dataset: DataFrame) -> NormalizeModel:
        dims, _ = shape_of(dataset)
        rows = dataset if self.mask is None else dataset.where(self.mask)
        return NormalizeModel(min_max_ranges(rows, dims) if self.sigma is None else deviation_ranges(rows, dims, self.sigma), self.name)


class NormalizeModel(Model):
    def __init__(self, ranges: Ranges, name: str = "normalize"):
        super().__init__()
        self.ranges, self.name = ranges, name

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dims, _ = shape_of(dataset)
        return _set(dataset, px.quantize(px.scale(px.channels(F.col("v"), dims), self.ranges.lows, self.ranges.lengths), "f32"), "f32")

    def log(self) -> dict:
        return {"transform": self.name, "min": list(self.ranges.lows), "length": list(self.ranges.lengths)}


def _place() -> Column:
    """A pixel's place as one number, for ties."""
    return F.col("y").cast("long") * 2**32 + F.col("x")


def _recolored(df: DataFrame, coordinates: list[Column], clusters: Clusters, colors: list, name: str) -> DataFrame:
    """With the colour of the nearest cluster of the coordinates as the array ``name``."""
    rows = assign_columns(df, coordinates, clusters.vectors, cid="__cid", d2="__d2")
    table = F.array(*[F.array(*[F.lit(float(x)) for x in colors[i]]) for i in clusters.owners])
    return rows.withColumn(name, F.get(table, F.col("__cid"))).drop("__cid", "__d2")


class Cluster(Estimator):
    """Cluster the pixels (in raw units), and paint each with the colour of its cluster."""

    def __init__(self, strategy: Strategy, palette: pal.Palette = pal.false_colors(0, 1, 2), mask: Column | None = None):
        super().__init__()
        self.strategy, self.palette, self.mask = strategy, palette, mask

    def _fit(self, dataset: DataFrame) -> ClusterModel:
        dims, storage = shape_of(dataset)
        most = px.STORAGE[storage]
        points = Points.of(dataset, [px.raw(c, storage) for c in px.channels(F.col("v"), dims)], _place(), mask=self.mask)
        clusters = with_persisted(self.strategy)(points)
        return ClusterModel(clusters, self.palette(clusters, most))


class ClusterModel(Model):
    def __init__(self, clusters: Clusters, colors: list):
        super().__init__()
        self.clusters, self.colors = clusters, colors

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dims, storage = shape_of(dataset)
        painted = _recolored(dataset, [px.raw(c, storage) for c in px.channels(F.col("v"), dims)], self.clusters, self.colors, "__color")
        width = len(self.colors[0])
        return _set(painted, px.quantize(px.channels(F.col("__color"), width), "u8"), "u8").drop("__color")

    def log(self) -> dict:
        return {"transform": "cluster", "clusters-center": [c for c in self.clusters.centers], "clusters-color": self.colors, "clusters-error": self.clusters.error, "stats": self.clusters.stats}


class SaturationCluster(Estimator):
    """Cluster gray pixels by their value and the others by hue or hyper-hue, each with its own palette."""

    def __init__(self, by: str, strategy: Strategy, mask: Column | None = None):
        super().__init__()
        if by not in ("hue", "hyper-hue"):
            raise ValueError(f"pixels can be split by hue or hyper-hue, not by {by}")
        self.by, self.strategy, self.mask = by, strategy, mask

    def _fit(self, dataset: DataFrame) -> SaturationClusterModel:
        dims, _ = shape_of(dataset)
        gray, value, color = split(self.by, px.channels(F.col("v"), dims))
        rows = dataset if self.mask is None else dataset.where(self.mask)
        made = []
        for what, which, channels in (("gray", gray, [value]), ("coloured", ~gray, color)):
            points = Points.of(rows, px.quantize(channels, "f32"), _place(), mask=which)
            try:
                made.append(with_persisted(self.strategy)(points))
            except EmptyClusterError as e:
                raise type(e)(f"the {what} pixels cannot be clustered: {e}") from e
        return SaturationClusterModel(self.by, *made, pal.false_grays(3)(made[0], 1.0), pal.false_colors(0, 1, 2)(made[1], 1.0))


def split(by: str, channels: px.Channels) -> tuple[Column, Column, px.Channels]:
    if by == "hue":
        gray, value, share = px.split_by_hue(channels)
        return gray, value, [share]
    return px.split_by_hyper_hue(channels)


class SaturationClusterModel(Model):
    def __init__(self, by: str, grays: Clusters, hues: Clusters, gray_colors: list, hue_colors: list):
        super().__init__()
        self.by, self.grays, self.hues, self.gray_colors, self.hue_colors = by, grays, hues, gray_colors, hue_colors

    @property
    def error(self) -> float:
        return self.grays.error + self.hues.error

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dims, storage = shape_of(dataset)
        gray, value, color = split(self.by, px.channels(F.col("v"), dims))
        rows = dataset.withColumns({"__gray": gray, "__value": value.cast("float").cast("double"), **{f"__c{i}": c for i, c in enumerate(px.quantize(color, "f32"))}})
        rows = _recolored(rows, [F.col("__value")], self.grays, self.gray_colors, "__as_gray")
        rows = _recolored(rows, [F.col(f"__c{i}") for i in range(len(color))], self.hues, self.hue_colors, "__as_hue")
        rows = rows.withColumn("__color", F.when(F.col("__gray"), F.col("__as_gray")).otherwise(F.col("__as_hue")))
        out = _set(rows, px.quantize(px.channels(F.col("__color"), 3), storage), storage)
        return out.drop("__gray", "__value", "__as_gray", "__as_hue", "__color", *[f"__c{i}" for i in range(len(color))])

    def log(self) -> dict:
        return {"transform": f"cluster-{self.by}", "clusters-error": self.error, "gray": {"center": self.grays.centers, "color": self.gray_colors}, "coloured": {"center": self.hues.centers, "color": self.hue_colors}}
