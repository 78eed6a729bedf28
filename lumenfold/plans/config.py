"""The options of a run, the grammar of transforms, and the plan and strategy that they ask for."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.sql import Column

from ..functions import masks
from ..operators import clustering as cl
from ..operators import otsu, palette
from ..sources.settings import Settings, TransformSettings
from . import stages

ALGORITHMS = ("k-means", "isodata", "otsu", "otsu-circular")


@dataclass
class Config:
    input: str = ""
    output: str = ""
    algorithm: str = "k-means"
    elbow: bool = True
    error_limit: float = 0.95
    min: int = 2
    max: int = 20
    max_iterations: int = 1000
    bins: int = 32
    image_transform: list[str] = field(default_factory=list)
    mask: str | None = None
    saturation_based: str | None = None
    initial_centers_kd_tree: bool = False
    initial_centers_mean: bool = True
    initial_centers_random: int = 0
    replace_empty_clusters_farthest: bool = True
    replace_empty_clusters_random: int = 0
    rgb_cluster_colors: bool = True
    isodata_theta: float = 0.05
    isodata_l: int = 3
    isodata_lumping: float = 3.0
    isodata_std_deviation: float = 0.0
    batch_mode: bool = False
    batch_parallel_images: int = 1
    buffered_input: bool = True
    buffered_output: bool = True
    output_format: str | None = None
    log: str | None = None
    threads: int = 0
    seed: int = 0


def _numbers(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def parse_transform(text: str, mask: Column | None = None):
    """The stage that ``text`` names, with its arguments in brackets."""
    m = re.fullmatch(r"\s*([a-z-]+)\s*(?:\(([^()]*)\))?\s*", text)
    name, given = (m[1], _numbers(m[2] or "")) if m else (text, [])
    makers: dict[tuple[str, int], Callable] = {
        ("hue", 0): stages.hue,
        ("hyper-hue", 0): stages.hyper_hue,
        ("intensity", 0): stages.intensity,
        ("normalized-difference-vegetation-index", 0): stages.vegetation_index,
        ("normalize-min-max", 0): lambda: stages.Normalize(mask),
        ("normalize-deviation", 1): lambda s: stages.Normalize(mask, float(s)),
        ("normalized-hyper-hue", 1): lambda z: stages.normalized_hyper_hue(float(z)),
    }
    if name == "select" and given:
        return stages.select(*map(int, given))
    if (name, len(given)) not in makers:
        raise ValueError(f"unexpected image transform: {text}")
    return makers[name, len(given)](*given)


def strategy_of(c: Config) -> cl.Strategy:
    """The clustering that the options ask for: every pair of first centers and replacement is tried."""
    first = [cl.kd_tree_centers()] * c.initial_centers_kd_tree + [cl.mean_and_farthest()] * c.initial_centers_mean + [cl.random_centers(c.seed + i) for i in range(c.initial_centers_random)]
    more = [cl.farthest()] * c.replace_empty_clusters_farthest + [cl.random_replacement(c.seed + i) for i in range(c.replace_empty_clusters_random)]
    if c.algorithm not in ALGORITHMS:
        raise ValueError(f"unexpected clustering algorithm: {c.algorithm}")
    if c.algorithm in ("k-means", "isodata") and not (first and more):
        raise ValueError(f"no {'initial centers' if not first else 'replacement of empty clusters'} selected")
    pairs = [(a, b) for a in first for b in more]
    if c.algorithm == "isodata":
        s = cl.IsodataSettings(c.min, c.max, c.error_limit, c.max_iterations, c.isodata_theta, c.isodata_lumping, c.isodata_l, c.isodata_std_deviation)
        return cl.best([cl.isodata(s, a, b) for a, b in pairs])
    makers: dict[str, Callable[[int], cl.Strategy]] = {
        "k-means": lambda k: cl.best([cl.k_means(k, c.error_limit, a, c.max_iterations, b) for a, b in pairs]),
        "otsu": lambda k: otsu.linear(c.bins, k),
        "otsu-circular": lambda k: otsu.circular(c.bins, k),
    }
    make = makers[c.algorithm]
    return cl.elbow(c.error_limit, c.max, c.min, make) if c.elbow else make(c.max)


def plan_of(c: Config) -> Pipeline:
    """The transforms in their order, and the clustering last."""
    mask = masks.parse_mask(c.mask) if c.mask else None
    strategy = strategy_of(c)
    if c.saturation_based:
        last = stages.SaturationCluster(c.saturation_based, strategy, mask)
    else:
        last = stages.Cluster(strategy, palette.false_colors(0, 1, 2) if c.rgb_cluster_colors else palette.false_grays(1), mask)
    return Pipeline(stages=[*[parse_transform(t, mask) for t in c.image_transform], last])


#: Names of transforms in settings documents, and of their clusterings.
SIMPLE = {"Hue": "hue", "HyperHue": "hyper-hue", "Intensity": "intensity", "NormalizeMinMax": "normalize-min-max", "NormalizedDifferenceVegetationIndex": "normalized-difference-vegetation-index"}
KINDS = {"K_MEANS": "k-means", "ISODATA": "isodata", "OTSU": "otsu", "OTSU_CIRCULAR": "otsu-circular"}
TYPES = {"CLUSTER_1": None, "CLUSTER_HUE": "hue", "CLUSTER_HYPER_HUE": "hyper-hue"}


def stage_of(t: TransformSettings, mask: Column | None):
    """The stage of one transform of a settings document. An elbow is searched if min is below max."""
    o = t.options
    if t.kind == "Cluster":
        c = Config(
            algorithm=KINDS[o["algorithm"]], elbow=o["minClusters"] < o["maxClusters"], error_limit=o["errorLimit"], min=o["minClusters"], max=o["maxClusters"], max_iterations=o["maxIterations"], bins=o["bins"],
            saturation_based=TYPES[o["type"]], initial_centers_kd_tree=o["initialCentersKDTree"], initial_centers_mean=o["initialCentersMeanAndFarthest"], initial_centers_random=o["initialCentersRandom"],
            replace_empty_clusters_farthest=o["replaceEmptyClustersFarthest"], replace_empty_clusters_random=o["replaceEmptyClustersRandom"],
            isodata_theta=o["theta_N"], isodata_l=o["L"], isodata_lumping=o["lumping"], isodata_std_deviation=o["std_deviation"],
        )
        strategy = strategy_of(c)
        return stages.SaturationCluster(c.saturation_based, strategy, mask) if c.saturation_based else stages.Cluster(strategy, mask=mask)
    if t.kind == "NormalizeDeviation":
        return stages.Normalize(mask, float(o["sigma"]))
    if t.kind == "NormalizedHyperHue":
        return stages.normalized_hyper_hue(float(o["maxZero"]))
    if t.kind == "Select":
        return stages.select(*[int(d) for d in o["selectedChannels"]])
    if t.kind in SIMPLE:
        return parse_transform(SIMPLE[t.kind], mask)
    raise ValueError(f"unexpected transform: {t.kind}")


def plans_of(settings: Settings) -> list[Pipeline]:
    """One plan for each output of a settings document; an output without transforms is the input."""
    mask = masks.all_of([masks.half_plane_through(*m) for m in settings.mask]) if settings.mask else None
    return [Pipeline(stages=[stage_of(t, mask) for t in ts]) for ts in settings.outputs]
