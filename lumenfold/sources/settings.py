"""Settings documents: an input file, mask lines, and outputs as lists of transforms, in JSON.

Lists and beans may be wrapped as ``[type name, value]``; missing fields take their defaults.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass
class TransformSettings:
    kind: str
    options: dict = field(default_factory=dict)


@dataclass
class Settings:
    input_file: str | None = None
    mask: list[tuple[float, float, float, float]] = field(default_factory=list)
    outputs: list[list[TransformSettings]] = field(default_factory=list)


#: Defaults of a transform's options, by kind.
DEFAULTS: dict[str, dict] = {
    "Cluster": {
        "algorithm": "K_MEANS", "bins": 32, "errorLimit": 0.95, "initialCentersKDTree": False, "initialCentersMeanAndFarthest": True, "initialCentersRandom": 0,
        "maxClusters": 10, "L": 3, "theta_N": 0.05, "lumping": 3.0, "std_deviation": 20.0, "maxIterations": 10000, "minClusters": 2,
        "replaceEmptyClustersFarthest": True, "replaceEmptyClustersRandom": 0, "type": "CLUSTER_1",
    },
    "NormalizeDeviation": {"sigma": 3.0},
    "NormalizedHyperHue": {"maxZero": 0.01},
    "Select": {"selectedChannels": [0, 1, 2]},
}


def _unwrap(value):
    """(type name or None, value) of a value that may be wrapped."""
    if isinstance(value, list) and len(value) == 2 and isinstance(value[0], str) and "." in value[0]:
        return value[0], value[1]
    return None, value


def _plain(value):
    _, value = _unwrap(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _transform(value) -> TransformSettings:
    name, body = _unwrap(value)
    body = _plain(body) if isinstance(body, dict) else {}
    kind = (name or body.pop("kind", "")).rpartition("$")[2].rpartition(".")[2]
    given = body.pop("options", body)
    return TransformSettings(kind, DEFAULTS.get(kind, {}) | {k: v for k, v in given.items() if v is not None})


def loads(text: str) -> Settings:
    _, top = _unwrap(json.loads(text))
    lines = [_plain(m) for m in _unwrap(top.get("mask") or [])[1]]
    outputs = [_unwrap(o)[1] for o in _unwrap(top.get("outputs") or [])[1]]
    listed = [_unwrap((o.get("transforms") if isinstance(o, dict) else o) or [])[1] for o in outputs]
    mask = [tuple(float(m[k]) for k in ("x1", "y1", "x2", "y2")) if isinstance(m, dict) else tuple(map(float, m)) for m in lines]
    return Settings(top.get("inputFile", top.get("input_file")), mask, [[_transform(t) for t in ts] for ts in listed])


def dumps(settings: Settings) -> str:
    return json.dumps(
        {"inputFile": settings.input_file, "mask": [dict(zip(("x1", "y1", "x2", "y2"), m, strict=True)) for m in settings.mask], "outputs": [{"transforms": [asdict(t) for t in ts]} for ts in settings.outputs]},
        indent=2,
    )
