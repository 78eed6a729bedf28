"""Per-pixel projections over a list of channel columns in [0, 1].

A projection takes the channels as separate scalar columns and returns the new ones, so that whole
pipelines stay in generated code; ``channels`` and ``F.array`` go from a vector column and back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .colors import rgb_to_hsv_hsl

Channels = list[Column]

#: Largest raw value of each storage.
STORAGE = {"u8": 255.0, "u16": 65535.0, "f32": 1.0}


def channels(vector: Column, dims: int) -> Channels:
    return [vector.getItem(i) for i in range(dims)]


def need(ch: Channels, least: int, what: str) -> None:
    if len(ch) < least:
        raise ValueError(f"{what} needs at least {least} channels, not {len(ch)}")


def total(columns: Sequence[Column]) -> Column:
    return reduce(add, columns)


def select(ch: Channels, dims: Sequence[int]) -> Channels:
    """Reorder, drop or repeat channels."""
    need(ch, len(dims), "select")
    if any(not 0 <= d < len(ch) for d in dims):
        raise ValueError(f"select names a channel beyond 0 to {len(ch) - 1}: {list(dims)}")
    return [ch[d] for d in dims]


def hue(ch: Channels) -> Channels:
    """The hue as a share of a turn; channels 0, 1 and 2 are red, green and blue."""
    need(ch, 3, "hue")
    return [rgb_to_hsv_hsl(ch[0], ch[1], ch[2]).hue / (2 * math.pi)]


def hyper_hue(ch: Channels) -> Channels:
    """Each channel's distance from the pixel's mean, moved to [0, 1]."""
    mean = total(ch) / len(ch)
    return [0.5 + 0.5 * (c - mean) for c in ch]


def normalized_hyper_hue(ch: Channels, max_zero: float = 0.01) -> Channels:
    """Hyper-hue at length 1; pixels whose hyper-hue is shorter than ``max_zero`` are all 0.5."""
    mean = total(ch) / len(ch)
    square = total([(c - mean) * (c - mean) for c in ch])
    short = F.lit(max_zero * max_zero) > square
    length = F.sqrt(F.when(short | (square <= 0), 1.0).otherwise(square))
    return [F.when(short, 0.5).when(square <= 0, 0.5).otherwise(0.5 + 0.5 * (c - mean) / length) for c in ch]


def intensity(ch: Channels) -> Channels:
    """Root mean square of the channels."""
    return [F.sqrt(total([c * c for c in ch]) / len(ch))]


def vegetation_index(ch: Channels) -> Channels:
    """Normalized difference of near infrared (channel 0) and red (1): its negative and its positive part."""
    need(ch, 2, "vegetation index")
    below = ch[0] + ch[1]
    index = F.when(below == 0, 0.0).otherwise((ch[0] - ch[1]) / F.when(below == 0, 1.0).otherwise(below))
    return [F.greatest(-index, F.lit(0.0)), F.greatest(index, F.lit(0.0))]


def scale(ch: Channels, lows: Sequence[float], lengths: Sequence[float]) -> Channels:
    """(c - low) / length in [0, 1], channel by channel."""
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c - F.lit(float(a))) / F.lit(float(n)))) for c, a, n in zip(ch, lows, lengths, strict=True)]


def quantize(ch: Channels, storage: str | None) -> Channels:
    """What is left of normalized channels once they are stored: whole steps, or single precision."""
    if storage is None:
        return ch
    if storage == "f32":
        return [c.cast("float").cast("double") for c in ch]
    return [raw(c, storage) / STORAGE[storage] for c in ch]


def raw(c: Column, storage: str) -> Column:
    """The stored value of a normalized channel."""
    if storage == "f32":
        return c.cast("float").cast("double")
    most = STORAGE[storage]
    return F.least(F.lit(most), F.greatest(F.lit(0.0), F.floor(c * most + 0.5).cast("double")))


def normalized(c: Column, storage: str) -> Column:
    return c / STORAGE[storage]


# ---------------------------------------------------------------- gray or coloured


def split_by_hue(ch: Channels) -> tuple[Column, Column, Column]:
    """(is gray, gray value, share of hue); here channel 0 is blue and channel 2 is red."""
    need(ch, 3, "split by hue")
    c = rgb_to_hsv_hsl(ch[2], ch[1], ch[0])
    return 1.0 - 0.8 * c.value >= c.saturation_v, c.value, c.hue / (2 * math.pi)


def split_by_hyper_hue(ch: Channels) -> tuple[Column, Column, Channels]:
    """(is gray, gray value, hyper-hue)."""
    mean = total(ch) / len(ch)
    part = F.sqrt(total([(c - mean) * (c - mean) for c in ch]) / len(ch))
    return F.least(F.lit(0.01), 0.125 * mean) > part, mean, [0.5 + 0.5 * (c - mean) for c in ch]


# ---------------------------------------------------------------- vectors as arrays


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vec_mul(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def vec_div(a: Column, k) -> Column:
    return F.transform(a, lambda x: x / k)
