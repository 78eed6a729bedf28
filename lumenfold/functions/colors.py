"""RGB, HSV and HSL, as column expressions and as plain Python for palettes."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class HsvHsl(NamedTuple):
    """Hue in radians [0, 2 pi], saturation and value of HSV, lightness and saturation of HSL."""

    hue: Column
    saturation_v: Column
    value: Column
    lightness: Column
    saturation_l: Column


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rgb_to_hsv_hsl(red: Column, green: Column, blue: Column) -> HsvHsl:
    """Inputs are clamped to [0, 1]; of equal largest channels red comes first, then green."""
    r, g, b = _unit(red), _unit(green), _unit(blue)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    safe = F.when(span > 0, span).otherwise(1.0)
    sixth = (
        F.when(span <= 0, 0.0)
        .when(r == top, F.when(g >= b, (g - b) / safe).otherwise((g - b) / safe + 6.0))
        .when(g == top, (b - r) / safe + 2.0)
        .otherwise((r - g) / safe + 4.0)
    )
    light = (top + low) / 2
    room = 1.0 - F.abs(2 * light - 1.0)
    return HsvHsl(
        sixth * (math.pi / 3),
        F.when(top > 0, span / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0),
        top,
        light,
        F.when((span > 0) & (room > 0), span / F.when(room > 0, room).otherwise(1.0)).otherwise(0.0),
    )


def hue_of(red: float, green: float, blue: float) -> float:
    """The hue in radians of one colour."""
    r, g, b = (min(1.0, max(0.0, c)) for c in (red, green, blue))
    top, low = max(r, g, b), min(r, g, b)
    if top <= low:
        return 0.0
    if r == top:
        sixth = (g - b) / (top - low)
        return (sixth + 6 if sixth < 0 else sixth) * math.pi / 3
    if g == top:
        return ((b - r) / (top - low) + 2) * math.pi / 3
    return ((r - g) / (top - low) + 4) * math.pi / 3


def hsv_to_rgb(hue: float, saturation: float, value: float) -> tuple[float, float, float]:
    """(red, green, blue) of a hue in radians; a hue of a whole turn adds only the gray part."""
    chroma, sextant = value * saturation, hue * 3 / math.pi
    second, gray = chroma * (1 - abs(sextant % 2 - 1)), value - chroma
    part = {0: (chroma, second, 0.0), 1: (second, chroma, 0.0), 2: (0.0, chroma, second), 3: (0.0, second, chroma), 4: (second, 0.0, chroma), 5: (chroma, 0.0, second)}.get(int(sextant), (0.0, 0.0, 0.0))
    return tuple(p + gray for p in part)


def hsv_to_rgb_columns(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """The same as column expressions."""
    chroma, sextant = value * saturation, hue * (3 / math.pi)
    second, gray = chroma * (1 - F.abs(sextant % 2 - 1)), value - chroma
    at, zero = F.floor(sextant), F.lit(0.0)

    def pick(*parts: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, part in reversed(list(enumerate(parts))):
            out = F.when(at == k, part).otherwise(out)
        return F.coalesce(out, zero) + gray

    return pick(chroma, second, zero, zero, second, chroma), pick(second, chroma, chroma, second, zero, zero), pick(zero, zero, second, chroma, chroma, second)
