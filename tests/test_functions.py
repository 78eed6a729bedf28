import colorsys
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import colors, masks
from lumenfold.functions import pixels as px

COLOURS = list(itertools.product([0.0, 0.2, 0.7, 1.0], [0.0, 0.35, 0.7, 1.0], [0.0, 0.2, 0.6, 1.0]))


def run(spark, rows, make):
    """make(channels) of each row of channel values."""
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} double" for k in range(len(rows[0]))))
    out = make([F.col(f"c{k}") for k in range(len(rows[0]))])
    return [tuple(r)[1:] for r in sorted(df.select("i", *[c.alias(f"o{k}") for k, c in enumerate(out)]).collect())]


def test_colours_both_ways(spark):
    got = run(spark, COLOURS, lambda ch: list(colors.rgb_to_hsv_hsl(*ch)))
    for (r, g, b), out in zip(COLOURS, got, strict=True):
        hue, sv, value, light, _ = out
        h, s, _ = colorsys.rgb_to_hsv(r, g, b)
        assert abs(hue - 2 * math.pi * h) < 1e-9 and abs(sv - s) < 1e-9 and value == max(r, g, b) and abs(light - (max(r, g, b) + min(r, g, b)) / 2) < 1e-12
        assert abs(colors.hue_of(r, g, b) - hue) < 1e-12
        assert np.allclose(colors.hsv_to_rgb(hue, sv, value), (r, g, b), atol=0.01)
    back = run(spark, [o[:3] for o in got], lambda ch: list(colors.hsv_to_rgb_columns(*ch)))
    assert np.allclose(back, COLOURS, atol=1e-9)
    assert colors.hsv_to_rgb(2 * math.pi, 1.0, 1.0) == (0.0, 0.0, 0.0)
    clamped = run(spark, [(2.0, -1.0, 0.5)], lambda ch: list(colors.rgb_to_hsv_hsl(*ch)))
    assert clamped == run(spark, [(1.0, 0.0, 0.5)], lambda ch: list(colors.rgb_to_hsv_hsl(*ch)))


def test_projections_equal_numpy(spark):
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.random((40, 4)), np.zeros((1, 4)), np.full((1, 4), 0.3)])
    mean = rows.mean(1, keepdims=True)
    part = rows - mean
    length = np.sqrt((part**2).sum(1, keepdims=True))
    assert np.allclose(run(spark, rows, px.hyper_hue), 0.5 + 0.5 * part)
    want = np.where(0.2**2 > length**2, 0.5, 0.5 + 0.5 * part / np.where(length > 0, length, 1))
    assert np.allclose(run(spark, rows, lambda ch: px.normalized_hyper_hue(ch, 0.2)), want)
    assert np.allclose(run(spark, rows, px.intensity)[:40], np.sqrt((rows[:40] ** 2).mean(1, keepdims=True)))
    below = rows[:, 0] + rows[:, 1]
    index = np.where(below == 0, 0, (rows[:, 0] - rows[:, 1]) / np.where(below == 0, 1, below))
    assert np.allclose(run(spark, rows, px.vegetation_index), np.stack([np.maximum(-index, 0), np.maximum(index, 0)], 1))
    assert np.allclose(run(spark, rows, lambda ch: px.select(ch, (2, 0, 0))), rows[:, [2, 0, 0]])
    assert np.allclose(run(spark, rows, lambda ch: px.scale(ch, [0.2] * 4, [0.5] * 4)), np.clip((rows - 0.2) / 0.5, 0, 1))


@pytest.mark.parametrize(("make", "width"), [(px.hue, 2), (px.vegetation_index, 1), (lambda ch: px.select(ch, (0, 1, 2)), 2), (lambda ch: px.select(ch, (3,)), 2), (px.split_by_hue, 2)])
def test_too_few_channels(spark, make, width):
    with pytest.raises(ValueError):
        make([F.lit(0.0)] * width)


def test_storage(spark):
    values = [[v] for v in (-0.2, 0.0, 0.4999 / 255, 0.5 / 255, 0.3, 1.0, 1.7)]
    assert [r[0] for r in run(spark, values, lambda ch: [px.raw(ch[0], "u8")])] == [0, 0, 0, 1, 77, 255, 255]
    assert run(spark, [[0.3]], lambda ch: [px.raw(ch[0], "u16")]) == [(19661.0,)]
    assert run(spark, [[0.1]], lambda ch: px.quantize(ch, "f32")) == [(float(np.float32(0.1)),)]
    assert run(spark, [[0.3]], lambda ch: px.quantize(ch, "u8")) == [(77 / 255,)]
    assert run(spark, [[51.0]], lambda ch: [px.normalized(ch[0], "u8")]) == [(0.2,)]


def test_gray_or_coloured(spark):
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.random((50, 3)), 0.5 + 0.01 * rng.random((20, 3)), np.zeros((1, 3))])
    got = run(spark, rows, lambda ch: (lambda s: [s[0].cast("double"), s[1], *s[2]])(px.split_by_hyper_hue(ch)))
    mean = rows.mean(1)
    size = np.sqrt(((rows - mean[:, None]) ** 2).mean(1))
    assert np.allclose([g[0] for g in got], np.minimum(0.01, 0.125 * mean) > size)
    assert np.allclose([g[1:] for g in got], np.column_stack([mean, 0.5 + 0.5 * (rows - mean[:, None])]))
    for (b, g, r), (gray, value, hue) in zip(rows, run(spark, rows, lambda ch: (lambda s: [s[0].cast("double"), s[1], s[2]])(px.split_by_hue(ch))), strict=True):
        top, low = max(r, g, b), min(r, g, b)
        assert bool(gray) == (1 - 0.8 * top >= ((top - low) / top if top else 0)) and value == top and abs(hue * 2 * math.pi - colors.hue_of(r, g, b)) < 1e-9


def test_vector_arithmetic(spark):
    made = run(spark, [(1.0, 2.0, 3.0, 5.0)], lambda c: [px.vec_add(F.array(c[0], c[1]), F.array(c[2], c[3])), px.vec_sub(F.array(c[0], c[1]), F.array(c[2], c[3])), px.vec_mul(F.array(c[0], c[1]), 4), px.vec_div(F.array(c[2], c[3]), 2)])
    assert made == [([4.0, 7.0], [-2.0, -3.0], [4.0, 8.0], [1.5, 2.5])]


def test_masks(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"))
    at = lambda m: {(r.x, r.y) for r in df.where(m).collect()}
    assert len(at(masks.everything())) == len(at(masks.all_of([]))) == len(at(masks.parse_mask(None))) == 400
    assert at(masks.half_plane(1, -2, 3)) == {(x, y) for x in range(20) for y in range(20) if x - 2 * y + 3 >= 0}
    # x1,y1 to x2,y2: dy x - dx y + y1 dx - x1 dy
    want = {(x, y) for x in range(20) for y in range(20) if 10 * x - 4 * y + 1 * 4 - 2 * 10 >= 0}
    assert at(masks.half_plane_through(2, 1, 6, 11)) == want
    assert at(masks.parse_mask("2,1,6,11, 0,5,19,5")) == {p for p in want if -19 * p[1] + 95 >= 0}
    with pytest.raises(ValueError):
        masks.parse_mask("1,2,3")
