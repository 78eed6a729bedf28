"""Queries over the star schema's tables, seen as pixels, and the same in DuckDB SQL.

Views: ``px4`` takes lineitem's quantity, price, discount and tax as four channels in [0, 1]; ``rgb``
the first three coordinates of embeddings, moved to [0, 1]; ``grid`` lays events out by their id.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors, masks
from ..functions import pixels as px
from ..operators import clustering as cl
from ..operators import otsu, palette
from ..operators.points import Points, assign_columns
from ..sources import images
from . import stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = " ".join(sql.split())
        return f

    return register


# ---------------------------------------------------------------- views

SCALES = (50.0, 105000.0, 0.1, 0.08)
PX4_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
KEYS = ("l_orderkey", "l_linenumber")
_SQL_PX4 = "px4 AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"least(1::DOUBLE, greatest(0::DOUBLE, {c} / {s}::DOUBLE)) AS c{i}" for i, (c, s) in enumerate(zip(PX4_COLUMNS, SCALES, strict=True))) + " FROM lineitem)"
_SQL_RGB = "rgb AS (SELECT vec_id, " + ", ".join(f"0.5::DOUBLE + 0.5::DOUBLE * embedding[{i + 1}]::DOUBLE AS c{i}" for i in range(3)) + " FROM embeddings)"
_SQL_GRID = "grid AS (SELECT event_id, event_id % 100 AS x, event_id // 100 AS y, least(1::DOUBLE, greatest(0::DOUBLE, value / 600::DOUBLE)) AS c0 FROM events)"

#: Fixed centers for the queries that need some.
CENTERS = ((0.1, 0.1, 0.2, 0.2), (0.5, 0.4, 0.5, 0.5), (0.9, 0.7, 0.8, 0.8), (0.3, 0.2, 0.9, 0.1), (0.7, 0.5, 0.1, 0.9))
PAINT = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (0.0, 1.0, 1.0))


def px4(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, px.Channels]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*KEYS, *[F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.lit(s))).alias(f"c{i}") for i, (c, s) in enumerate(zip(PX4_COLUMNS, SCALES, strict=True))])
    return rows, [F.col(f"c{i}") for i in range(4)]


def px4_points(spark: SparkSession, sf_dir: str) -> Points:
    rows, ch = px4(spark, sf_dir)
    # the key is not unique, so ties go by the whole row
    return Points.of(rows.withColumn("id", F.struct(*KEYS, *[f"c{i}" for i in range(4)])), ch)


def rgb(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, px.Channels]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[(0.5 + 0.5 * F.col("embedding").getItem(i).cast("double")).alias(f"c{i}") for i in range(3)])
    return rows, [F.col(f"c{i}") for i in range(3)]


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", (F.col("event_id") % 100).alias("x"), F.floor(F.col("event_id") / 100).alias("y"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.lit(600.0))).alias("c0"))


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).select(F.lit("events").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.array("c0").alias("v"))
    return stages.with_storage(rows, 1, "f32")


def six(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _six(sql: str) -> str:
    return f"round({sql}, 6) + 0::DOUBLE"


def _out(keys: Sequence[str], ch: px.Channels) -> list:
    return [*keys, *[six(c).alias(f"o{i}") for i, c in enumerate(ch)]]


def _sql_out(keys: Sequence[str], parts: Sequence[str]) -> str:
    return ", ".join([*keys, *[f"{_six(p)} AS o{i}" for i, p in enumerate(parts)]])


_K = ", ".join(KEYS)
_MEAN4 = "((c0 + c1 + c2 + c3) / 4)"
_SQUARE4 = "(" + " + ".join(f"(c{i} - {_MEAN4}) * (c{i} - {_MEAN4})" for i in range(4)) + ")"
_HUE_SQL = """CASE WHEN top = low THEN 0 WHEN r = top THEN CASE WHEN g >= b THEN (g - b) / (top - low) ELSE (g - b) / (top - low) + 6 END
  WHEN g = top THEN (b - r) / (top - low) + 2 ELSE (r - g) / (top - low) + 4 END * pi() / 3"""


def _sql_hsv(red: str, green: str, blue: str) -> str:
    """CTEs up to ``hsv`` with hue, sv, value, light, sl of the view rgb."""
    return f"""WITH {_SQL_RGB}, unit AS (SELECT *, least(1, greatest(0, {red})) AS r, least(1, greatest(0, {green})) AS g, least(1, greatest(0, {blue})) AS b FROM rgb),
      span AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM unit),
      hsv AS (SELECT *, {_HUE_SQL} AS hue, CASE WHEN top > 0 THEN (top - low) / top ELSE 0 END AS sv, top AS value, (top + low) / 2 AS light,
        CASE WHEN top > low AND 1 - abs(top + low - 1) > 0 THEN (top - low) / (1 - abs(top + low - 1)) ELSE 0 END AS sl FROM span)"""


# ---------------------------------------------------------------- projections


@query("select_channels", f"WITH {_SQL_PX4} SELECT {_sql_out(KEYS, ('c3', 'c0', 'c0'))} FROM px4")
def select_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*_out(KEYS, px.select(ch, (3, 0, 0))))


@query("hue", _sql_hsv("c0", "c1", "c2") + f" SELECT {_sql_out(('vec_id',), ('hue / (2 * pi())',))} FROM hsv")
def hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = rgb(spark, sf_dir)
    return rows.select(*_out(("vec_id",), px.hue(ch)))


@query("rgb_to_hsv_hsl", _sql_hsv("c0", "c1", "c2") + f" SELECT {_sql_out(('vec_id',), ('hue', 'sv', 'value', 'light', 'sl'))} FROM hsv")
def rgb_to_hsv_hsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = rgb(spark, sf_dir)
    return rows.select(*_out(("vec_id",), list(colors.rgb_to_hsv_hsl(*ch))))


@query("hsv_round_trip", f"WITH {_SQL_RGB} SELECT {_sql_out(('vec_id',), ('c0', 'c1', 'c2'))} FROM rgb")
def hsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To HSV and back gives the colour itself."""
    rows, ch = rgb(spark, sf_dir)
    c = colors.rgb_to_hsv_hsl(*ch)
    there = rows.select("vec_id", c.hue.alias("h"), c.saturation_v.alias("s"), c.value.alias("v"))
    return there.select(*_out(("vec_id",), list(colors.hsv_to_rgb_columns(F.col("h"), F.col("s"), F.col("v")))))


# eight decimals: quarters of these channels often end in a 5 at the seventh
@query("hyper_hue", f"WITH {_SQL_PX4} SELECT {_K}, {', '.join(f'round(0.5 + 0.5 * (c{i} - {_MEAN4}), 8) AS o{i}' for i in range(4))} FROM px4")
def hyper_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*KEYS, *[F.round(c, 8).alias(f"o{i}") for i, c in enumerate(px.hyper_hue(ch))])


@query(
    "normalized_hyper_hue",
    f"WITH {_SQL_PX4} SELECT {_sql_out(KEYS, [f'CASE WHEN 0.04 > {_SQUARE4} THEN 0.5 ELSE 0.5 + 0.5 * (c{i} - {_MEAN4}) / sqrt({_SQUARE4}) END' for i in range(4)])} FROM px4",
)
def normalized_hyper_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*_out(KEYS, px.normalized_hyper_hue(ch, 0.2)))


@query("intensity", f"WITH {_SQL_PX4} SELECT {_sql_out(KEYS, ['sqrt((c0*c0 + c1*c1 + c2*c2 + c3*c3) / 4)'])} FROM px4")
def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*_out(KEYS, px.intensity(ch)))


@query(
    "vegetation_index",
    f"""WITH {_SQL_PX4}, n AS (SELECT *, CASE WHEN c0 + c1 = 0 THEN 0 ELSE (c0 - c1) / (c0 + c1) END AS n FROM px4)
    SELECT {_sql_out(KEYS, ['greatest(-n, 0)', 'greatest(n, 0)'])} FROM n""",
)
def vegetation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*_out(KEYS, px.vegetation_index(ch)))


@query("quantize_u8", f"WITH {_SQL_PX4} SELECT {_K}, " + ", ".join(f"CAST(least(255, greatest(0, floor(c{i} * 255 + 0.5))) AS INTEGER) AS o{i}" for i in range(4)) + " FROM px4")
def quantize_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return rows.select(*KEYS, *[px.raw(c, "u8").cast("int").alias(f"o{i}") for i, c in enumerate(ch)])


@query("vector_arithmetic", f"WITH {_SQL_PX4} SELECT {_sql_out(KEYS, ['c0 + c2', 'c1 + c3', 'c0 - c2', 'c1 - c3', 'c0 * 3', 'c1 * 3', 'c0 / 7', 'c1 / 7'])} FROM px4")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    a, b = F.array(ch[0], ch[1]), F.array(ch[2], ch[3])
    made = rows.select(*KEYS, F.concat(px.vec_add(a, b), px.vec_sub(a, b), px.vec_mul(a, 3), px.vec_div(a, 7)).alias("v"))
    return made.select(*_out(KEYS, px.channels(F.col("v"), 8)))


# ---------------------------------------------------------------- masks and splits

LINES = ((10.0, 0.0, 90.0, 300.0), (0.0, 100.0, 100.0, 0.0))


def _sql_line(x1: float, y1: float, x2: float, y2: float) -> str:
    return f"({y2 - y1} * x + {x1 - x2} * y + {y1 * (x2 - x1) - x1 * (y2 - y1)} >= 0)"


@query("mask_half_planes", f"WITH {_SQL_GRID} SELECT event_id, x, y FROM grid WHERE {' AND '.join(_sql_line(*line) for line in LINES)}")
def mask_half_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where(masks.parse_mask(",".join(str(v) for line in LINES for v in line))).select("event_id", "x", "y")


@query("split_by_hue", _sql_hsv("c2", "c1", "c0") + f" SELECT vec_id, 1 - 0.8 * value >= sv AS gray, {_six('CASE WHEN 1 - 0.8 * value >= sv THEN value ELSE hue / (2 * pi()) END')} AS o0 FROM hsv")
def split_by_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = rgb(spark, sf_dir)
    gray, value, share = px.split_by_hue(ch)
    return rows.select("vec_id", gray.alias("gray"), six(F.when(gray, value).otherwise(share)).alias("o0"))


_MEAN3 = "((c0 + c1 + c2) / 3)"
_PART3 = "sqrt((" + " + ".join(f"(c{i} - {_MEAN3}) * (c{i} - {_MEAN3})" for i in range(3)) + ") / 3)"


@query(
    "split_by_hyper_hue",
    f"WITH {_SQL_RGB} SELECT vec_id, least(0.01::DOUBLE, 0.125::DOUBLE * {_MEAN3}) > {_PART3} AS gray, {_six(_MEAN3)} AS value, {', '.join(f'{_six(f'0.5 + 0.5 * (c{i} - {_MEAN3})')} AS o{i}' for i in range(3))} FROM rgb",
)
def split_by_hyper_hue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = rgb(spark, sf_dir)
    gray, value, color = px.split_by_hyper_hue(ch)
    return rows.select("vec_id", gray.alias("gray"), six(value).alias("value"), *[six(c).alias(f"o{i}") for i, c in enumerate(color)])


# ---------------------------------------------------------------- fits


@query(
    "normalize_min_max",
    f"""WITH {_SQL_GRID}, m AS (SELECT max(c0) AS hi, min(c0) AS lo FROM grid WHERE {_sql_line(*LINES[0])})
    SELECT event_id, {_six('least(1::DOUBLE, greatest(0::DOUBLE, (c0 - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END))')} AS o0 FROM grid, m""",
)
def normalize_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir)
    ranges = stages.min_max_ranges(rows.where(masks.half_plane_through(*LINES[0])).select(F.array("c0").alias("v")), 1)
    return rows.select("event_id", *[six(c).alias("o0") for c in px.scale([F.col("c0")], ranges.lows, ranges.lengths)])


@query(
    "normalize_deviation",
    f"""WITH {_SQL_PX4}, m AS (SELECT {', '.join(f'avg(c{i}) AS m{i}, stddev_pop(c{i}) AS s{i}' for i in range(4))} FROM px4),
    r AS (SELECT {', '.join(f'greatest(0::DOUBLE, m{i} - 1.5 * s{i}) AS lo{i}, least(1::DOUBLE, m{i} + 1.5 * s{i}) AS hi{i}' for i in range(4))} FROM m)
    SELECT {_sql_out(KEYS, [f'least(1::DOUBLE, greatest(0::DOUBLE, (c{i} - lo{i}) / CASE WHEN hi{i} > lo{i} THEN hi{i} - lo{i} ELSE 1 END))' for i in range(4)])} FROM px4, r""",
)
def normalize_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    ranges = stages.deviation_ranges(rows.select(F.array(*ch).alias("v")), 4, 1.5)
    return rows.select(*_out(KEYS, px.scale(ch, ranges.lows, ranges.lengths)))


_SQL_HISTOGRAM = f"""{_SQL_GRID}, lim AS (SELECT min(c0) AS lo, nextafter(max(c0), 'inf'::DOUBLE) AS hi FROM grid),
  edge AS (SELECT i, ((16 - i) * lo + i * hi) / 16 AS e FROM lim, range(17) AS t(i)),
  bins AS (SELECT a.i AS bin, count(g.c0) AS n, coalesce(sum(g.c0), 0) AS sum1, coalesce(sum(g.c0 * g.c0), 0) AS sum2
    FROM edge a JOIN edge b ON b.i = a.i + 1 LEFT JOIN grid g ON g.c0 >= a.e AND g.c0 < b.e GROUP BY a.i)"""


@query("histogram_moments", f"WITH {_SQL_HISTOGRAM} SELECT bin, n, {_six('sum1')} AS sum1, {_six('sum2')} AS sum2 FROM bins")
def histogram_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = otsu.histogram(grid_points(spark, sf_dir), 16)
    rows = [(i, n, a, b) for i, (n, a, b) in enumerate(zip(h.counts, h.first, h.second, strict=True))]
    return spark.createDataFrame(rows, "bin long, n long, sum1 double, sum2 double").select("bin", "n", six(F.col("sum1")).alias("sum1"), six(F.col("sum2")).alias("sum2"))


def grid_points(spark: SparkSession, sf_dir: str) -> Points:
    return Points.of(grid(spark, sf_dir), [F.col("c0")], "event_id")


_SQL_COST = """cost AS (SELECT a.i AS a, b.i AS b, CASE WHEN sum(n) = 0 THEN 0 ELSE greatest(0, sum(sum2) / sum(n) - (sum(sum1) / sum(n)) * (sum(sum1) / sum(n))) END AS c
    FROM range(16) AS a(i) JOIN range(17) AS b(i) ON a.i < b.i JOIN bins ON bin >= a.i AND bin < b.i GROUP BY a.i, b.i)"""


@query(
    "otsu_linear",
    f"""WITH {_SQL_HISTOGRAM}, {_SQL_COST},
    best AS (SELECT x.b AS t1, y.b AS t2, round(x.c + y.c + z.c, 9) AS err FROM cost x JOIN cost y ON y.a = x.b JOIN cost z ON z.a = y.b WHERE x.a = 0 AND z.b = 16 ORDER BY err, t1, t2 LIMIT 1),
    cuts AS (SELECT 0 AS k, 0 AS a, t1 AS b, err FROM best UNION ALL SELECT 1, t1, t2, err FROM best UNION ALL SELECT 2, t2, 16, err FROM best)
    SELECT k AS cluster, {_six('l.e')} AS low, {_six('h.e')} AS high, {_six('err')} AS error FROM cuts JOIN edge l ON l.i = a JOIN edge h ON h.i = b""",
)
def otsu_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = otsu.linear(16, 3)(grid_points(spark, sf_dir))
    rows = [(k, c[0][0], c[1][0], found.error) for k, c in enumerate(found.centers)]
    return spark.createDataFrame(rows, "cluster int, low double, high double, error double").select("cluster", *[six(F.col(c)).alias(c) for c in ("low", "high", "error")])


@query(
    "otsu_circular",
    f"""WITH {_SQL_HISTOGRAM}, turned AS (SELECT s.i AS s, (bin + s.i) % 16 AS p, n FROM bins, range(16) AS s(i)),
    cost AS (SELECT s, a.i AS a, b.i AS b, CASE WHEN sum(n) = 0 THEN 0 ELSE greatest(0, sum(n * p * p) / sum(n) - (sum(n * p) / sum(n)) * (sum(n * p) / sum(n))) END AS c
      FROM turned JOIN range(16) AS a(i) ON p >= a.i JOIN range(17) AS b(i) ON p < b.i GROUP BY s, a.i, b.i),
    best AS (SELECT x.s, x.b AS t, round(x.c + y.c, 9) AS err FROM cost x JOIN cost y ON y.a = x.b AND x.s = y.s WHERE x.a = 0 AND y.b = 16 ORDER BY err, x.s, t LIMIT 1)
    SELECT CAST(s AS INTEGER) AS rotation, CAST(t AS INTEGER) AS threshold, {_six('err')} AS error FROM best""",
)
def otsu_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rotation and threshold of two classes, told from the class that holds the first edge."""
    h = otsu.histogram(grid_points(spark, sf_dir), 16)
    tried = [(round(e, otsu.ROUND), s, cuts[0]) for s in range(16) for e, cuts in [otsu.thresholds(h.rotated(s), 2)]]
    error, rotation, cut = min(tried)
    return spark.createDataFrame([(rotation, cut, error)], "rotation int, threshold int, error double").withColumn("error", six(F.col("error")))


# ---------------------------------------------------------------- nearest centers


def _sql_d2(center: Sequence[float]) -> str:
    return "(" + " + ".join(f"({c}::DOUBLE - c{i}) * ({c}::DOUBLE - c{i})" for i, c in enumerate(center)) + ")"


def _sql_near(source: str, centers: Sequence[Sequence[float]] = CENTERS) -> str:
    d = ", ".join(f"{_sql_d2(c)} AS q{i}" for i, c in enumerate(centers))
    names = [f"q{i}" for i in range(len(centers))]
    which = " ".join(f"WHEN {n} = least({', '.join(names)}) THEN {i}" for i, n in enumerate(names))
    return f"dist AS (SELECT *, {d} FROM {source}), near AS (SELECT *, CASE {which} END AS cid, least({', '.join(names)}) AS d2 FROM dist)"


@query("nearest_center", f"WITH {_SQL_PX4}, {_sql_near('px4')} SELECT {_K}, cid, {_six('d2')} AS d2 FROM near")
def nearest_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return assign_columns(rows, ch, CENTERS).select(*KEYS, "cid", six(F.col("d2")).alias("d2"))


@query("recolor", f"WITH {_SQL_PX4}, {_sql_near('px4')} SELECT {_K}, " + ", ".join("CAST(CASE cid " + " ".join(f"WHEN {i} THEN {int(255 * p[d])}" for i, p in enumerate(PAINT)) + f" END AS INTEGER) AS o{d}" for d in range(3)) + " FROM near")
def recolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    clusters = cl.Clusters(tuple((c,) for c in CENTERS), 0.0)
    painted = stages._recolored(rows, ch, clusters, list(PAINT), "v")
    return painted.select(*KEYS, *[px.raw(c, "u8").cast("int").alias(f"o{i}") for i, c in enumerate(px.channels(F.col("v"), 3))])


@query("cluster_statistics", f"WITH {_SQL_PX4}, {_sql_near('px4')} SELECT cid, count(*) AS n, {_six('sum(d2)')} AS distance, " + ", ".join(f"{_six(f'avg(c{i})')} AS mean{i}, {_six(f'stddev_pop(c{i})')} AS dev{i}" for i in range(4)) + " FROM near GROUP BY cid")
def cluster_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Lloyd step, with deviations: what each iteration gathers."""
    rows, ch = px4(spark, sf_dir)
    near = assign_columns(rows, ch, CENTERS)
    figures = [f(c).alias(f"{n}{i}") for i, c in enumerate(ch) for n, f in (("mean", lambda c: six(F.avg(c))), ("dev", lambda c: six(F.stddev_pop(c))))]
    return near.groupBy("cid").agg(F.count("*").alias("n"), six(F.sum("d2")).alias("distance"), *figures)


@query("bounds_and_sums", f"WITH {_SQL_PX4} " + " UNION ALL ".join(f"SELECT {i} AS dim, {_six(f'min(c{i})')} AS low, {_six(f'max(c{i})')} AS high, {_six(f'sum(c{i})')} AS total FROM px4" for i in range(4)))
def bounds_and_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = px4_points(spark, sf_dir)
    low, high = points.bounds()
    rows = [(i, *r) for i, r in enumerate(zip(low, high, points.sums(), strict=True))]
    return spark.createDataFrame(rows, "dim int, low double, high double, total double").select("dim", *[six(F.col(c)).alias(c) for c in ("low", "high", "total")])


def _centers(spark: SparkSession, vectors: Sequence[Sequence[float]], error: float | None = None) -> DataFrame:
    rows = [(k, *map(float, v)) for k, v in enumerate(sorted(vectors))]
    df = spark.createDataFrame(rows, "cluster int, " + ", ".join(f"x{i} double" for i in range(len(vectors[0]))))
    df = df.select("cluster", *[six(F.col(f"x{i}")).alias(f"x{i}") for i in range(len(vectors[0]))])
    return df if error is None else df.withColumn("error", six(F.lit(float(error))))


def _sql_means(step: str, source: str) -> str:
    return f"{step} AS (SELECT row_number() OVER (ORDER BY x0, x1, x2, x3) - 1 AS k, * FROM (SELECT DISTINCT {', '.join(f'avg(c{i}) AS x{i}' for i in range(4))}, sum(sum(d2)) OVER () AS err FROM {source} GROUP BY cid))"


def _sql_step(step: str, centers: str) -> str:
    """Rows of px4 with the nearest of the centers (k, x0..x3)."""
    d = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(4))
    return f"{step} AS (SELECT rid, c0, c1, c2, c3, min(d) AS d2, arg_min(k, (d, k)) AS cid FROM (SELECT p.*, k, {d} AS d FROM (SELECT row_number() OVER () AS rid, * FROM px4) p, {centers}) GROUP BY ALL)"


@query(
    "k_means_two_steps",
    f"""WITH {_SQL_PX4}, z AS (SELECT * FROM (VALUES {', '.join(f'({k}, ' + ', '.join(f'{x}::DOUBLE' for x in c) + ')' for k, c in enumerate(sorted(CENTERS)))}) AS t(k, x0, x1, x2, x3)),
    {_sql_step('a', 'z')}, {_sql_means('m', 'a')}, {_sql_step('b', 'm')}, {_sql_means('r', 'b')}
    SELECT CAST(k AS INTEGER) AS cluster, {', '.join(f'{_six(f"x{i}")} AS x{i}' for i in range(4))}, {_six('err')} AS error FROM r""",
)
def k_means_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = lambda points, k, more: sorted(CENTERS)
    found = cl.k_means(5, 0.0, start, 2)(px4_points(spark, sf_dir))
    return _centers(spark, found.vectors, found.error)


def _sql_far(score: str) -> str:
    return f"SELECT 0 AS cluster, {', '.join(f'{_six(f"c{i}")} AS x{i}' for i in range(4))} FROM dist WHERE least(d0, d1, d2, d3, d4) > 0 ORDER BY {score} DESC, l_orderkey, l_linenumber, c0, c1, c2, c3 LIMIT 1"


_SQL_DIST = f"WITH {_SQL_PX4}, dist AS (SELECT *, {', '.join(f'{_sql_d2(c)} AS d{i}' for i, c in enumerate(CENTERS))} FROM px4) "


@query("farthest_sum", _SQL_DIST + _sql_far("d0 + d1 + d2 + d3 + d4"))
def farthest_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, [px4_points(spark, sf_dir).farthest(CENTERS)])


@query("farthest_maximin", _SQL_DIST + _sql_far("least(d0, d1, d2, d3, d4)"))
def farthest_maximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, [px4_points(spark, sf_dir).farthest(CENTERS, maximin=True)])


_FAR = " + ".join("(c{0} - {1}.x{0}) * (c{0} - {1}.x{0})".format(i, "{0}") for i in range(4))


@query(
    "mean_and_farthest",
    f"""WITH {_SQL_PX4}, a AS (SELECT {', '.join(f'avg(c{i}) AS x{i}' for i in range(4))} FROM px4),
    b AS (SELECT c0 AS x0, c1 AS x1, c2 AS x2, c3 AS x3 FROM px4, a ORDER BY {_FAR.format('a')} DESC, {_K} LIMIT 1),
    c AS (SELECT c0 AS x0, c1 AS x1, c2 AS x2, c3 AS x3 FROM px4, a, b WHERE {_FAR.format('b')} > 0 ORDER BY {_FAR.format('a')} + {_FAR.format('b')} DESC, {_K} LIMIT 1)
    SELECT CAST(row_number() OVER (ORDER BY x0, x1, x2, x3) - 1 AS INTEGER) AS cluster, {', '.join(f'{_six(f"x{i}")} AS x{i}' for i in range(4))} FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def mean_and_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centers(spark, cl.mean_and_farthest()(px4_points(spark, sf_dir), 3, cl.farthest()))


# ---------------------------------------------------------------- parts of ISODATA

LUMP = 0.6


@query(
    "isodata_lump_pairs",
    f"""WITH {_SQL_PX4}, {_sql_near('px4')}, m AS (SELECT cid, count(*) AS n, {', '.join(f'avg(c{i}) AS x{i}' for i in range(4))} FROM near GROUP BY cid),
    g AS (SELECT row_number() OVER (ORDER BY x0, x1, x2, x3) - 1 AS k, * FROM m)
    SELECT CAST(a.k AS INTEGER) AS a, CAST(b.k AS INTEGER) AS b, {_six(' + '.join(f'(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})' for i in range(4)))} AS d2 FROM g a JOIN g b ON a.k < b.k
    WHERE {' + '.join(f'(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})' for i in range(4))} < {LUMP} ORDER BY {' + '.join(f'(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})' for i in range(4))}, a.k, b.k LIMIT 3""",
)
def isodata_lump_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = px4_points(spark, sf_dir).cluster_sums(CENTERS)
    groups = [cl._Group(c) for c in sorted(tuple(v / s[0] for v in s[1]) for s in sums.values())]
    rows = [(i, j, sum((x - y) ** 2 for x, y in zip(groups[i].center, groups[j].center, strict=True))) for i, j in cl.lump_pairs(groups, LUMP, 3)]
    return spark.createDataFrame(rows, "a int, b int, d2 double").withColumn("d2", six(F.col("d2")))


@query(
    "isodata_split_candidates",
    f"""WITH {_SQL_PX4}, {_sql_near('px4')}, s AS (SELECT cid, count(*) AS n, {' + '.join(f'var_pop(c{i})' for i in range(4))} AS dist, greatest({', '.join(f'stddev_pop(c{i})' for i in range(4))}) AS sigma FROM near GROUP BY cid),
    o AS (SELECT sum(n * dist) / sum(n) AS overall FROM s) SELECT cid, n, {_six('dist')} AS distance, {_six('sigma')} AS sigma FROM s, o WHERE sigma > 0.1 AND dist > overall""",
)
def isodata_split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = px4_points(spark, sf_dir).cluster_sums(CENTERS, squares=True)
    found = []
    for cid, (n, total, _, squares) in sums.items():
        var = [max(0.0, q / n - (t / n) ** 2) for t, q in zip(total, squares, strict=True)]
        found.append((cid, n, sum(var), math.sqrt(max(var))))
    overall = sum(n * d for _, n, d, _ in found) / max(1, sum(n for _, n, _, _ in found))
    rows = [r for r in found if r[3] > 0.1 and r[2] > overall]
    return spark.createDataFrame(rows, "cid int, n long, distance double, sigma double").select("cid", "n", six(F.col("distance")).alias("distance"), six(F.col("sigma")).alias("sigma"))


@query(
    "isodata_split",
    f"""WITH {_SQL_PX4}, {_sql_near('px4')}, s AS (SELECT cid, count(*) AS n, {' + '.join(f'var_pop(c{i})' for i in range(4))} AS dist, {', '.join(f'avg(c{i}) AS x{i}, stddev_pop(c{i}) AS s{i}' for i in range(4))} FROM near GROUP BY cid),
    w AS (SELECT *, greatest(s0, s1, s2, s3) AS sigma, sum(n * dist) OVER () / sum(n) OVER () AS overall, sum(n) OVER () AS total FROM s),
    f AS (SELECT *, sigma > 0.1 AND dist > overall AND n > 2 * (floor(0.05 * total) + 1) AS wide, CASE sigma WHEN s0 THEN 0 WHEN s1 THEN 1 WHEN s2 THEN 2 ELSE 3 END AS axis FROM w),
    r AS (SELECT {', '.join(f'x{i} + CASE WHEN wide AND axis = {i} THEN side * sigma ELSE 0 END AS x{i}' for i in range(4))} FROM f JOIN (VALUES (1), (-1)) AS t(side) ON wide OR side = 1)
    SELECT CAST(row_number() OVER (ORDER BY x0, x1, x2, x3) - 1 AS INTEGER) AS cluster, {', '.join(f'{_six(f"x{i}")} AS x{i}' for i in range(4))} FROM r""",
)
def isodata_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One splitting step over the groups of a pass."""
    sums, groups = px4_points(spark, sf_dir).cluster_sums(CENTERS, squares=True), []
    for n, total, _, squares in sums.values():
        center = tuple(t / n for t in total)
        var = [max(0.0, q / n - m * m) for q, m in zip(squares, center, strict=True)]
        groups.append(cl._Group(center, n, sum(var), tuple(math.sqrt(v) for v in var)))
    every = sum(g.size for g in groups)
    made, _ = cl.split_up(groups, sum(g.size * g.distance for g in groups) / every, cl.IsodataSettings(5, 6, std_deviation=0.1), int(0.05 * every))
    return _centers(spark, [g.center for g in made])


# ---------------------------------------------------------------- single operators


@query("deviation_about_mean", f"WITH {_SQL_PX4} " + " UNION ALL ".join(f"SELECT {i} AS dim, {_six(f'sqrt(avg((c{i} - {m}::DOUBLE) * (c{i} - {m}::DOUBLE)))')} AS given, {_six(f'stddev_pop(c{i})')} AS own FROM px4" for i, m in enumerate(CENTERS[1])))
def deviation_about_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around a given vector and around the points' own mean."""
    points = px4_points(spark, sf_dir)
    rows = [(i, *r) for i, r in enumerate(zip(points.deviation(CENTERS[1]), points.deviation(), strict=True))]
    return spark.createDataFrame(rows, "dim int, given double, own double").select("dim", six(F.col("given")).alias("given"), six(F.col("own")).alias("own"))


@query("widest_dimension", f"WITH {_SQL_PX4}, s AS (" + " UNION ALL ".join(f"SELECT {i} AS dim, max(c{i}) - min(c{i}) AS span FROM px4" for i in range(4)) + ") SELECT dim FROM s ORDER BY span DESC, dim LIMIT 1")
def widest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(px4_points(spark, sf_dir).widest_dimension(),)], "dim int")


@query("mask_everything", f"WITH {_SQL_GRID} SELECT event_id, x, y FROM grid")
def mask_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where(masks.everything() & masks.parse_mask(" ")).select("event_id", "x", "y")


#: so many centers that their distances are not unrolled
MANY = [tuple(((k * (7 + 4 * d)) % 161) / 161 for d in range(4)) for k in range(160)]


@query(
    "nearest_of_many",
    f"""WITH {_SQL_PX4}, m AS (SELECT * FROM (VALUES {', '.join(f'({k}, ' + ', '.join(f'{x!r}::DOUBLE' for x in c) + ')' for k, c in enumerate(MANY))}) AS t(k, x0, x1, x2, x3)),
    p AS (SELECT row_number() OVER () AS rid, * FROM px4),
    n AS (SELECT rid, {_K}, min(d) AS d2 FROM (SELECT p.*, {' + '.join(f'(x{i} - c{i}) * (x{i} - c{i})' for i in range(4))} AS d FROM p, m) GROUP BY rid, {_K}) SELECT {_K}, {_six('d2')} AS d2 FROM n""",
)
def nearest_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = px4(spark, sf_dir)
    return assign_columns(rows, ch, MANY).select(*KEYS, six(F.col("d2")).alias("d2"))


@query(
    "otsu_circular_classes",
    f"""WITH {_SQL_HISTOGRAM}, turned AS (SELECT s.i AS s, (bin + s.i) % 16 AS p, n FROM bins, range(16) AS s(i)),
    cost AS (SELECT s, a.i AS a, b.i AS b, CASE WHEN sum(n) = 0 THEN 0 ELSE greatest(0, sum(n * p * p) / sum(n) - (sum(n * p) / sum(n)) * (sum(n * p) / sum(n))) END AS c
      FROM turned JOIN range(16) AS a(i) ON p >= a.i JOIN range(17) AS b(i) ON p < b.i GROUP BY s, a.i, b.i),
    best AS (SELECT x.s, x.b AS t, y.b AS u, round(x.c + y.c + z.c, 9) AS err FROM cost x JOIN cost y ON y.a = x.b AND x.s = y.s JOIN cost z ON z.a = y.b AND z.s = x.s WHERE x.a = 0 AND z.b = 16 ORDER BY err, x.s, t, u LIMIT 1),
    cuts AS (SELECT 0 AS cluster, 0 AS a, t AS b, s FROM best UNION ALL SELECT 1, t, u, s FROM best UNION ALL SELECT 2, u, 16, s FROM best),
    spans AS (SELECT cluster, (a - s + 16) % 16 AS a, 1 + (b - s + 15) % 16 AS b FROM cuts),
    parts AS (SELECT cluster, part, v FROM spans, (VALUES (0), (1), (2), (3)) AS p(part), LATERAL (SELECT CASE WHEN a < b THEN CASE part WHEN 0 THEN a WHEN 1 THEN b END ELSE CASE part WHEN 0 THEN 0 WHEN 1 THEN b WHEN 2 THEN a ELSE 16 END END AS v))
    SELECT CAST(cluster AS INTEGER) AS cluster, CAST(part AS INTEGER) AS part, {_six('e')} AS value FROM parts JOIN edge ON edge.i = v""",
)
def otsu_circular_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three classes on a circle; the one that runs through the end has four vectors."""
    found = otsu.circular(16, 3)(grid_points(spark, sf_dir))
    rows = [(k, i, v[0]) for k, c in enumerate(found.centers) for i, v in enumerate(c)]
    return spark.createDataFrame(rows, "cluster int, part int, value double").withColumn("value", six(F.col("value")))


def _scratch(spark: SparkSession) -> str:
    """A folder of its own where the session's tasks can read and write."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/images-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp()


def _image_file(kind: str, blocks: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = f"{_scratch(spark)}/grid.{kind}"
        pixels = grid_pixels(spark, sf_dir)
        images.write_image(pixels.withColumn("v", F.array(F.lit(1.0))), at)  # overwritten by the next line
        images.write_image(pixels, at)
        return images.read_images(spark, at, blocks).select("y", "x", F.round(F.element_at("v", 1) * 255).cast("int").alias("stored"))

    return run


_SQL_FILE = f"""WITH {_SQL_GRID}, size AS (SELECT max(x) AS w, max(y) AS h FROM grid), place AS (SELECT py.i AS y, px.i AS x FROM size, range(0, 100000) AS py(i), range(0, 100) AS px(i) WHERE py.i <= h AND px.i <= w)
  SELECT CAST(place.y AS INTEGER) AS y, CAST(place.x AS INTEGER) AS x, CAST(coalesce(least(255, floor(255 * c0 + 0.5)), 0) AS INTEGER) AS stored FROM place LEFT JOIN grid ON grid.x = place.x AND grid.y = place.y"""
for _kind, _blocks in (("tiff", 1), ("tiff", 3), ("png", 2), ("bmp", 1)):
    query(f"{_kind}_file_in_{_blocks}", _SQL_FILE)(_image_file(_kind, _blocks))


# ---------------------------------------------------------------- whole clusterings

_P = "p AS (SELECT row_number() OVER () AS rid, * FROM px4)"


def _sql_starts(most: int, maximin: bool = False, name: str = "f") -> str:
    """CTEs f0 (the mean) to f{most - 1}, each the farthest point from those before, as lists of four."""
    out = [f"{name}0 AS (SELECT [{', '.join(f'avg(c{i})' for i in range(4))}] AS v FROM px4)"]
    for k in range(1, most):
        d = [f"({' + '.join(f'(c{i} - {name}{j}.v[{i + 1}]) * (c{i} - {name}{j}.v[{i + 1}])' for i in range(4))})" for j in range(k)]
        least = f"least({', '.join(d)})" if k > 1 else d[0]
        score = least if maximin else " + ".join(d)
        out.append(f"{name}{k} AS (SELECT [c0, c1, c2, c3] AS v FROM px4, {', '.join(f'{name}{j}' for j in range(k))} WHERE {least} > 0 ORDER BY {score} DESC, {_K}, c0, c1, c2, c3 LIMIT 1)")
    return ", ".join(out)


def _sql_k_means(k: int, name: str, starts: str = "f") -> str:
    """CTEs that end in ``name`` (cs, err): Lloyd's passes until the error falls by less than 5 %."""
    d = " + ".join(f"(cs[k][{i + 1}] - c{i}) * (cs[k][{i + 1}] - c{i})" for i in range(4))
    first = f"SELECT 0 AS it, list_sort([{', '.join(f'{starts}{j}.v' for j in range(k))}]) AS cs, 'inf'::DOUBLE AS err, false AS done FROM {', '.join(f'{starts}{j}' for j in range(k))}"
    near = f"SELECT it, err, rid, c0, c1, c2, c3, min(d) AS d2, arg_min(k, (d, k)) AS cid FROM (SELECT it, err, p.*, k, {d} AS d FROM {name}_s, p, range(1, {k + 1}) AS t(k) WHERE NOT done) GROUP BY ALL"
    means = f"SELECT it, err, cid, {', '.join(f'avg(c{i}) AS m{i}' for i in range(4))}, sum(d2) AS sd FROM ({near}) GROUP BY it, err, cid"
    step = f"SELECT it + 1, list_sort(list_distinct(list([m0, m1, m2, m3]))), sum(sd), err * 0.95 <= sum(sd) FROM ({means}) GROUP BY it, err"
    return f"{name}_s AS ({first} UNION ALL {step}), {name} AS (SELECT cs, err FROM {name}_s WHERE done)"


def _sql_result(name: str) -> str:
    return f"SELECT CAST(k - 1 AS INTEGER) AS cluster, {', '.join(f'{_six(f"cs[k][{i + 1}]")} AS x{i}' for i in range(4))}, {_six('err')} AS error FROM {name}, range(1, len(cs) + 1) AS t(k)"


def _sql_elbow(least: int, most: int) -> str:
    tried = ", ".join(_sql_k_means(k, f"k{k}") for k in range(least, most + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, cs, err FROM k{k}" for k in range(least, most + 1))
    stops = "last AS (SELECT min(a.k) AS k FROM every a LEFT JOIN every b ON b.k = a.k + 1 WHERE b.k IS NULL OR NOT a.err * 0.95 > b.err)"
    return f"WITH RECURSIVE {_SQL_PX4}, {_P}, {_sql_starts(most)}, {tried}, every AS ({every}), {stops}, chosen AS (SELECT cs, err FROM every JOIN last USING (k)) {_sql_result('chosen')}"


def _clustered(strategy: Callable[[], cl.Strategy]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = cl.with_persisted(strategy())(px4_points(spark, sf_dir))
        return _centers(spark, found.vectors, found.error)

    return run


#: No SQL where starts are random or approximate medians, or where ISODATA's course depends on what each pass finds.
for _name, _strategy, _sql in (
    ("k_means", lambda: cl.k_means(4), f"WITH RECURSIVE {_SQL_PX4}, {_P}, {_sql_starts(4)}, {_sql_k_means(4, 'r')} {_sql_result('r')}"),
    ("k_means_maximin", lambda: cl.k_means(4, initial=cl.mean_and_farthest(maximin=True), more=cl.farthest(maximin=True)), f"WITH RECURSIVE {_SQL_PX4}, {_P}, {_sql_starts(4, True)}, {_sql_k_means(4, 'r')} {_sql_result('r')}"),
    ("k_means_kd_tree", lambda: cl.k_means(4, initial=cl.kd_tree_centers(max_leaf=512)), None),
    ("k_means_random", lambda: cl.k_means(4, initial=cl.random_centers(3), more=cl.random_replacement(3)), None),
    ("elbow", lambda: cl.elbow(0.95, 8, 2, cl.k_means), _sql_elbow(2, 8)),
    ("best_of", lambda: cl.best([cl.k_means(4), cl.k_means(4, initial=cl.random_centers(5))]), None),
    (
        "best_of_starts",
        lambda: cl.best([cl.k_means(4), cl.k_means(4, initial=cl.mean_and_farthest(maximin=True))]),
        f"""WITH RECURSIVE {_SQL_PX4}, {_P}, {_sql_starts(4)}, {_sql_starts(4, True, 'g')}, {_sql_k_means(4, 'a')}, {_sql_k_means(4, 'b', 'g')},
        chosen AS (SELECT cs, err FROM (SELECT 0 AS k, * FROM a UNION ALL SELECT 1, * FROM b) ORDER BY err, k LIMIT 1) {_sql_result('chosen')}""",
    ),
    ("isodata", lambda: cl.isodata(cl.IsodataSettings(3, 6, max_iterations=8, lumping=0.1, std_deviation=0.2)), None),
):
    query(_name, _sql)(_clustered(_strategy))


def _painted(pixels: DataFrame, plan: Pipeline) -> DataFrame:
    out = plan.fit(pixels).transform(pixels)
    dims, _ = stages.shape_of(out)
    return out.select("image_id", "y", "x", *[px.raw(c, "u8").cast("int").alias(f"o{i}") for i, c in enumerate(px.channels(F.col("v"), dims))])


@query("cluster_image")
def cluster_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, cluster, paint: a whole plan over the grid."""
    mask = masks.half_plane_through(*LINES[0])
    return _painted(grid_pixels(spark, sf_dir), Pipeline(stages=[stages.Normalize(mask, 3.0), stages.Cluster(cl.k_means(3), palette.false_grays(1), mask)]))


@query("saturation_cluster_image")
def saturation_cluster_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ch = rgb(spark, sf_dir)
    pixels = rows.select(F.lit("rgb").alias("image_id"), F.floor(F.col("vec_id") / 64).cast("int").alias("y"), (F.col("vec_id") % 64).cast("int").alias("x"), F.array(*ch).alias("v"))
    return _painted(stages.with_storage(pixels, 3, "u8"), Pipeline(stages=[stages.SaturationCluster("hyper-hue", cl.k_means(2))]))
