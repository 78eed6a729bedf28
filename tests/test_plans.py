import json
import os
import subprocess
import sys
import threading
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from lumenfold import errors
from lumenfold.functions import masks
from lumenfold.functions import pixels as px
from lumenfold.operators import clustering as cl
from lumenfold.operators import palette
from lumenfold.plans import cli, config, run, stages
from lumenfold.sources import codecs, images, log, settings
from lumenfold.streaming.images import paint_stream, pixel_stream

RNG = np.random.default_rng(0)
RGB8 = RNG.integers(0, 256, (13, 17, 3)).astype(np.uint8)
GRAY16 = RNG.integers(0, 65536, (9, 70, 5)).astype(np.uint16)


def array_of(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1, len(rows[0].v)))
    for r in rows:
        out[r.y, r.x] = r.v
    return out


# ---------------------------------------------------------------- files


@pytest.mark.parametrize("bands", [1, 3, 5, 15])
def test_codecs_round_trip(bands):
    for kind in (np.uint8, np.uint16):
        image = RNG.integers(0, np.iinfo(kind).max + 1, (70, 11, bands)).astype(kind)
        assert (codecs.decode(codecs.encode(image, "tiff")) == image).all()
        if bands <= 3:
            assert (codecs.decode(codecs.encode(image, "png")) == image).all()
        if bands <= 3 and kind is np.uint8:
            assert (codecs.decode(codecs.encode(image, "bmp")) == np.repeat(image, 3 // bands, axis=2)).all()
    with pytest.raises(codecs.FormatError):
        codecs.encode(RGB8, "webp")
    with pytest.raises(codecs.FormatError):
        codecs.decode(b"no image")


def test_files_of_other_writers(spark, tmp_path):
    """PNG (with filters), BMP and TIFF as the JVM writes them; JPEG through Spark's own source."""
    jvm = spark._jvm
    smooth = (np.mgrid[0:40, 0:50].sum(0)[:, :, None] * np.array([1, 2, 1]) + 20).astype(np.uint8)
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(codecs.encode(smooth, "png")))
    for kind in ("png", "bmp", "tiff"):
        path = str(tmp_path / f"a.{kind}")
        assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(path))
        assert np.allclose(array_of(images.read_images(spark, path)) * 255, smooth)
    path = str(tmp_path / "a.jpg")
    images.write_image(images.image_from_array(spark, smooth), path)
    assert np.abs(array_of(images.read_images(spark, path)) * 255 - smooth).max() < 12


def test_lzw_and_packbits():
    assert codecs._packbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == bytes([1, 2, 3, 9, 9, 9, 7])
    codes = [256, 65, 66, 258, 260, 257]  # A B AB ABA
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codecs._lzw(packed) == b"ABABABA"


def test_read_and_write(spark, tmp_path):
    for image, name, most in ((RGB8, "a.png", 255), (GRAY16, "b.tif", 65535)):
        path = str(tmp_path / name)
        open(path, "wb").write(codecs.encode(image, images.format_of(name)))
        for blocks in (1, 3):
            assert np.allclose(array_of(images.read_images(spark, path, blocks)) * most, image)
    pixels = images.image_from_array(spark, RGB8)
    out = str(tmp_path / "out.tiff")
    images.write_image(pixels, out)
    images.write_image(pixels, out)  # over what was there
    assert (codecs.decode(open(out, "rb").read()) == RGB8).all() and (images.to_array(pixels) == RGB8).all()
    assert images.format_of("x.JPG") == "jpeg" and images.format_of("x") == "tiff" and images.format_of("x.png", "bmp") == "bmp"


def test_log(spark, tmp_path):
    assert log.lines({"b": 1, "a": {"y": [1.5, (2,)], "x": "t"}}) == "a-x: t\na-y-00: 1.5\na-y-01-00: 2\nb: 1\n"
    log.write_log(spark, str(tmp_path / "log"), {"k": "é"})
    assert (tmp_path / "log").read_text(encoding="utf-8") == "k: é\n"
    assert log.log_rows(spark, {"a": 1}).collect()[0].asDict() == {"key": "a", "value": "1"}


# ---------------------------------------------------------------- stages


def image(spark, data):
    most = 255.0 if data.dtype == np.uint8 else 65535.0
    return stages.with_storage(images.image_from_array(spark, data), data.shape[2], "u8" if most == 255 else "u16")


def test_stages_keep_shape_and_storage(spark):
    pixels = image(spark, GRAY16)
    for stage, dims, storage in ((stages.select(4, 0), 2, "u16"), (stages.hue(), 1, "u16"), (stages.hyper_hue(), 5, "f32"), (stages.normalized_hyper_hue(0.1), 5, "f32"), (stages.intensity(), 1, "u16"), (stages.vegetation_index(), 2, "u16")):
        out = stage.transform(pixels)
        assert stages.shape_of(out) == (dims, storage) and len(out.first().v) == dims
    eight = stages.intensity().transform(image(spark, RGB8))
    assert all(abs(r.v[0] * 255 - round(r.v[0] * 255)) < 1e-9 for r in eight.collect())


def test_normalize(spark):
    pixels = image(spark, RGB8)
    x = RGB8.reshape(-1, 3) / 255
    model = stages.Normalize().fit(pixels)
    assert np.allclose(model.ranges.lows, x.min(0)) and np.allclose(model.ranges.lengths, np.ptp(x, axis=0))
    out = array_of(model.transform(pixels))
    assert np.isclose(out.min(), 0) and np.isclose(out.max(), 1)
    left = stages.Normalize(masks.half_plane(-1, 0, 5), 1.0).fit(pixels)
    part = RGB8[:, :6].reshape(-1, 3) / 255
    low = np.maximum(0, part.mean(0) - part.std(0))
    assert np.allclose(left.ranges.lows, low) and np.allclose(left.ranges.lengths, np.minimum(1, part.mean(0) + part.std(0)) - low)
    assert left.transform(pixels).count() == 13 * 17
    nothing = stages.Normalize(F.lit(False), 2.0).fit(pixels)
    assert nothing.ranges == stages.Ranges((0.0,) * 3, (1.0,) * 3)
    flat = image(spark, np.full((2, 2, 1), 51, np.uint8))
    assert stages.Normalize().fit(flat).ranges.lengths == (1.0,)


def test_cluster_paints_by_nearest_center(spark):
    data = np.zeros((10, 12, 3), np.uint8)
    data[:, :4], data[:, 4:8], data[:, 8:] = (200, 10, 10), (10, 10, 200), (10, 200, 10)
    pixels = image(spark, data)
    model = Pipeline(stages=[stages.Cluster(cl.elbow(0.95, 6, 2, cl.k_means))]).fit(pixels)
    cluster = model.stages[0]
    assert sorted(cluster.clusters.vectors) == [(10, 10, 200), (10, 200, 10), (200, 10, 10)] and cluster.clusters.error == 0
    out = np.round(array_of(model.transform(pixels)) * 255).astype(int)
    # channels count as blue, green, red, and so do the colours
    assert [tuple(out[0, x]) for x in (0, 5, 9)] == [(255, 0, 0), (0, 0, 255), (0, 255, 0)]
    masked = stages.Cluster(cl.k_means(2), palette.false_grays(1), masks.half_plane(-1, 0, 7)).fit(pixels)
    assert (10.0, 200.0, 10.0) not in masked.clusters.vectors and masked.transform(pixels).count() == 120
    assert "clusters-error" in cluster.log()


def test_painting_equals_numpy(spark):
    """More clusters than coordinates, so that every distance counts."""
    rng = np.random.default_rng(8)
    centers = [tuple(c) for c in rng.integers(0, 256, (9, 3)).astype(float)]
    colors = [tuple(c) for c in rng.integers(0, 256, (9, 3)) / 255]
    model = stages.ClusterModel(cl.Clusters(tuple((c,) for c in centers), 0.0), colors)
    near = ((RGB8.reshape(-1, 1, 3).astype(float) - np.array(centers)) ** 2).sum(-1).argmin(1).reshape(13, 17)
    assert np.allclose(array_of(model.transform(image(spark, RGB8))), np.array(colors)[near])


def test_saturation_cluster(spark):
    rng = np.random.default_rng(3)
    data = np.zeros((8, 16, 3), np.uint8)
    data[:, :8] = rng.integers(0, 2, (8, 8, 1)) * 180 + 40
    data[:, 8:] = np.where(rng.integers(0, 2, (8, 8, 1)) == 1, (250, 10, 10), (10, 10, 250))
    pixels = image(spark, data)
    for by in ("hue", "hyper-hue"):
        model = stages.SaturationCluster(by, cl.k_means(2)).fit(pixels)
        out = np.round(array_of(model.transform(pixels)) * 255).astype(int)
        assert (out[:, :8].max(2) == out[:, :8].min(2)).all() and (out[:, 8:].max(2) > out[:, 8:].min(2)).all()
        assert len({tuple(c) for c in out.reshape(-1, 3)}) == 4 and model.error == model.grays.error + model.hues.error
    with pytest.raises(errors.EmptyClusterError, match="coloured"):
        stages.SaturationCluster("hue", cl.k_means(2)).fit(pixels.where("x < 8"))
    with pytest.raises(ValueError):
        stages.SaturationCluster("size", cl.k_means(2))


# ---------------------------------------------------------------- options, settings, running


def test_transform_grammar():
    for text, kind in (("hue", stages.Projection), ("select(4, 3,2)", stages.Projection), ("normalized-hyper-hue(0.05)", stages.Projection), ("normalize-min-max", stages.Normalize), ("normalize-deviation(2.5)", stages.Normalize)):
        assert isinstance(config.parse_transform(text), kind)
    assert config.parse_transform("normalize-deviation(2.5)").sigma == 2.5
    for bad in ("hue-hyper-hue", "select()", "hue(1)", "normalize-deviation", "blur"):
        with pytest.raises(ValueError):
            config.parse_transform(bad)


def test_options():
    c = cli.parse(["-i", "a", "-o", "b", "-a", "isodata", "--isodata-theta-L", "0.1", "--image-transform", "hue", "--image-transform", "intensity", "--elbow", "false", "--batch-mode"])
    assert (c.algorithm, c.isodata_theta, c.image_transform, c.elbow, c.batch_mode, c.max, c.error_limit) == ("isodata", 0.1, ["hue", "intensity"], False, True, 20, 0.95)
    for bad in (["-i", "a"], ["-i", "a", "-o", "b", "-a", "dbscan"], ["-i", "a", "-o", "b", "--elbow", "maybe"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)
    with pytest.raises(ValueError, match="initial centers"):
        config.strategy_of(config.Config(initial_centers_mean=False))
    with pytest.raises(ValueError, match="replacement"):
        config.strategy_of(config.Config(replace_empty_clusters_farthest=False))


def test_output_names():
    assert run.output_name("$DIR/out/$FILE-x$EXT", "/a$b/c.d.tif") == "/a$b/out/c-x.d.tif"


WRAPPED = {
    "inputFile": "a.tif",
    "mask": ["java.util.ArrayList", [["x.Line", {"x1": 0, "y1": 0, "x2": 1.5, "y2": 2}]]],
    "outputs": [
        "java.util.ArrayList",
        [
            {"transforms": ["java.util.ArrayList", []]},
            {"transforms": ["java.util.ArrayList", [["x.Transform$Select", {"selectedChannels": ["java.util.ArrayList", [2, 1, 0]]}], ["x.Transform$NormalizeDeviation", {}], ["x.Transform$Cluster", {"algorithm": "OTSU", "maxClusters": 3, "minClusters": 3, "initialCentersRandom": None}]]]},
            {"transforms": ["java.util.ArrayList", [["x.Transform$NormalizedHyperHue", {"maxZero": 0.5}], ["x.Transform$Hue", {}], ["x.Transform$Cluster", {"type": "CLUSTER_HUE"}]]]},
        ],
    ],
}


def test_settings():
    s = settings.loads(json.dumps(WRAPPED))
    assert s.mask == [(0.0, 0.0, 1.5, 2.0)] and [len(o) for o in s.outputs] == [0, 3, 3]
    assert s.outputs[1][0].options == {"selectedChannels": [2, 1, 0]} and s.outputs[1][1].options == {"sigma": 3.0}
    assert s.outputs[1][2].options["bins"] == 32 and s.outputs[1][2].options["initialCentersRandom"] == 0
    assert settings.loads(settings.dumps(s)) == s


def test_plans_of_settings(spark):
    plans = config.plans_of(settings.loads(json.dumps(WRAPPED)))
    assert [[type(x).__name__ for x in p.getStages()] for p in plans] == [[], ["Projection", "Normalize", "Cluster"], ["Projection", "Projection", "SaturationCluster"]]
    pixels = image(spark, RGB8)
    assert plans[0].fit(pixels).transform(pixels).count() == 13 * 17


@pytest.mark.parametrize("extra", [[], ["--image-transform", "hyper-hue"], ["-a", "isodata"], ["--image-transform", "hue", "-a", "otsu"], ["--image-transform", "intensity", "-a", "otsu-circular", "--bins", "8"], ["--saturation-based", "hyper-hue"], ["--mask", "0,0,17,13", "--rgb-cluster-colors", "false"]])
def test_runs(spark, tmp_path, extra):
    source = str(tmp_path / "in.tif")
    data = RGB8.copy()
    data[:, :8] = data[:, :8, :1]  # grays on the left
    open(source, "wb").write(codecs.encode(data, "tiff"))
    out = str(tmp_path / "out.png")
    argv = ["-i", source, "-o", out, "--max", "3", "--log", str(tmp_path / "log"), *extra]
    assert run.run(spark, cli.parse(argv)) == 1
    painted = codecs.decode(open(out, "rb").read())
    assert painted.shape == (13, 17, 1 if "--rgb-cluster-colors" in extra else 3) and painted.dtype == np.uint8
    assert "elapsed-time" in (tmp_path / "log").read_text()


def test_batch(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"i{k}.png").write_bytes(codecs.encode(RGB8[:, :, : 3 if k else 1], "png"))
    (tmp_path / "list").write_text("".join(f"{tmp_path}/i{k}.png\n" for k in range(3)))
    c = cli.parse(["-i", str(tmp_path / "list"), "-o", "$DIR/out-$FILE.tiff", "--batch-mode", "--batch-parallel-images", "2", "--max", "2", "--rgb-cluster-colors", "false"])
    assert run.run(spark, c) == 3
    assert all(codecs.decode((tmp_path / f"out-i{k}.tiff").read_bytes()).shape == (13, 17, 1) for k in range(3))


@pytest.mark.parametrize("parallel", [1, 3])
def test_batches_run_so_many_at_once(parallel):
    lock, now, most, seen = threading.Lock(), 0, 0, []

    def work(item):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.005)
        with lock:
            now -= 1
            seen.append(item)

    assert run.run_batch(range(100), work, parallel) == 100
    assert sorted(seen) == list(range(100)) and most == parallel
    with pytest.raises(ZeroDivisionError):
        run.run_batch(range(100), lambda i: 1 // (5 - i), parallel)


EDGES = {0: [], 1: [0], 2: [0], 3: [0], 4: [1, 2], 5: [1, 3]}


def test_graphs():
    order = run.prepare(EDGES, lambda n: time.sleep(0.01 * (n % 3)))
    assert sorted(order) == list(EDGES) and all(order.index(d) < order.index(n) for n, ds in EDGES.items() for d in ds)

    def failing(n):
        if n in (1, 2):
            raise RuntimeError(f"failed {n}")

    with pytest.raises(RuntimeError, match="failed"):
        run.prepare(EDGES, failing)
    for bad in ({0: [1], 1: [0]}, {0: [7]}):
        with pytest.raises(ValueError):
            run.prepare(bad, print)


def test_search_pyramid_and_cancel(spark):
    for parallel in (1, 4):
        assert run.parallel_search(lambda i: abs(i - 5), lambda a, b: b < a, 2, 9, parallel) == 0
    pixels = image(spark, RGB8)
    half = run.pyramid(pixels, 2)[0]
    assert half.count() == 7 * 9 and np.isclose(array_of(half)[0, 0, 1] * 255, RGB8[:2, :2, 1].mean())
    assert run.levels_for(8192, 100) == 5
    with run.Cancelable(spark, "work") as c:
        c.check()
        c.stop()
        with pytest.raises(errors.StoppedError):
            c.check()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.png").write_bytes(codecs.encode(RGB8, "png"))
    pixels = image(spark, RGB8)
    model = Pipeline(stages=[stages.Cluster(cl.k_means(2), palette.false_grays(1))]).fit(pixels)
    want = images.to_array(model.transform(pixels))
    paint_stream(pixel_stream(spark, str(tmp_path / "in"), 3), model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 2 and all((codecs.decode(bytes(r.content)) == want).all() for r in rows)


def test_import_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 30"], cwd=root, check=True)
    assert px.STORAGE["u8"] == 255
