"""Image files by strips of lines: what is held at once, and files with gaps."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import codecs, images

RNG = np.random.default_rng(1)
TALL = RNG.integers(0, 256, (20000, 60, 3)).astype(np.uint8)


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def blocks_of(data, block, blocks):
    batch = pa.RecordBatch.from_pydict({"path": ["a"], "block": [block], "blocks": [blocks], "content": pa.array([data], pa.binary())})
    return images._decode(64)(iter([batch]))


def sparse(spark):
    """A few pixels of an image of 300 lines, most strips of which have none."""
    places = [(3, 2, 10), (3, 6, 20), (140, 0, 30), (299, 6, 40)]
    want = np.zeros((300, 7, 1), np.uint8)
    for y, x, v in places:
        want[y, x] = v
    rows = spark.createDataFrame(places, "y int, x int, s int")
    return rows.select(F.lit("a").alias("image_id"), "y", "x", F.array(F.col("s") / 255.0).alias("v")), want


def by_strips(spark, tmp_path, kind, want_bands=1):
    pixels, want = sparse(spark)
    path = str(tmp_path / f"a.{kind}")
    images.write_image(pixels, path)
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".part")] == []
    data = open(path, "rb").read()
    assert (codecs.decode(data) == np.repeat(want, want_bands, axis=2)).all()
    assert codecs.encode(want, kind) == data == bytes(images.encode_images(pixels, kind).first()["content"])
    # no group of pixels is more than a strip
    assert sorted(r.strip for r in images._strips(pixels, kind).collect()) == [0, 2, 4]


def test_tiff_is_written_and_read_by_strips(spark, tmp_path):
    by_strips(spark, tmp_path, "tiff")
    data = codecs.encode(TALL, "tiff")
    assert peak_of(lambda: sum(b.num_rows for b in blocks_of(data, 0, 1))) < TALL.nbytes / 2


def test_a_failing_plan_leaves_the_file(spark, tmp_path):
    path = str(tmp_path / "a.tiff")
    pixels, want = sparse(spark)
    images.write_image(pixels, path)
    outside = pixels.withColumn("y", F.col("y") - 100)
    with pytest.raises(Exception, match="outside"):
        images.write_image(outside, path)
    assert (codecs.decode(open(path, "rb").read()) == want).all()


def test_blocks_of_a_tiff_decode_their_own_strips():
    data = bytearray(codecs.encode(TALL, "tiff"))
    data[8:40] = bytes(32)  # the first strip is damaged
    got = [b.column("y").to_numpy() for b in blocks_of(bytes(data), 2, 3)]
    assert (np.unique(np.concatenate(got)) == np.arange(13334, 20000)).all()
    with pytest.raises(Exception):
        list(blocks_of(bytes(data), 0, 3))


def test_bmp_is_written_and_read_by_strips(spark, tmp_path):
    by_strips(spark, tmp_path, "bmp", 3)
    data = codecs.encode(TALL, "bmp")
    assert (codecs.decode(data) == TALL).all()
    assert peak_of(lambda: sum(b.num_rows for b in blocks_of(data, 0, 1))) < TALL.nbytes / 2


def test_png_is_written_and_read_by_strips(spark, tmp_path):
    by_strips(spark, tmp_path, "png")
    data = codecs.encode(TALL, "png")
    assert (codecs.decode(data) == TALL).all()
    assert peak_of(lambda: sum(b.num_rows for b in blocks_of(data, 1, 2))) < TALL.nbytes / 2
    # the JVM's reader checks the joined stream
    jvm = spark._jvm
    read = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(codecs.encode(TALL[:200], "png")))
    assert [read.getRGB(x, 199) & 0xFFFFFF for x in range(3)] == [int(r) << 16 | int(g) << 8 | int(b) for r, g, b in TALL[199, :3]]
    # one chunk for all, as other writers do, and one that ends early
    body = codecs.zlib.compress(np.concatenate([np.zeros((20000, 1), np.uint8), TALL.reshape(20000, -1)], axis=1).tobytes())
    front = data[: data.index(b"IDAT") - 4]
    assert (codecs.decode(front + codecs._png_chunk(b"IDAT", body)) == TALL).all()
    with pytest.raises(codecs.FormatError):
        codecs.decode(front + codecs._png_chunk(b"IDAT", body[: len(body) // 2]))
