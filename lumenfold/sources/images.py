"""Images as rows of pixels, (image_id, y, x, v) with v in [0, 1], and back.

TIFF, PNG and BMP are decoded on the executors from Spark's binary file source, in blocks of lines,
so that one large image is read by many tasks; JPEG and GIF through Spark's image source. An image
is encoded by many tasks, a strip of lines at a time; only encoded strips come together in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import raw
from . import codecs

PIXELS = "image_id string, y int, x int, v array<double>"
#: The formats that file names may tell, by extension.
FORMATS = {"bmp": "bmp", "gif": "gif", "jpeg": "jpeg", "jpg": "jpeg", "png": "png", "tif": "tiff", "tiff": "tiff"}
#: Formats that Spark's image source decodes.
BY_SPARK = ("jpeg", "gif")


def format_of(path: str, given: str | None = None) -> str:
    """The output format: the given one, else by extension, else TIFF."""
    return given or FORMATS.get(PurePosixPath(path).suffix.lower().lstrip("."), "tiff")


def _rows(name: str, part: np.ndarray, first: int) -> pa.RecordBatch:
    """Pixels of some lines, of which ``first`` is the first."""
    height, width, bands = part.shape
    most = 255.0 if part.dtype == np.uint8 else 65535.0
    values = pa.array((part.reshape(-1).astype(np.float64) / most))
    offsets = pa.array(np.arange(0, height * width * bands + 1, bands, dtype=np.int32))
    y, x = np.mgrid[first : first + height, 0:width].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([name] * (height * width), pa.string()), pa.array(y.reshape(-1)), pa.array(x.reshape(-1)), pa.ListArray.from_arrays(offsets, values)], names=["image_id", "y", "x", "v"])


def _decode(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, blocks, data in zip(*(batch.column(c) for c in ("path", "block", "blocks", "content")), strict=True):
                file = memoryview(data.as_buffer())  # encoded, and not copied
                height = codecs.shape(file)[0][0]
                each = -(-height // blocks.as_py())
                y = block.as_py() * each
                for part in codecs.lines(file, y, y + each, lines):
                    yield _rows(name.as_py(), part, y)
                    y += len(part)

    return run


def _from_spark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, h, w, n, data in zip(*(batch.column(c) for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
            h, w, n = h.as_py(), w.as_py(), n.as_py()
            image = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w, n)
            image = image[:, :, 2::-1] if n == 3 else image[:, :, [2, 1, 0, 3]] if n == 4 else image
            for y in range(0, h, codecs.STRIP):
                yield _rows(name.as_py(), image[y : y + codecs.STRIP], y)


def read_images(spark: SparkSession, paths: str | Sequence[str], blocks: int = 1) -> DataFrame:
    """Pixels of the images at ``paths``; each TIFF, PNG or BMP file is read by ``blocks`` tasks."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    own = [p for p in paths if format_of(p) not in BY_SPARK]
    other = [p for p in paths if format_of(p) in BY_SPARK]
    found = []
    if own:
        files = spark.read.format("binaryFile").load(own).select("path", "content")
        split = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(blocks).alias("blocks"), "content")
        if blocks > 1:
            split = split.repartition(blocks * len(own), "path", "block")
        found.append(split.mapInArrow(_decode(64), PIXELS))
    if other:
        found.append(spark.read.format("image").load(other).select("image.*").mapInArrow(_from_spark, PIXELS))
    return found[0] if len(found) == 1 else found[0].union(found[1])


def _shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [codecs.shape(memoryview(data.as_buffer())) for data in batch.column("content")]
        yield pa.RecordBatch.from_pydict({"bands": pa.array([size[2] for size, _ in made], pa.int32()), "storage": ["u8" if dtype == np.uint8 else "u16" for _, dtype in made]})


def shape_of(spark: SparkSession, path: str) -> tuple[int, str]:
    """Bands and storage of the image at ``path``, as its file says; one small job."""
    if format_of(path) in BY_SPARK:
        row = spark.read.format("image").load(path).select("image.nChannels").first()
        return (row[0], "u8") if row else (0, "u8")
    row = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_shape, "bands int, storage string").first()
    return (row["bands"], row["storage"]) if row else (0, "u8")


def image_from_array(spark: SparkSession, image: np.ndarray, image_id: str = "image") -> DataFrame:
    """Pixels of an array (height, width, bands) of uint8 or uint16."""
    rows = _rows(image_id, image, 0)
    return spark.createDataFrame(pa.Table.from_batches([rows]))


def read_paths(spark: SparkSession, path: str) -> list[str]:
    """The image paths of a batch list, one on each line; empty lines are left out."""
    return [r[0].strip() for r in spark.read.text(path).collect() if r[0].strip()]


#: Formats that this library writes itself; the JVM's writers take the others from a PNG.
OWN = ("tiff", "png", "bmp")
#: what the strips of an image have in common
SIZE = ("image_id", "height", "width", "bands", "each")
STRIPS = "image_id string, height int, width int, bands int, each int, strip int, content binary, length int, check long"


def _encode_strip(kind: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        name, height, width, bands, each, strip = (k.as_py() for k in key)
        first = strip * each
        y, x = rows.column("y").to_numpy() - first, rows.column("x").to_numpy()
        v = rows.column("v").combine_chunks()
        if not (v.value_lengths().to_numpy(zero_copy_only=False) == bands).all():
            raise ValueError("the pixels of an image differ in their number of channels")
        part = np.zeros((min(each, height - first), width, bands), np.uint8)
        part[y, x] = v.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, bands)
        content, length, check = codecs.encode_strip(part, kind, first + each >= height)
        return pa.table([pa.array([c], t) for c, t in zip((name, height, width, bands, each, strip, content, length, check), (pa.string(), *[pa.int32()] * 5, pa.binary(), pa.int32(), pa.int64()), strict=True)], STRIPS.replace(",", "").split()[::2])

    return run


def _strips(pixels: DataFrame, kind: str) -> DataFrame:
    """The encoded strips of each image of ``pixels``, by lines that have a pixel at all."""
    stored = pixels.select("image_id", "y", "x", F.transform("v", lambda c: raw(c, "u8").cast("int")).alias("v"))
    sizes = pixels.groupBy(F.col("image_id").alias("__id")).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.max(F.size("v")).alias("bands"), F.least(F.min("y"), F.min("x")).alias("__least"))
    lines = F.greatest(F.lit(1), F.least(F.lit(codecs.STRIP), F.floor(F.lit(codecs.STRIP_BYTES) / (F.col("width") * F.col("bands"))))).cast("int")
    checked = F.when(F.col("__least") < 0, F.raise_error(F.lit("a pixel lies outside of its image")).cast("int")).otherwise(lines)
    sized = stored.join(F.broadcast(sizes.withColumn("each", checked)), F.col("image_id").eqNullSafe(F.col("__id")))
    return sized.select(*SIZE, F.floor(F.col("y") / F.col("each")).cast("int").alias("strip"), "y", "x", "v").groupBy(*SIZE, "strip").applyInArrow(_encode_strip(kind), STRIPS)


class _Blank:
    """Encoded strips without a pixel."""

    def __init__(self, kind: str, height: int, width: int, bands: int, each: int):
        self.kind, self.height, self.width, self.bands, self.each, self.made = kind, height, width, bands, each, {}

    def __call__(self, strip: int) -> tuple[bytes, int, int]:
        n = min(self.each, self.height - strip * self.each)
        end = (strip + 1) * self.each >= self.height
        if (n, end) not in self.made:
            self.made[n, end] = codecs.encode_strip(np.zeros((n, self.width, self.bands), np.uint8), self.kind, end)
        return self.made[n, end]


def _file(kind: str, size: tuple[int, int, int, int], known: dict[int, tuple[int, int]], contents: Iterable[tuple[int, bytes]]) -> Iterator[bytes]:
    """The pieces of a file in order, from the strips that there are, in the file's order."""
    height, width, bands, each = size
    blank, count = _Blank(kind, *size), -(-height // each)
    frame = codecs.Frame(kind, height, width, bands, np.uint8, each, {i: known[i] if i in known else blank(i)[1:] for i in range(count)})
    yield frame.head()
    given = iter(contents)
    for i in codecs.strip_order(kind, count):
        if i not in known:
            yield blank(i)[0]
            continue
        strip, content = next(given)
        if strip != i or len(content) != known[i][0]:
            raise RuntimeError("a strip has changed while the file was written")
        yield content
    yield frame.tail()


def _join_strips(kind: str):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        size = tuple(rows.column(c)[0].as_py() for c in SIZE[1:])
        strips, lengths, checks = (rows.column(c).to_pylist() for c in ("strip", "length", "check"))
        place = {s: i for i, s in enumerate(strips)}
        content = rows.column("content")
        ordered = ((s, content[place[s]].as_py()) for s in sorted(strips, reverse=kind == "bmp"))
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.string()), "content": pa.array([b"".join(_file(kind, size, dict(zip(strips, zip(lengths, checks, strict=True), strict=True)), ordered))], pa.binary())})

    return run


def encode_images(pixels: DataFrame, kind: str = "tiff") -> DataFrame:
    """(image_id, content): the encoded 8-bit file of each image of ``pixels``."""
    native = kind if kind in OWN else "png"
    return _strips(pixels, native).groupBy("image_id").applyInArrow(_join_strips(native), "image_id string, content binary")


def _through_jvm(spark: SparkSession, png: bytes, kind: str) -> bytes:
    """A PNG as JPEG or GIF, by the JVM's own writers."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png))
    out = jvm.java.io.ByteArrayOutputStream()
    if not jvm.javax.imageio.ImageIO.write(image, kind, out):
        raise codecs.FormatError(f"no writer for {kind} and this image")
    return bytes(out.toByteArray())


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Write through Spark's file systems, over what was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(data)
    finally:
        out.close()


def _write_pieces(spark: SparkSession, path: str, pieces: Iterable[bytes]) -> None:
    """Write a file piece by piece beside ``path``, and over what was there when it is whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    part = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}.part")
    out, held = files.create(part, True), bytearray()
    try:
        try:
            for piece in pieces:
                held += piece
                if len(held) >= 1 << 20:
                    out.write(bytes(held))
                    held.clear()
            out.write(bytes(held))
        finally:
            out.close()
        if files.exists(at):
            files.delete(at, False)
        if not files.rename(part, at):
            raise OSError(f"{path} cannot be written")
    except BaseException:
        files.delete(part, False)
        raise


def write_image(pixels: DataFrame, path: str, kind: str | None = None) -> None:
    """Write the one image of ``pixels`` as one file; its encoded strips pass through the driver one after another."""
    spark, kind = pixels.sparkSession, format_of(path, kind)
    if kind not in OWN:
        row = encode_images(pixels, kind).first()
        if row is None:
            raise ValueError("there are no pixels to write")
        return write_file(spark, path, _through_jvm(spark, bytes(row["content"]), kind))
    strips = _strips(pixels, kind).persist()
    try:
        rows = strips.select(*SIZE, "strip", "length", "check").collect()
        if not rows:
            raise ValueError("there are no pixels to write")
        name, *size = rows[0][:5]
        known = {r["strip"]: (r["length"], r["check"]) for r in rows if r["image_id"] == name}
        one = strips.where(F.col("image_id").eqNullSafe(F.lit(name))).orderBy(F.desc("strip") if kind == "bmp" else F.asc("strip"))
        _write_pieces(spark, path, _file(kind, tuple(size), known, ((r[0], bytes(r[1])) for r in one.select("strip", "content").toLocalIterator())))
    finally:
        strips.unpersist()


def to_array(pixels: DataFrame) -> np.ndarray:
    """The one image of ``pixels`` as an array of bytes, for viewers."""
    return codecs.decode(bytes(encode_images(pixels, "tiff").first()["content"]))
