"""New image files of a folder, painted with a fitted plan."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.stages import with_storage
from ..sources.images import PIXELS, _decode, encode_images


def pixel_stream(spark: SparkSession, folder: str, dims: int, storage: str = "u8", files_at_once: int = 16) -> DataFrame:
    """Pixel rows of the TIFF, PNG and BMP files that arrive in ``folder``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)
    one = files.select("path", F.lit(0).alias("block"), F.lit(1).alias("blocks"), "content")
    return with_storage(one.mapInArrow(_decode(64), PIXELS), dims, storage)


def paint_stream(pixels: DataFrame, model: PipelineModel, output: str, checkpoint: str, kind: str = "tiff") -> StreamingQuery:
    """Write every image of the stream, painted, as rows (image_id, content) under ``output``.

    A batch is written once: its number is part of the path and overwritten when it is run again.
    """
    def write(batch: DataFrame, number: int) -> None:
        encode_images(model.transform(batch), kind).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return pixels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
