"""Shared folder, materialisation and text constants for the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class body (Java and Python regular expressions).
WS = r"\x20\x09-\x0D"
#: The same characters for ``str.strip``; ``bytes.split()`` without arguments cuts at exactly these.
WS_CHARS = " \t\n\x0b\x0c\r"
#: Masters whose executors share the driver's disk.
LOCAL = re.compile(r"local(\[.*\])?")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (as in tests) a local folder is set up and
    remembered as the checkpoint folder of the session's context. A cluster without the setting is an
    error: what executors write to folders of their own would be missing from later reads.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {spark.sparkContext.master}")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
