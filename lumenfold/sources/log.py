"""The log of a run: sorted ``key: value`` lines, nested keys joined by ``-``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from .images import write_file


def flatten(log: Mapping, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for key, value in log.items():
        name = f"{prefix}-{key}" if prefix else str(key)
        if isinstance(value, Mapping):
            out |= flatten(value, name)
        elif isinstance(value, list | tuple):
            out |= flatten({f"{i:02d}": v for i, v in enumerate(value)}, name)
        else:
            out[name] = str(value)
    return out


def lines(log: Mapping) -> str:
    return "".join(f"{k}: {v}\n" for k, v in sorted(flatten(log).items()))


def write_log(spark: SparkSession, path: str, log: Mapping) -> None:
    write_file(spark, path, lines(log).encode())


def log_rows(spark: SparkSession, log: Mapping):
    return spark.createDataFrame(sorted(flatten(log).items()), "key string, value string")
