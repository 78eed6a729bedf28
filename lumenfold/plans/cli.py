"""The command line: ``python -m lumenfold --input FILE --output FILE [options]``."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from .config import ALGORITHMS, Config
from .run import run

#: Short options, and options whose names differ from their fields.
SHORT = {"input": "-i", "output": "-o", "algorithm": "-a", "elbow": "-e"}
NAMES = {"isodata_theta": "--isodata-theta-L", "isodata_l": "--isodata-L"}


def _truth(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def parse(argv: list[str]) -> Config:
    parser = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    for f in fields(Config):
        names = [*([SHORT[f.name]] if f.name in SHORT else []), NAMES.get(f.name, "--" + f.name.replace("_", "-"))]
        kind = str(f.type)
        options: dict = {"dest": f.name, "default": argparse.SUPPRESS}
        if kind == "bool":
            options |= {"type": _truth, "nargs": "?", "const": True}
        elif kind.startswith("list"):
            options |= {"action": "append"}
        else:
            options |= {"type": {"int": int, "float": float}.get(kind, str)}
        if f.name in ("input", "output"):
            options["required"] = True
        if f.name == "algorithm":
            options["choices"] = ALGORITHMS
        if f.name == "saturation_based":
            options["choices"] = ("hue", "hyper-hue")
        parser.add_argument(*names, **options)
    return Config(**vars(parser.parse_args(argv)))


def main(argv: list[str]) -> int:
    config = parse(argv)
    builder = SparkSession.builder.appName("lumenfold")
    if config.threads:
        builder = builder.master(f"local[{config.threads}]")
    spark = builder.getOrCreate()
    print(f"{run(spark, config)} image(s) written")
    return 0
