"""Running plans: one image or a batch of them, output names, logs, and plans that form a graph."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from pathlib import PurePosixPath
from typing import TypeVar

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession

from ..errors import StoppedError
from ..sources import images
from ..sources.log import write_log
from . import stages
from .config import Config, plan_of

T = TypeVar("T")


def output_name(template: str, path: str) -> str:
    """``$DIR``, ``$FILE`` and ``$EXT`` of the input in an output name; the extension begins at the first dot."""
    p = PurePosixPath(path)
    stem, dot, extension = p.name.partition(".")
    for key, value in (("$DIR", str(p.parent)), ("$FILE", stem), ("$EXT", dot + extension)):
        template = template.replace(key, value)
    return template


def read_pixels(spark: SparkSession, path: str, blocks: int = 1) -> DataFrame:
    """Pixels of one image, with their shape and storage noted, which the file itself tells."""
    dims, storage = images.shape_of(spark, path)
    if not dims:
        raise ValueError(f"{path} has no pixels")
    return stages.with_storage(images.read_images(spark, path, blocks), dims, storage)


def render(pixels: DataFrame, plan: Pipeline) -> tuple[DataFrame, dict]:
    """The plan's output pixels, and the log of what its stages have fitted."""
    model = plan.fit(pixels)
    log = {f"image{i:02d}": s.log() if hasattr(s, "log") else {"transform": getattr(s, "name", type(s).__name__)} for i, s in enumerate(model.stages)}
    return model.transform(pixels), log


def run_one(spark: SparkSession, config: Config, path: str | None = None) -> dict:
    """Read, fit, paint, write, log; returns the log."""
    began, path = time.time(), path or config.input
    target = output_name(config.output, path) if config.batch_mode else config.output
    pixels = read_pixels(spark, path, 1 if config.buffered_input else spark.sparkContext.defaultParallelism)
    pixels = pixels.persist()
    try:
        out, log = render(pixels, plan_of(config))
        images.write_image(out, target, config.output_format)
    finally:
        pixels.unpersist()
    dims, _ = stages.shape_of(out)
    log |= {"input": path, "writer": {"file": target, "format": images.format_of(target, config.output_format), "dimensions": dims}, "elapsed-time": f"{time.time() - began:.3f}"}
    if config.log:
        write_log(spark, output_name(config.log, path) if config.batch_mode else config.log, log)
    return log


def run_batch(items: Iterable[T], work: Callable[[T], object], parallel: int = 1) -> int:
    """Work on all items, ``parallel`` at a time, drawn one by one; the first failure stops the rest."""
    source, done, running = iter(items), 0, set()
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        try:
            while True:
                while len(running) < max(1, parallel) and (item := next(source, None)) is not None:
                    running.add(pool.submit(work, item))
                if not running:
                    return done
                finished, running = wait(running, return_when=FIRST_COMPLETED)
                for f in finished:
                    f.result()
                    done += 1
        except BaseException:
            for f in running:
                f.cancel()
            raise


def run(spark: SparkSession, config: Config) -> int:
    """One image, or every image of a batch list; returns how many."""
    if not config.batch_mode:
        run_one(spark, config)
        return 1
    return run_batch(images.read_paths(spark, config.input), lambda p: run_one(spark, config, p), config.batch_parallel_images)


# ---------------------------------------------------------------- graphs, searches, cancelling


def prepare(dependencies: Mapping[Hashable, Sequence[Hashable]], work: Callable[[Hashable], object], parallel: int = 4) -> list:
    """Work on every node after all that it depends on; independent nodes at once.

    Raises ValueError for a cycle or an unknown node. After a failure nothing more begins; the first
    failure is raised, with the others as its notes.
    """
    unknown = {d for ds in dependencies.values() for d in ds} - set(dependencies)
    if unknown:
        raise ValueError(f"unknown nodes: {sorted(map(str, unknown))}")
    left = {n: set(ds) for n, ds in dependencies.items()}
    order, ready = [], [n for n, ds in left.items() if not ds]
    probe = {n: set(ds) for n, ds in left.items()}
    todo = list(ready)
    while todo:
        n = todo.pop()
        del probe[n]
        for m in [m for m, ds in probe.items() if n in ds]:
            probe[m].discard(n)
            if not probe[m]:
                todo.append(m)
    if probe:
        raise ValueError(f"the graph has a cycle among {sorted(map(str, probe))}")
    failures: list[BaseException] = []
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        running = {pool.submit(work, n): n for n in ready}
        for n in ready:
            del left[n]
        while running:
            finished, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in finished:
                n = running.pop(f)
                if (e := f.exception()) is not None:
                    failures.append(e)
                    continue
                order.append(n)
                for m in [m for m, ds in left.items() if n in ds]:
                    left[m].discard(n)
                    if not left[m] and not failures:
                        del left[m]
                        running[pool.submit(work, m)] = m
    if failures:
        for other in failures[1:]:
            failures[0].add_note(f"also failed: {other!r}")
        raise failures[0]
    return order


def parallel_search(evaluate: Callable[[int], T], good: Callable[[T | None, T], bool], first: int, last: int, parallel: int = 1) -> T:
    """The last of the leading results for which ``good(previous, result)`` holds; looks ahead in parallel."""
    best: T | None = None
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        ahead = {i: pool.submit(evaluate, i) for i in range(first, min(first + max(1, parallel), last + 1))}
        for i in range(first, last + 1):
            result = ahead.pop(i).result()
            if best is not None and not good(best, result):
                break
            best = result
            if (j := i + max(1, parallel)) <= last:
                ahead[j] = pool.submit(evaluate, j)
        for f in ahead.values():
            f.cancel()
    if best is None:
        raise ValueError("nothing to search")
    return best


class Cancelable:
    """Jobs under one tag, which can be interrupted together."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.stopped = spark, tag, False

    def __enter__(self) -> Cancelable:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_) -> None:
        self.spark.removeTag(self.tag)

    def check(self) -> None:
        if self.stopped:
            raise StoppedError(self.tag)

    def stop(self) -> None:
        self.stopped = True
        self.spark.interruptTag(self.tag)


def pyramid(pixels: DataFrame, levels: int) -> list[DataFrame]:
    """Means of 2 x 2, 4 x 4, ... pixels, for viewing."""
    from pyspark.sql import functions as F

    dims, storage = stages.shape_of(pixels)
    out = []
    for k in range(1, levels + 1):
        size = 2**k
        means = pixels.groupBy("image_id", (F.floor(F.col("y") / size)).cast("int").alias("y"), (F.floor(F.col("x") / size)).cast("int").alias("x")).agg(*[F.avg(F.col("v").getItem(d)).alias(f"c{d}") for d in range(dims)])
        out.append(stages.with_storage(means.select("image_id", "y", "x", F.array(*[f"c{d}" for d in range(dims)]).alias("v")), dims, storage))
    return out


def levels_for(height: int, width: int, least: int = 256) -> int:
    """How often an image can be halved until it is no larger than ``least``."""
    return max(0, math.ceil(math.log2(max(height, width, 1) / least)))
