"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; its
128-bit hash stands for it. ``LineRuns`` holds runs of (hash, documents, largest doc_id), each
sorted by hash; a batch is aggregated and merge-joined against the runs, its unseen keys become a run
and the counts of its known keys a run of updates; when a level holds ``fanout`` runs they are merged into one run of the next level.

Two ways of use:
* ``LineRuns.unseen`` and ``LineRuns.add`` for a growing corpus: a batch keeps the lines whose key
  no run holds, and then adds its own keys.
* ``dedup_lines`` for a table: the table is fed to the runs in batches (``LineRuns.feed``); keys found in at least
  ``min_docs`` documents lose their lines everywhere but in the largest doc_id that holds them.

Defined results: a null or empty text is one empty line; every row counts as a document, so a
repeated row counts again, and all rows with the largest doc_id keep the line; a row whose doc_id
is null counts as a document and is the first to lose a line; keys shorter than ``min_chars``
always stay; an empty table gives an empty result; texts of any length are split within their row.
Only ``doc_id`` and ``text`` are read; all other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WS_CHARS, drop_folder, materialize, new_folder

HASHES = "h1 long, h2 long, doc_id long"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is too short to be judged."""
    key = line.strip(WS_CHARS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for i, text in enumerate(batch.column("text")):
                keys = {k for line in (text.as_py() or "").split("\n") if (k := line_key(line, min_chars))}
                found.extend(keys)
                of.extend([i] * len(keys))
            halves = np.frombuffer(b"".join(found), dtype=">i8").astype("i8").reshape(-1, 2)
            rest = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *rest.columns], names=["h1", "h2", *rest.schema.names])

    return run


def line_hashes(docs: DataFrame, min_chars: int = 40, parts: int = 1) -> DataFrame:
    """(h1, h2, doc_id, part): each key of a row once; part spreads rows over batches by doc_id."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.col("text"))
    return narrow.mapInArrow(_hash_lines(min_chars), HASHES + ", part int")


class LineRuns:
    """Levels of sorted runs under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None):
        self.spark, self.fanout, self.folder = spark, fanout, folder or new_folder(spark, "line-runs")
        #: runs of keys, and of later counts of keys that those hold
        self.levels: list[list[str]] = [[]]
        self.updates: list[list[str]] = [[]]
        self.written = 0

    def _read(self, paths: list[str]) -> DataFrame:
        schema = "h1 long, h2 long, n_docs long, max_doc long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, levels: list[list[str]], level: int, rows: DataFrame) -> None:
        at, self.written = f"{self.folder}/L{level}-{self.written}", self.written + 1
        rows.sortWithinPartitions("h1", "h2").write.parquet(at)
        while len(levels) <= level:
            levels.append([])
        levels[level].append(at)

    def _push(self, levels: list[list[str]], rows: DataFrame) -> None:
        """Write a run; merge a level that is full into the next one."""
        self._write(levels, 0, rows)
        level = 0
        while len(levels[level]) >= self.fanout:
            full, levels[level] = levels[level], []
            self._write(levels, level + 1, self._merged(self._read(full)))
            for at in full:
                drop_folder(self.spark, at)
            level += 1

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def _met(self, hashes: DataFrame, how: str) -> DataFrame:
        return hashes.join(self._read(sum(self.levels, [])).select("h1", "h2").hint("merge"), ["h1", "h2"], how)

    def _keys(self, hashes: DataFrame) -> DataFrame:
        return self._merged(hashes.select("h1", "h2", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("max_doc")))

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` whose key is in no run: a merge anti-join."""
        return self._met(hashes, "left_anti")

    def add(self, hashes: DataFrame) -> None:
        """Add a batch's keys as a run, whether or not other runs hold them."""
        self._push(self.levels, self._keys(hashes))

    def feed(self, hashes: DataFrame) -> None:
        """Add a batch's unseen keys as a run, and the counts of its known keys as updates."""
        keys = self._keys(hashes)
        if any(self.levels):
            self._push(self.updates, self._met(keys, "left_semi"))
            keys = self.unseen(keys)
        self._push(self.levels, keys)

    def counts(self) -> DataFrame:
        """One row for each key of all runs."""
        paths = sum(self.levels + self.updates, [])
        return self._read(paths) if len(paths) == 1 else self._merged(self._read(paths))

    def drop(self) -> None:
        drop_folder(self.spark, self.folder)


def _rebuild(min_chars: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, lost in zip(batch.column("__l_text"), batch.column("__l_lost"), strict=True):
                text = text.as_py() or ""
                if not lost.is_valid:
                    texts.append(text)
                    lines.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                gone = {x["h1"].to_bytes(8, "big", signed=True) + x["h2"].to_bytes(8, "big", signed=True) for x in lost.as_py()}
                had = text.split("\n")
                kept = [x for x in had if line_key(x, min_chars) not in gone]
                texts.append("\n".join(kept))
                lines.append(len(had))
                dropped.append(len(had) - len(kept))
            rows = batch.column("__l_row")
            yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=columns)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """Rows of ``docs`` in a struct ``row``, with kept_text, n_lines and n_dropped."""
    spark = docs.sparkSession
    if batches is None:  # of about 2,000,000 rows at most
        batches = max(4, -(-docs.count() // 2_000_000))
    staged = new_folder(spark, "line-hashes")
    line_hashes(docs, min_chars, batches).write.partitionBy("part").parquet(staged)
    hashes = spark.read.schema(HASHES + ", part int").parquet(staged)
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.feed(hashes.where(F.col("part") == k))
    common = runs.counts().where(F.col("n_docs") >= min_docs).drop("n_docs")
    gone = F.col("doc_id").isNull() & F.col("max_doc").isNotNull() | (F.col("doc_id") < F.col("max_doc"))
    lost = materialize(
        hashes.join(common.hint("merge"), ["h1", "h2"]).where(gone).groupBy(F.col("doc_id").alias("__l_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("__l_lost")),
        "lost-lines",
    )
    runs.drop()
    drop_folder(spark, staged)
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("__l_row"), F.col("text").alias("__l_text"), F.col("doc_id").cast("long").alias("__l_id0"))
    # a merge join at every size: what documents lose has no bound that would let it be broadcast
    joined = row.join(lost.hint("merge"), F.col("__l_id0").eqNullSafe(F.col("__l_id")), "left").select("__l_row", "__l_text", "__l_lost")
    schema = T.StructType([T.StructField("row", row.schema["__l_row"].dataType), *T._parse_datatype_string("kept_text string, n_lines long, n_dropped long").fields])
    return joined.mapInArrow(_rebuild(min_chars, schema.names), schema)


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents with their repeated lines removed; the columns of ``docs``."""
    change = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return dedup_lines(docs, **limits).select(*[change[c].alias(c) if c in change else F.col("row")[c].alias(c) for c in docs.columns])
