"""Language identification by nearest centroid.

Character n-grams (1 to 3) of the lower-cased text, with everything but letters as one space, are
hashed into ``dims`` buckets; a document is its term frequencies (logarithmic) times the inverse
document frequencies of the whole training part, at length 1. Each language has up to
``clusters`` spherical k-means centroids; a document takes the language of the centroid with the
largest cosine and is marked as rejected if it lies further from that centroid than nearly all of
the centroid's own documents do.

Document frequencies cover every training row. Centroids are fitted on a bounded sample:
``sample`` rows of each language, chosen by a hash of doc_id.

Defined results: a null text or one without letters is ``und`` with score 0; rows with a null
language are not learned from; without any training row all are ``und``; a null doc_id is neither
held out nor learned from; repeated rows are learned from again and predicted alike; an empty table
gives an empty result; texts of any length are used whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop_folder, new_folder

UNKNOWN = "und"


@dataclass(frozen=True)
class LangId:
    dims_bits: int = 15
    #: rows of each language that the centroids are fitted on, at most
    sample: int = 400
    clusters: int = 3
    rounds: int = 8
    #: a centroid rejects what lies beyond this quantile of its own documents' distances, and this much more
    reject_quantile: float = 0.995
    reject_slack: float = 0.15


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    #: (dims, centroids), each at length 1; which language; largest distance that is accepted
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray


class _Grams:
    """Bucket counts of a text's letters; None without letters."""

    def __init__(self, bits: int):
        self.bits = bits
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[code]
        if not is_letter.any():
            return None
        # one space for each run of other characters, and one at both ends
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        code = np.where(is_letter, code, 32)[keep].astype(np.uint64)
        code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
        shift, mult, fold = np.uint64(64 - self.bits), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
        counts = np.zeros(1 << self.bits, np.int64)
        h = code
        for n in range(1, 4):
            if n > 1:
                h = h[:-1] * fold + code[n - 1 :]
            counts += np.bincount(((h + np.uint64(n)) * mult >> shift).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        return at, counts[at]


def _weigh(at: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf[at]
    return v / np.linalg.norm(v)


def _learn_rows(cfg: LangId):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, n = _Grams(cfg.dims_bits), np.zeros(1 << cfg.dims_bits, np.int64), 0
        names = ["lang", "at", "count", "rows"]
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
        for batch in batches:
            out = []
            for text, lang, chosen in zip(batch.column("text"), batch.column("lang"), batch.column("chosen"), strict=True):
                if (got := grams(text.as_py())) is None:
                    continue
                df[got[0]] += 1
                n += 1
                if chosen.as_py():
                    out.append((lang.as_py(), got[0], got[1], 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if n:  # document frequencies of this partition, as one row without a language
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([None], kinds[0]), pa.array([at], kinds[1]), pa.array([df[at]], kinds[2]), pa.array([n], kinds[3])], names=names)

    return run


def _cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far apart starts; (centroids, index of each row's)."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))][None]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.vstack([x[near == j].mean(axis=0, keepdims=True) if (near == j).any() else c[j : j + 1] for j in range(len(c))]))
    return c, (x @ c.T).argmax(axis=1)


def fit(train: DataFrame, cfg: LangId = LangId()) -> Model:
    """Learn from the rows of ``train`` (doc_id, text, lang) whose language is not null."""
    spark, dims = train.sparkSession, 1 << cfg.dims_bits
    train = train.where("lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    shares = spark.createDataFrame([(k, min(1.0, 1.5 * cfg.sample / n)) for k, n in sizes.items()], "lang string, share double")
    # a hash of doc_id in [0, 1) below the language's share
    pick = F.xxhash64("doc_id", F.lit(1)) / F.lit(2.0**64) + F.lit(0.5)
    chosen = train.join(F.broadcast(shares), "lang").select("text", "lang", (pick < F.col("share")).alias("chosen"))
    at = new_folder(spark, "language-rows")
    chosen.mapInArrow(_learn_rows(cfg), "lang string, at array<int>, count array<long>, rows long").write.parquet(at)
    made = spark.read.parquet(at)
    df = np.zeros(dims, np.int64)
    part = made.where("lang is null")
    for r in part.select(F.explode(F.arrays_zip("at", "count")).alias("x")).groupBy("x.at").agg(F.sum("x.count").alias("n")).toLocalIterator():
        df[r[0]] = r[1]
    n = part.agg(F.sum("rows")).first()[0] or 0
    idf = np.log((1 + n) / (1 + df)) + 1
    langs, blocks, owner, reach = sorted(sizes), [], [], []
    for i, lang in enumerate(langs):
        rows = made.where(F.col("lang") == lang).orderBy(F.xxhash64("at", "count"), "at").limit(cfg.sample).collect()
        if not rows:
            continue
        x = np.zeros((len(rows), dims), np.float32)
        for row, r in zip(x, rows, strict=True):
            a = np.asarray(r["at"])
            row[a] = _weigh(a, np.asarray(r["count"]), idf)
        c, near = _cluster(x, cfg.clusters, cfg.rounds)
        far = 1 - (x @ c.T).max(axis=1)
        for j in range(len(c)):
            own = far[near == j]
            owner.append(i)
            reach.append(float(np.quantile(own, cfg.reject_quantile) if len(own) else 0) + cfg.reject_slack)
        blocks.append(c)
    drop_folder(spark, at)
    centroids = np.vstack(blocks).T.astype(np.float32) if blocks else np.zeros((dims, 0), np.float32)
    return Model(tuple(langs), idf.astype(np.float32), np.ascontiguousarray(centroids), np.array(owner, int), np.array(reach))


def _predict(model: Model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams(bits)
        for batch in batches:
            lang, score, rejected = [], [], []
            for text in batch.column("text"):
                got = grams(text.as_py()) if len(model.owner) else None
                if got is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                cos = _weigh(*got, model.idf) @ model.centroids[got[0]]
                best = int(cos.argmax())
                lang.append(model.langs[model.owner[best]])
                score.append(min(1.0, max(0.0, float(cos[best]))))
                rejected.append(bool(1 - cos[best] > model.reach[best]))
            yield pa.RecordBatch.from_arrays([batch.column("__g_row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model, cfg: LangId = LangId()) -> DataFrame:
    """Rows of ``docs`` without text in a struct ``row``, the nearest language, its cosine, and whether it is rejected."""
    from pyspark.sql import types as T

    row = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__g_row"), "text")
    schema = T.StructType([T.StructField("row", row.schema["__g_row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return row.mapInArrow(_predict(model, cfg.dims_bits), schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
