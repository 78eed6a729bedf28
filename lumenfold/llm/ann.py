"""Approximate nearest neighbours over balanced posting lists.

A bounded sample is split again and again until its clusters are of even size; their means are the
centroids of the posting lists. A vector goes to the list of its nearest centroid and, near a
boundary, also to others: those within ``spread`` of the smallest distance, unless they lie much closer
to an already chosen centroid than to the vector. Nearest centroids are found by best-first search over an
in-memory graph of the centroids, which has at most ``max_lists`` nodes. A query searches the lists
whose distance is at most ``ratio`` times its smallest; the ratio is calibrated on the sample to a
target recall. Small lists are gathered into blocks and large ones are dealt over several, so that a
block's rows are bounded in number; every block returns the best of each of its queries, and the
blocks' best are merged.

Equal vectors are searched once and stand in a list with their ``k + 1`` smallest ids only: as ties go to
smaller ids, no other one of them can be among the nearest of any query, so nothing is lost.

Scores are computed in double precision on the original vectors.

Defined results: vectors that are null, of zero length or all zeros, that hold null or non-finite
components, or whose length is not the table's most frequent one (the smaller of equally frequent
ones) take no part; of several rows of one id the smallest vector counts; ties go to the smaller id; a query with
fewer candidates than k gets all of them; a table without valid vectors gives an empty result. Only
the id and the vector are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize


@dataclass(frozen=True)
class Ann:
    k: int = 10
    #: rows the centroids, graph and ratio are fitted on, at most; every row is indexed
    sample: int = 20_000
    list_size: int = 128
    max_lists: int = 2_500
    #: replication: lists within this factor of the smallest distance, and at most so many
    spread: float = 1.10
    replicas: int = 2
    #: a list is left out if its centroid's distance to a chosen one is at most this share of that to the vector
    apart: float = 0.5
    neighbours: int = 24
    target_recall: float = 0.95
    calibration_queries: int = 200
    block_rows: int = 32_768
    seed: int = 7


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    graph: np.ndarray
    ratio: float
    dims: int


def valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _balanced(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row sets of at most ``most`` rows, by splitting the larger ones in two equal halves.

    A split orders rows by how much nearer they are to one of two means than to the other.
    """
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own = x[rows]
        a, b = own[rng.integers(len(own))], None
        a = own[((own - a) ** 2).sum(1).argmax()]
        b = own[((own - a) ** 2).sum(1).argmax()]
        for _ in range(6):
            lean = own @ (b - a)
            order = np.argsort(lean, kind="stable")
            half = len(own) // 2
            a, b = own[order[:half]].mean(0), own[order[half:]].mean(0)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0))


def _graph(centroids: np.ndarray, neighbours: int) -> np.ndarray:
    """Each centroid's nearest others, and a few far ones so that the graph hangs together."""
    n = len(centroids)
    near = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")[:, 1 : neighbours + 1]
    far = (np.arange(n)[:, None] + np.array([1, max(1, n // 3), max(1, 2 * n // 3)])[None]) % n
    return np.concatenate([near, far], axis=1)


def search_graph(index: Index, q: np.ndarray, wanted: int, reach: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids near ``q`` by best-first search, nearest first, with their distances.

    The search ends when the nearest node left is further than the ``wanted``-th found and, with
    ``reach``, also further than ``reach`` times the nearest.
    """
    c, start = index.centroids, 0
    d0 = float(np.linalg.norm(c[start] - q))
    seen, todo, best = {start}, [(d0, start)], [(d0, start)]
    while todo:
        d, at = heapq.heappop(todo)
        if len(best) >= wanted:
            bound = best[wanted - 1][0]
            if reach is not None:
                bound = max(bound, reach * best[0][0])
            if d > bound:
                break
        new = [j for j in dict.fromkeys(index.graph[at].tolist()) if j not in seen]
        if not new:
            continue
        seen.update(new)
        for dist, j in zip(np.linalg.norm(c[new] - q, axis=1).tolist(), new, strict=True):
            heapq.heappush(todo, (dist, j))
            best.append((dist, j))
        best.sort()
    return np.array([j for _, j in best]), np.array([d for d, _ in best])


def lists_of(index: Index, v: np.ndarray, cfg: Ann) -> list[int]:
    """The lists that hold vector ``v``: the nearest, and the replicas near a boundary."""
    at, d = search_graph(index, v, 4 * cfg.replicas)
    chosen: list[int] = []
    for j, dist in zip(at.tolist(), d.tolist(), strict=True):
        if len(chosen) >= cfg.replicas or dist > cfg.spread * d[0] and chosen:
            break
        if all(np.linalg.norm(index.centroids[j] - index.centroids[o]) > cfg.apart * dist for o in chosen):
            chosen.append(j)
    return chosen


def probes_of(index: Index, q: np.ndarray) -> list[int]:
    at, d = search_graph(index, q, 16, index.ratio)
    return at[d <= index.ratio * d[0]].tolist()


def fit(vectors: DataFrame, cfg: Ann = Ann()) -> tuple[Index | None, int]:
    """The index's centroids, graph and ratio, from a bounded sample; and the number of rows."""
    n = vectors.count()
    if not n:
        return None, 0
    share = min(1.0, 1.2 * cfg.sample / n)
    pick = F.xxhash64("id", F.lit(cfg.seed)) / F.lit(2.0**64) + F.lit(0.5)
    rows = vectors.where(pick < share).orderBy(F.xxhash64("id", F.lit(cfg.seed)), "id").limit(cfg.sample).collect() or vectors.limit(1).collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    rng = np.random.default_rng(cfg.seed)
    lists = int(min(max(1, n // cfg.list_size), cfg.max_lists, max(1, len(x) // 4)))
    parts = _balanced(x, -(-len(x) // lists), rng)
    centroids = np.array([x[p].mean(0) for p in parts])
    index = Index(centroids, _graph(centroids, cfg.neighbours), 1.0, x.shape[1])
    # the smallest ratio that finds the target share of the sample's own neighbours
    held: list[list[int]] = [[] for _ in centroids]
    for i, v in enumerate(x):
        for j in lists_of(index, v, cfg):
            held[j].append(i)
    queries = x[: cfg.calibration_queries]
    needed = []
    d_all, d_cent = _distances(queries, x), _distances(queries, centroids)
    where: dict[int, list[int]] = {}
    for j, rows_of in enumerate(held):
        for i in rows_of:
            where.setdefault(i, []).append(j)
    for qi in range(len(queries)):
        d_all[qi, qi] = np.inf
        nearest = np.argsort(d_all[qi], kind="stable")[: min(cfg.k, len(x) - 1)]
        needed += [min(d_cent[qi, where[i]]) / max(d_cent[qi].min(), 1e-12) for i in nearest.tolist()]
    ratio = float(np.quantile(needed, cfg.target_recall)) + 1e-9 if needed else 1.0
    return Index(centroids, index.graph, max(ratio, 1.0), x.shape[1]), n


@dataclass(frozen=True)
class Blocks:
    """Lists share blocks where a block holds several, and are dealt by id over ``splits`` where they are larger."""

    count: int
    splits: int

    @classmethod
    def of(cls, rows: int, lists: int, most: int) -> Blocks:
        wanted = max(1, -(-rows // most))
        return cls(wanted, 1) if wanted <= lists else cls(lists * -(-wanted // lists), -(-wanted // lists))

    def of_list(self, lists: np.ndarray) -> np.ndarray:
        """The first block of each list."""
        return lists * self.splits if self.splits > 1 else lists % self.count


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(index: Index, cfg: Ann, blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lists = [], []
            for i, v in enumerate(_vectors(batch.column("v"))):
                own = lists_of(index, v, cfg)
                row += [i] * len(own)
                lists += own
            taken, lists = batch.take(pa.array(row, pa.int64())), np.array(lists, np.int64)
            part = (taken.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(blocks.splits)
            block = blocks.of_list(lists) + part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(lists, pa.int32()), *taken.columns], names=["block", "list", "id", "v"])

    return run


def _probe(index: Index, blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block, lists = [], [], []
            for i, v in enumerate(_vectors(batch.column("v"))):
                by_block: dict[int, list[int]] = {}
                probes = np.array(probes_of(index, v))
                for j, first in zip(probes.tolist(), blocks.of_list(probes).tolist(), strict=True):
                    for b in range(first, first + blocks.splits):
                        by_block.setdefault(b, []).append(j)
                row += [i] * len(by_block)
                block += by_block
                lists += by_block.values()
            taken = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(lists, pa.list_(pa.int32())), *taken.columns], names=["block", "lists", "id", "v"])

    return run


def best_of(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows to ``q``, ties to smaller ids, with exact distances."""
    diff = v - q
    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    if len(d) > k:
        near = d <= np.partition(d, k - 1)[k - 1]
        ids, d = ids[near], d[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not rows.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        v, ids, lists = _vectors(rows.column("v").combine_chunks()), rows.column("id").to_numpy(), rows.column("list").to_numpy()
        order = np.argsort(lists, kind="stable")
        starts = {int(j): (a, b) for j, a, b in zip(*(lambda u, s: (u, s, [*s[1:], len(order)]))(*np.unique(lists[order], return_index=True)), strict=True)}
        out = []
        for q, x, probes in zip(queries.column("id").to_pylist(), _vectors(queries.column("v").combine_chunks()), queries.column("lists").to_pylist(), strict=True):
            at = [order[slice(*starts[j])] for j in probes if j in starts]
            if not at:
                continue
            at = np.concatenate(at)
            at = at[np.unique(ids[at], return_index=True)[1]]  # copies of a vector in several lists
            near, d = best_of(ids[at], v[at], x, k)
            out.append((np.full(len(near), q), near, d))
        if not out:
            return pa.table({c: pa.array([], t) for c, t in names.items()})
        return pa.table({c: pa.array(np.concatenate(p), t) for (c, t), p in zip(names.items(), zip(*out, strict=True), strict=True)})

    return run


def nearest(table: DataFrame, is_query: Column, cfg: Ann = Ann(), id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row for which ``is_query`` holds."""
    spark = table.sparkSession
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = sorted(rows.groupBy(F.size("v").alias("s")).count().collect(), key=lambda r: (-r["count"], r["s"]))
    rows = rows.where(F.size("v") == (sizes[0]["s"] if sizes else 0)).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = materialize(rows, "vectors")
    # the limit on ranks reaches below the shuffle, so that a vector of very many rows does not gather in one task
    held = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= cfg.k + 1).select("id", "v")
    index, n = fit(rows.select("id", "v"), cfg)
    result = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], result)
    asked = rows.where("q").select("id", "v")
    once = materialize(asked.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "queries")
    if n <= 4 * cfg.k:  # so few rows that a search could run out of candidates: one list
        index = Index(index.centroids[:1], np.zeros((1, 1), int), 1.0, index.dims)
    blocks = Blocks.of(2 * n, len(index.centroids), cfg.block_rows)
    kept = held.mapInArrow(_assign(index, cfg, blocks), "block int, list int, id long, v array<double>")
    probes = once.mapInArrow(_probe(index, blocks), "block int, lists array<int>, id long, v array<double>")
    # one more than wanted, as a query may find itself
    found = kept.groupBy("block").cogroup(probes.groupBy("block")).applyInArrow(_search(cfg.k + 1), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, cfg.k + 1).alias("best"))
    searched = best.join(once.hint("merge"), F.col("query_id") == F.col("id")).select("v", "best")
    own = F.filter("best", lambda b: b["vec_id"] != F.col("id"))
    each = asked.join(searched.hint("merge"), "v").select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, cfg.k)).alias("pos", "b"))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
