"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping.

A document's set holds the hashes of its distinct ``words``-word shingles (the whole sequence if it
is shorter). SuperMinHash gives each element one rank in every permutation step: step ``j`` places a
value in [j, j+1) at one position, so once every position holds a value below ``j+1`` the later
steps cannot change the signature and are skipped. Signatures are cut into bands; documents that
share a band are candidates, and every link is confirmed on the full sets.

Groups of any size stay cheap without emitting all their pairs:
1. equal sets fold into one class, represented by its smallest doc_id;
2. each representative is verified against one pivot: of those it shares a band with, the one that
   shares bands with the most others, which is near the center of its copies;
3. linked representatives are grouped; bands whose members are still in *different* groups are
   contested. Their members are joined on the rarest shingles of their sets, with the positions that
   a link of this similarity allows (prefix and positional filters, which lose no link), so that
   near copies that differ too much never meet, however many share a band; what meets is verified;
4. the groups are worked out again with those links.

Defined results: a null or empty text, or one without words, has no shingles and links with
nothing; rows with a null doc_id link with nothing, have a null component_id and are kept; repeated
rows of one doc_id fall in one group and are all kept if the doc_id is the smallest; an empty table
gives an empty result; texts of any length are used whole. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class NearDup:
    """Five-word shingles and 80 % similarity; 30 bands of 5 miss a pair at 80 % once in 150,000."""

    words: int = 5
    similarity_pct: int = 80
    bands: int = 30
    rows: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class _WordHashes(dict):
    """Hash of each word seen, bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, n)
    if n < words:
        # the sequence as one shingle; its length keeps it apart from longer ones
        return _mix(np.bitwise_xor.accumulate(_mix(ids + _GOLD * np.arange(1, n + 1, dtype=np.uint64)))[-1:] + np.uint64(n))
    h = ids[: n - words + 1]
    for k in range(1, words):
        h = _mix(h + _GOLD) + ids[k : n - words + 1 + k]
    return np.unique(_mix(h))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of non-empty sets, (len(sets), m); value = step in the high half, rank below."""
    size = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    signature = np.full(len(sets) * m, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for step in range(m):
        with np.errstate(over="ignore"):
            x = _mix(element + _GOLD * np.uint64(step + 1))
        pick = step + ((x >> _S32) * np.uint64(m - step) >> _S32).astype(np.int64)
        row = np.arange(len(element))
        at = pick if order is None else order[row, pick]
        np.minimum.at(signature, owner * m + at, (x & _LOW) | np.uint64(step << 32))
        open_ = signature.reshape(-1, m).max(axis=1) >= np.uint64((step + 1) << 32)
        if not open_.any():
            break
        more = open_[owner]
        if order is None:
            element, owner, pick = element[more], owner[more], pick[more]
            order = np.tile(np.arange(m, dtype=np.int16), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
        else:
            order[row, pick] = order[:, step]
            if more.mean() < 0.75:
                element, owner, order = element[more], owner[more], order[more]
    return signature.reshape(-1, m)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1, parts.shape[:2])
    for k in range(parts.shape[2]):
        h = _mix(h + _GOLD) ^ parts[:, :, k]
    return _mix(h).view(np.int64)


def _sign(p: NearDup, at_once: int = 32_768):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            size, digest, bands = [], [], [None] * batch.num_rows
            waiting: list[tuple[int, np.ndarray]] = []
            elements = 0

            def flush():
                if waiting:
                    made = band_hashes(super_minhash([s for _, s in waiting], p.bands * p.rows), p.bands)
                    for (i, _), b in zip(waiting, made, strict=True):
                        bands[i] = b
                    waiting.clear()

            for i, text in enumerate(batch.column("text")):
                s = shingle_set(text.as_py(), p.words, hashes)
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    waiting.append((i, s))
                    elements += len(s)
                    if elements >= at_once:
                        flush()
                        elements = 0
            flush()
            half = np.frombuffer(b"".join(digest), dtype=">i8").astype("i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(half[:, 0]), pa.array(half[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return run


def _verify(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, recent = _WordHashes(), {}

        def of(doc: int, text: str) -> np.ndarray:
            if doc not in recent:
                if len(recent) >= 64:
                    recent.pop(next(iter(recent)))
                recent[doc] = shingle_set(text, p.words, hashes)
            return recent[doc]

        for batch in batches:
            linked = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                x = of(a, batch.column("text_a")[i].as_py())
                y = of(b, batch.column("text_b")[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= p.similarity_pct * (len(x) + len(y) - both):
                    linked.append(i)
            yield batch.select(["a", "b"]).take(pa.array(linked, pa.int64()))

    return run


def _list_shingles(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), p.words, hashes) for t in batch.column("text")]
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), batch.column("doc_id").take(pa.array(owner, pa.int64()))], names=["token", "doc"])

    return run


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: each node with its smallest known partner."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(root)]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component the smallest node reachable.

    Union-find within each partition first, then large-star and small-star steps until every edge
    points from a node to the smallest node of its group. Nothing is gathered on the driver.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            made = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return made.where("a > b").distinct()

    def figure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = materialize(edges.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct(), "forest")
    before = figure(e)
    while before[0]:
        e = materialize(stars(stars(e, large=True), large=False), "stars")
        after = figure(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _prefix_pairs(contested: DataFrame, texts: DataFrame, p: NearDup) -> DataFrame:
    """(a, b) with a > b: all pairs of contested documents (doc, n, g, minor) of different groups, one of
    them minor, that can reach the similarity by their rarest shingles; any linked pair is among them.

    Two sets of x and y shingles that are similar enough share at least ``need`` of them. With all
    shingles in one order, their first common one stands at most at x - need and y - need.
    """
    t = p.similarity_pct
    named = texts.join(contested.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    listed = named.mapInArrow(_list_shingles(p), "token long, doc long")
    often = listed.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one document alone come first in the order and join with nothing: only their number counts
    own = listed.join(often.hint("merge"), "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    own = own.join(contested.hint("merge"), "doc").withColumn("alone", F.col("n") - F.size("common"))
    furthest = F.col("n") - F.floor((F.col("n") * t + 99) / 100)
    prefix = own.withColumn("common", F.slice("common", F.lit(1), F.greatest(F.lit(0).cast("long"), furthest - F.col("alone") + 1).cast("int")))
    prefix = prefix.select("doc", "n", "g", "minor", "alone", F.posexplode("common").alias("i", "s")).select("doc", "n", "g", "minor", (F.col("alone") + F.col("i")).alias("at"), "s.token")
    prefix = materialize(prefix, "prefixes")
    one = prefix.where("minor").select("token", *[F.col(c).alias(f"{c}_a") for c in ("doc", "n", "g", "at")])
    need = F.floor(((F.col("n_a") + F.col("n")) * t + 99 + t) / (100 + t))
    can = (F.col("at_a") + need <= F.col("n_a")) & (F.col("at") + need <= F.col("n"))
    meets = (F.col("g_a") != F.col("g")) & (~F.col("minor") | (F.col("doc_a") > F.col("doc"))) & can
    return prefix.join(one.hint("merge"), "token").where(meets).select(F.greatest("doc_a", "doc").alias("a"), F.least("doc_a", "doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign(p), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("rep", "n", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = materialize(members.join(buckets.hint("merge"), "band"), "shared-bands")
    # who shares bands with many is at the center of its copies
    shared = materialize(sized.join(sized.groupBy("rep").agg(F.sum("size").alias("weight")).hint("merge"), "rep").drop("size"), "weighted-bands")
    pivots = shared.groupBy("band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("top"))
    texts = materialize(docs.join(shared.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "candidate-texts")
    verify = lambda pairs: materialize(
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
        .mapInArrow(_verify(p), "a long, b long"),
        "links",
    )
    chosen = shared.select("band", "rep").join(pivots.hint("merge"), "band").where(F.col("rep") != -F.col("top.rep")).groupBy("rep").agg(F.max("top").alias("top"))
    first = materialize(chosen.select(F.greatest("rep", -F.col("top.rep")).alias("a"), F.least("rep", -F.col("top.rep")).alias("b")).distinct(), "pivot-pairs")
    links = verify(first)
    # what is contested: the members of bands of several groups; minor: not in the largest of a band
    grouped = shared.join(components(links).withColumnRenamed("node", "rep").hint("merge"), "rep", "left").withColumn("g", F.coalesce("component", "rep")).drop("component", "weight")
    grouped = materialize(grouped, "grouped-bands")
    per_band = grouped.groupBy("band", "g").agg(F.count("*").alias("k"))
    main = per_band.groupBy("band").agg(F.max_by("g", F.struct("k", -F.col("g"))).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    contested = grouped.join(main.hint("merge"), "band").groupBy(F.col("rep").alias("doc")).agg(F.first("n").alias("n"), F.first("g").alias("g"), F.max(F.col("g") != F.col("main")).alias("minor"))
    rest = materialize(_prefix_pairs(materialize(contested, "contested"), texts, p).join(first.hint("merge"), ["a", "b"], "left_anti"), "contested-pairs")
    groups = components(links.union(verify(rest)))
    of_class = classes.select("d1", "d2", "rep").join(groups.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("group"))
    alone = F.col("n_shingles") == 0
    found = signed.select("doc_id", "n_shingles", "d1", "d2").join(of_class.hint("merge"), ["d1", "d2"], "left")
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("group"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; the columns of ``docs``."""
    gone = near_duplicates(docs, p).where(~F.col("kept")).select(F.col("doc_id").alias("__n_id")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col("__n_id"), "left_anti")
