"""SentencePiece encoding and decoding over a relational lattice.

Encoding: documents are dealt into chunks of bounded size; each chunk lists its distinct segments
(stretches of text that no piece can reach across); over the distinct segments of all chunks,
bounded-length substrings are exploded and equi-joined to the piece table, the edges are grouped by
segment, and a higher-order aggregate folds each lattice into the bounds of its pieces. They go back
to the chunks that list the segment, joined by it, and each chunk writes out its documents.

The fold follows the kind of model. A unigram model takes Viterbi's best path. A BPE model's
scores are merge ranks, whose best path is *not* the encoding of that model; there the fold takes,
step by step, the edge of best rank that joins two neighbouring pieces, leftmost first.

Segments longer than ``LONGEST`` code points do not fit the fold's bit masks; chunks encode those
few with the same rule in Python (``merge_long``, or Viterbi for unigram models).

Defined results: null and empty texts have no ids and decode to an empty text; characters outside
the vocabulary become byte pieces, or the unknown piece in models without them; repeated rows are
encoded alike; an empty table gives an empty result; texts of any length are encoded whole. All
columns but ``text`` pass through. A text with U+2581 decodes with spaces in its place, as in the
library itself.
"""

from __future__ import annotations

import ctypes
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
LONGEST = 60
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class PieceTable:
    """Pieces of a model: (piece, id, score); byte0 is the id of byte 0 or None."""

    pieces: tuple[tuple[str, int, float], ...]
    unigram: bool
    unknown: int = 0
    byte0: int | None = None
    dummy_prefix: bool = True
    names: tuple[bytes, ...] = field(default=(), repr=False)

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    def pairs(self) -> frozenset[str]:
        """Neighbouring characters inside any piece; a text can be cut between all others."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))


def load_model(path: str) -> PieceTable:
    """The piece table of a model file; raises ValueError for normalizers other than the identity."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kind = model.normalizer_spec, model.trainer_spec.model_type
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kind not in (1, 2):
        raise ValueError("only unigram and BPE models with the identity normalizer are supported")
    ids = {p.piece: i for i, p in enumerate(model.pieces)}
    byte0 = ids.get("<0x00>") if model.trainer_spec.byte_fallback else None
    if byte0 is not None and any(ids.get(f"<0x{b:02X}>") != byte0 + b for b in range(256)):
        raise ValueError("byte pieces must follow each other")
    names = tuple(bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.encode() for p in model.pieces)
    normal = tuple((p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4))
    return PieceTable(normal, kind == 1, model.trainer_spec.unk_id, byte0, norm.add_dummy_prefix, names)


# ---------------------------------------------------------------- segments


class Cutter:
    """Cuts words into segments wherever no piece has the two characters side by side; many at once."""

    DENSE = 1024

    def __init__(self, table: PieceTable):
        pairs = np.array(sorted(self._key(ord(p[0]), ord(p[1])) for p in table.pairs()), np.uint64)
        self.pairs = pairs
        self.dense = np.zeros((self.DENSE, self.DENSE), bool)
        for p in pairs.tolist():
            if p >> 32 < self.DENSE and p & 0xFFFFFFFF < self.DENSE:
                self.dense[p >> 32, p & 0xFFFFFFFF] = True

    @staticmethod
    def _code(c: int) -> int:
        return 1 if c == ord(SPACE) else c  # the space sign among the low codes; a cut left out does no harm

    def _key(self, a: int, b: int) -> int:
        return self._code(a) << 32 | self._code(b)

    def __call__(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """All segments of ``words`` (none empty) in order, and where each word's segments end."""
        segments, ends = self.segments(pa.array(words, pa.large_string()))
        return segments.to_pylist(), ends

    def segments(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The same of large strings in Arrow: the segments share the words' bytes, none becomes a Python object."""
        if not len(words):
            return pa.array([], pa.large_string()), np.zeros(0, np.int64)
        _, offsets, data = words.buffers()
        upto = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
        data = data.slice(int(upto[0]), int(upto[-1] - upto[0]))
        code = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32).copy()
        # bytes up to and with each code point
        bytes_to = np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000))
        code[code == ord(SPACE)] = 1
        a, b = code[:-1], code[1:]
        linked = np.zeros(len(a), bool)
        low = (a < self.DENSE) & (b < self.DENSE)
        linked[low] = self.dense[a[low], b[low]]
        if len(self.pairs) and not low.all():
            key = (a[~low].astype(np.uint64) << np.uint64(32)) | b[~low].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[~low] = self.pairs[at] == key
        ends = np.searchsorted(bytes_to, upto[1:] - upto[0]) + 1
        cut = np.append(~linked, True)
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        bounds = np.concatenate([[0], bytes_to[stops - 1]])
        return pa.LargeStringArray.from_buffers(len(stops), pa.py_buffer(bounds), data), np.searchsorted(stops, ends) + 1


def words_of(text: str | None, table: PieceTable) -> list[str]:
    if not text:
        return []
    return _WORD.findall((SPACE if table.dummy_prefix else "") + text.replace(" ", SPACE))


def spell(char: str, table: PieceTable) -> list[int]:
    """Ids of a character that is no piece."""
    return [table.unknown] if table.byte0 is None else [table.byte0 + b for b in char.encode()]


def merge_long(segment: str, table: PieceTable, by_piece: dict[str, tuple[int, float]]) -> list[int]:
    """The BPE rule for one segment of any length, with a heap: n log n."""
    n = len(segment)
    end, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (found := by_piece.get(segment[a : end[b]])):
            heapq.heappush(heap, (-found[1], a, end[b]))

    for i in range(n):
        offer(i)
    while heap:
        _, a, to = heapq.heappop(heap)
        b = end[a] if live[a] else n
        if b >= n or end[b] != to:
            continue
        live[b], end[a] = False, to
        if to < n:
            before[to] = a
            offer(a)
        else:
            pass
        if before[a] >= 0:
            offer(before[a])
    out: list[int] = []
    i = 0
    while i < n:
        piece = segment[i : end[i]]
        out += [by_piece[piece][0]] if piece in by_piece else spell(piece, table)
        i = end[i]
    return out


def viterbi_long(segment: str, table: PieceTable, by_piece: dict[str, tuple[int, float]]) -> list[int]:
    """The unigram rule for one segment of any length."""
    n, longest = len(segment), table.longest
    worst = min((s for _, _, s in table.pieces), default=0.0) - 10.0
    best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
    for to in range(1, n + 1):
        options = [(best[a][0] + by_piece[p][1], a, [by_piece[p][0]]) for a in range(max(0, to - longest), to) if (p := segment[a:to]) in by_piece]
        if segment[to - 1] not in by_piece:
            options.append((best[to - 1][0] + worst, to - 1, spell(segment[to - 1], table)))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out: list[list[int]] = []
    while n:
        out.append(best[n][2])
        n = best[n][1]
    return [i for ids in reversed(out) for i in ids]


# ---------------------------------------------------------------- the lattice


def revives(table: PieceTable) -> set[str]:
    """Pieces whose making lets a piece of the same or a better rank be made next, from them and a neighbour."""
    score = {p: x for p, _, x in table.pieces}
    found = set()
    for piece, own in score.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if all(len(x) == 1 or x in score for x in (left, right)):
                found.update(x for x in (left, right) if len(x) > 1 and score[x] <= own)
    return found


def piece_rows(spark: SparkSession, table: PieceTable) -> DataFrame:
    """(piece, id, score, rank, revives); as large as the vocabulary, a fixed bound."""
    rank = {s: i for i, s in enumerate(sorted({s for _, _, s in table.pieces}, reverse=True))}
    again = set() if table.unigram else revives(table)
    return spark.createDataFrame([(p, i, s, rank[s], int(p in again)) for p, i, s in table.pieces], "piece string, id int, score double, rank int, revives int")


def _bind(value: Column, f) -> Column:
    """f of a value that is worked out once: a lambda's variable, where a plain column would be copied in."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _pack_edge(rank: Column, at: Column, size: Column, revives: Column) -> Column:
    """An edge as one long that sorts by rank, then place: 6 bits of place, 6 of size, 2 for whether it revives."""
    shift = lambda c, k: F.call_function("shiftleft", c.cast("long"), F.lit(k))
    return shift(rank, 14) + shift(at, 8) + shift(size, 2) + revives


def _bits_of(edge: Column, low: int, size: int) -> Column:
    return F.call_function("shiftright", edge, F.lit(low)).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("int")


#: above the bits of all places: the pass must end, since a better edge may fit now
STOP = 1 << 62


def _bpe_bounds(n: Column, edges: Column) -> Column:
    """Bit i is set if a piece begins at code point i (bit n: the end).

    An edge joins two neighbouring pieces if its ends are bounds and exactly one bound lies inside.
    A pass takes the edges that fit from the best rank on, leftmost first; it ends early behind an
    edge that may let one fit that the pass has left behind, and then another pass follows.
    """
    stop = F.lit(STOP).cast("long")
    def taken(b: Column, e: Column) -> Column:
        held = b.bitwiseAND(e["reach"])
        fits = (F.bit_count(held) == 3) & (held.bitwiseAND(e["ends"]) == e["ends"])
        return F.when(fits & (b < stop), b - held + e["ends"] + e["stop"]).otherwise(b)
    def spread(e: Column) -> Column:
        ends = lambda size: F.call_function("shiftleft", _bit(size) + 1, _bits_of(e, 8, 6))
        reach = lambda size: F.call_function("shiftleft", _bit(size + 1) - 1, _bits_of(e, 8, 6))
        size = _bits_of(e, 2, 6)
        return F.struct(ends(size).alias("ends"), reach(size).alias("reach"), F.call_function("shiftleft", e.bitwiseAND(F.lit(1).cast("long")), F.lit(62)).alias("stop"))
    whole = _bit(n + 1) - 1
    passes = lambda listed: F.aggregate(F.sequence(F.lit(1), n), whole + stop, lambda b, _: F.when(b < stop, b).otherwise(F.aggregate(listed, b - stop, taken)))
    return F.when(F.size(edges) == 0, whole).otherwise(_bind(F.transform(edges, spread), passes))


def _unigram_bounds(n: Column, edges: Column, worst: float) -> Column:
    """The same by Viterbi: the fold appends to each end its best score and where that piece began."""
    state = "array<struct<score:double,at:int>>"
    def grow(best: Column, to: Column) -> Column:
        options = F.transform(
            F.filter(edges, lambda e: e["at"] + e["len"] == to),
            lambda e: F.struct((F.get(best, e["at"])["score"] + e["score"]).alias("score"), (-e["at"]).alias("at")),
        )
        known = F.exists(edges, lambda e: (e["len"] == 1) & (e["at"] + 1 == to))
        single = F.array(F.struct((F.get(best, to - 1)["score"] + F.lit(worst)).alias("score"), (1 - to).alias("at")))
        top = F.array_max(F.when(known, options).otherwise(F.concat(options, single)))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["at"]).alias("at"))).cast(state))
    best = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("at"))).cast(state), grow)
    bit = _bit
    back = lambda b: F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(n.alias("at"), bit(n).alias("bits")),
        lambda s, _: F.when(s["at"] == 0, s).otherwise(F.struct(F.get(b, s["at"])["at"].alias("at"), s["bits"].bitwiseOR(bit(F.get(b, s["at"])["at"])).alias("bits"))),
    )["bits"]
    return _bind(best, back)


def cut_segments(segments: DataFrame, table: PieceTable) -> DataFrame:
    """(seg, bounds) of (sid, seg): explode, equi-join, group, fold; bit i of bounds is set where a piece begins.

    Segments have at most LONGEST code points and occur once; other columns are not read. The BPE
    fold never asks for edges of one code point, so those are not listed for it; one row without an
    edge stands for each segment.
    """
    spark = segments.sparkSession
    pieces = F.broadcast(piece_rows(spark, table))
    size = F.length("seg")
    least = 1 if table.unigram else 2
    starts = segments.select("sid", "seg", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), size - least))).alias("at"))
    spans = starts.select("sid", "seg", "at", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.least(F.lit(table.longest), size - F.col("at"))))).alias("len"))
    spans = spans.select("sid", "seg", "at", "len", F.substring("seg", F.col("at") + 1, F.col("len")).alias("piece"))
    stands = (F.col("at") == 0) & (F.col("len") == least)
    # a segment shorter than the least edge has none, though its stand-in may spell a piece
    fits = F.col("id").isNotNull() & (F.col("at") + F.col("len") <= size)
    edges = spans.join(pieces, "piece", "left").where(fits | stands)
    if table.unigram:
        edge = F.struct("at", "len", "score")
        bounds = _unigram_bounds(F.col("n"), F.col("edges"), min((s for _, _, s in table.pieces), default=0.0) - 10.0)
    else:
        edge = _pack_edge(F.col("rank"), F.col("at"), F.col("len"), F.col("revives"))
        bounds = _bpe_bounds(F.col("n"), F.col("edges"))
    lattice = edges.groupBy("sid", "seg").agg(F.sort_array(F.collect_list(F.when(fits, edge))).alias("edges")).withColumn("n", size)
    return lattice.select("seg", bounds.alias("bounds"))


def ids_between(segments: list[str], bounds: np.ndarray, table: PieceTable, by_piece: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces that ``bounds`` cut the segments into, one after the other, and where each segment's end."""
    whole = "".join(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    place = np.arange(len(whole)) - np.repeat(ends - sizes, sizes)
    begins = np.flatnonzero(np.repeat(bounds, sizes) >> place & 1)
    listed = begins.tolist()
    pieces = [whole[a:b] for a, b in zip(listed, [*listed[1:], len(whole)], strict=True)] if listed else []
    ids = np.fromiter((by_piece[p][0] if p in by_piece else -1 for p in pieces), np.int32, len(pieces))
    upto = np.searchsorted(begins, ends)
    odd = np.flatnonzero(ids < 0)
    if len(odd):
        made = [spell(pieces[k], table) for k in odd.tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[odd] = [len(m) for m in made]
        after = np.concatenate([[0], np.cumsum(wide)])
        ids = np.repeat(ids, wide)
        for k, m in zip(odd.tolist(), made, strict=True):
            ids[after[k] : after[k + 1]] = m
        upto = after[upto]
    return ids, upto


def _pieces_by_text(table: PieceTable) -> dict[str, tuple[int, float]]:
    return {p: (i, x) for p, i, x in table.pieces}


def encode_segments(segments: DataFrame, table: PieceTable) -> DataFrame:
    """(seg, ids) of (sid, seg)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_piece = _pieces_by_text(table)
        for batch in batches:
            ids, upto = ids_between(_strings(batch.column("seg")), batch.column("bounds").to_numpy(), table, by_piece)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("seg"), lists], names=["seg", "ids"])

    return cut_segments(segments, table).mapInArrow(run, "seg string, ids array<int>")


# ---------------------------------------------------------------- documents


def _give_back() -> None:
    """Free memory of Arrow and of C goes back to the system: a worker keeps it else, in a blob's loop and when it is idle."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _pack(labels: list[int], blob_bytes: int = 2 << 20):
    """Rows as compressed Arrow blobs of about ``blob_bytes`` each, given to a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            at = 0
            each = max(1, int(batch.num_rows * blob_bytes / max(1, batch.nbytes)))
            while at < batch.num_rows:
                part = pa.Table.from_batches([batch.slice(at, each)]).combine_chunks()
                at += each
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_table(part)
                blob = squeeze.compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([labels[xxhash.xxh3_64_intdigest(blob) % len(labels)]], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "blob"])
            batch = part = None  # not held while the next one is read
            _give_back()

    return run


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def splits_plainly(table: PieceTable) -> bool:
    """Whether every text begins with a space sign, and no piece holds a line feed."""
    return table.dummy_prefix and not any("\n" in p for p, _, _ in table.pieces)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def column_words(texts: pa.Array, table: PieceTable, plainly: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, codes, counts, order): the words of a column of texts as large strings, nearly all once, each occurrence
    as a place in ``words``, the occurrences of each text, and where each text stands among the counts.

    With ``plainly`` most texts are cut by Arrow at single spaces and before line feeds, which no piece
    holds; those with runs of spaces or the space sign take the pattern of ``words_of``.
    """
    texts = texts.fill_null("")
    odd = pc.match_substring_regex(texts, f"^$|^ |  |{SPACE}").to_numpy(zero_copy_only=False).astype(bool) if plainly else np.ones(len(texts), bool)
    plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    found = plain.flatten().dictionary_encode()
    listed = found.dictionary.cast(pa.large_string())
    sign = pc.if_else(pc.starts_with(listed, "\n"), pa.scalar("", pa.large_string()), pa.scalar(SPACE, pa.large_string()))
    words = pc.binary_join_element_wise(sign, listed, pa.scalar("", pa.large_string()))
    codes = [found.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    counts = [pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)]
    place: dict[str, int] = {}
    for text in texts.filter(pa.array(odd)).to_pylist():
        own = words_of(text, table)
        codes.append(np.array([place.setdefault(w, len(words) + len(place)) for w in own], np.int64))
        counts.append(np.array([len(own)], np.int64))
    order = np.empty(len(texts), np.int64)
    order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(texts))
    return pa.concat_arrays([words, pa.array(list(place), pa.large_string())]), np.concatenate(codes), np.concatenate(counts), order


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _list_segments(table: PieceTable):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cut, plainly, segs = Cutter(table), splits_plainly(table), pa.array([], pa.large_string())
        for blob in rows.column("blob"):
            new = cut.segments(column_words(_whole(_unpack(blob.as_py()).column("text")), table, plainly)[0])[0].unique()
            segs = pa.concat_arrays([segs, new.filter(pc.less_equal(pc.utf8_length(new), LONGEST))]).unique()
            _give_back()
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(segs), pa.int32()), "seg": segs.cast(pa.string())})

    return run


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


class _WordIds:
    """Ids of words from the encodings of their segments, which stay in Arrow: as keys of a dictionary, with the words
    seen so far in another, they took most of the memory of a chunk's task."""

    def __init__(self, table: PieceTable, segments: list[str] | pa.Array, bounds: np.ndarray, at_once: int = 1 << 14):
        self.table, self.segs = table, pa.array(segments, pa.large_string()) if isinstance(segments, list) else segments.cast(pa.large_string())
        self.cut, self.by_piece = Cutter(table), _pieces_by_text(table)
        # some at a time: the pieces of a whole chunk as strings would be the most that the task holds
        parts = [ids_between(_strings(self.segs.slice(k, at_once)), bounds[k : k + at_once], table, self.by_piece) for k in range(0, len(self.segs), at_once)]
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        self.ids = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)])
        ends = np.concatenate([np.zeros(0, np.int64), *(upto + b for (_, upto), b in zip(parts, before, strict=False))])
        self.at = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.size = ends - self.at

    def _long(self, segment: str) -> list[int]:
        return (viterbi_long if self.table.unigram else merge_long)(segment, self.table, self.by_piece)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, starts, sizes): each word's ids are its stretch of ``pool``."""
        segments, ends = self.cut.segments(words)
        segments = segments.dictionary_encode()
        # the words' segments are the set that is hashed, as they are fewer than the chunk's
        found = pc.index_in(self.segs, value_set=segments.dictionary).fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(found >= 0)
        place = np.full(len(segments.dictionary), -1, np.int64)
        place[found[held]] = held
        long = np.flatnonzero(place < 0)
        made = [np.array(self._long(s), np.int32) for s in segments.dictionary.take(pa.array(long)).to_pylist()]
        ids, at, size = self.ids, self.at, self.size
        if made:
            place[long] = len(at) + np.arange(len(made))
            size = np.append(size, [len(x) for x in made])
            at = np.append(at, len(ids) + np.cumsum([0, *(len(x) for x in made[:-1])]))
            ids = np.concatenate([ids, *made])
        place = place[segments.indices.to_numpy(zero_copy_only=False)]
        total = np.concatenate([[0], np.cumsum(size[place])])
        # ends of the words' segments to ends of their ids
        stops = total[ends] if len(ends) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops
        return _gather(ids, at[place], size[place]), starts, stops - starts


def _names(table: PieceTable) -> pa.Array:
    """The bytes of each id, and none at the end for ids outside the vocabulary."""
    return pa.array([*table.names, b""], pa.large_binary())


def _spell_out(names: pa.Array, dummy_prefix: bool, ids: pa.Array) -> pa.Array:
    """Texts of lists of ids."""
    last = len(names) - 1
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    pieces = names.take(pa.array(np.where((flat < 0) | (flat > last), last, flat)))
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    _, offsets, data = pieces.buffers()
    stops = np.frombuffer(offsets, np.int64, len(pieces) + 1, pieces.offset * 8)[np.concatenate([[0], ends])] if len(pieces) else np.zeros(len(ids) + 1, np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(stops), data])
    try:
        texts = whole.cast(pa.large_string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
    texts = pc.replace_substring(texts, SPACE, " ")
    return (pc.replace_substring_regex(texts, r"\A ", "", max_replacements=1) if dummy_prefix else texts).cast(pa.string())


def _write_out(table: PieceTable, columns: list[str], digest: bool):
    made_here = ["n_tokens", "ids", *["decoded_sha256"] * digest]
    kept = [c for c in columns if c not in made_here]
    def run(rows: pa.Table, encoded: pa.Table) -> pa.Table:
        words = _WordIds(table, _whole(encoded.column("seg")), _whole(encoded.column("bounds")).to_numpy(zero_copy_only=False))
        made, plainly, names = [], splits_plainly(table), _names(table)
        for blob in rows.column("blob"):
            part = _unpack(blob.as_py())
            listed, codes, counts, order = column_words(_whole(part.column("text")), table, plainly)
            pool, starts, sizes = words.encode(listed)
            sizes = sizes[codes]
            coded = _gather(pool, starts[codes], sizes)
            total = np.concatenate([[0], np.cumsum(sizes)])
            at = total[np.concatenate([[0], np.cumsum(counts)])]
            out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(coded)).take(pa.array(order))
            # copied, as columns that are slices of the blob would hold its texts until the chunk is done
            whole = pa.array(np.arange(part.num_rows))
            done = [*(part.column(c).take(whole) for c in kept), pa.array(np.diff(at)[order], pa.int64()), out]
            if digest:  # blob by blob, so that the decoded text of a chunk is never held at once
                texts = _spell_out(names, table.dummy_prefix, out)
                done.append(pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.binary()).to_pylist()], pa.string()))
            made.append(pa.table(done, names=[*kept, *made_here]))
            _give_back()
        return pa.concat_tables(made)

    return run


def _labels(spark: SparkSession, chunks: int) -> list[int]:
    """A label for each chunk, so that dealing rows by label to ``chunks`` partitions gives each one chunk."""
    held = spark.range(64 * chunks + 64).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(chunks)).alias("part")).agg(F.min("label").alias("label"))
    found = {r["part"]: r["label"] for r in held.collect()}
    return [found.get(k, 64 * chunks + 64 + k) for k in range(chunks)]


def encode(docs: DataFrame, table: PieceTable, chunk_bytes: int = 36 << 20, digest: bool = False) -> DataFrame:
    """Rows of ``docs`` without their text, with n_tokens and ids (array of int); with ``digest`` also
    decoded_sha256, the SHA-256 of the text that the ids decode to, worked out where they are written."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // chunk_bytes
    docs = docs.drop("n_tokens", "ids", *["decoded_sha256"] * digest)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    out = T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded_sha256", T.StringType())] * digest])
    blobs = docs.mapInArrow(_pack(_labels(docs.sparkSession, chunks)), "chunk int, blob binary").repartition(chunks, "chunk")
    # counts of their own: a segment becomes dozens of lattice rows, which its shuffled size does not tell
    listed = blobs.groupBy("chunk").applyInArrow(_list_segments(table), "chunk int, seg string").repartition(4 * chunks, "seg")
    # the chunk is kept in use: without it the list would be another shuffle than the one joined below
    segments = listed.groupBy("seg").agg(F.min("chunk").alias("sid"))
    encoded = listed.join(cut_segments(segments, table).hint("merge"), "seg").select("chunk", "seg", "bounds")
    return blobs.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(_write_out(table, out.names, digest), out)


def decode(rows: DataFrame, table: PieceTable, ids: str = "ids", most: int = 1 << 20) -> DataFrame:
    """``rows`` with the text of their ids as ``decoded``, their last column; null ids and ids outside the
    vocabulary are skipped.

    In Arrow, some ``most`` ids at a time (a longer list by itself): as an expression, the vocabulary would stand
    in every description of the plan that the driver keeps.
    """
    rows = rows.drop("decoded")
    names = _names(table)
    out, dummy_prefix = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]), table.dummy_prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                part = batch.slice(at, to - at)
                at = to
                yield pa.RecordBatch.from_arrays([*part.columns, _spell_out(names, dummy_prefix, part.column(ids))], names=out.names)

    return rows.mapInArrow(run, out)
