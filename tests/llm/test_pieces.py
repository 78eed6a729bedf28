import hashlib
import itertools
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import pieces

from .helpers import empty_documents, odd_documents

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@needs_model
def test_equals_the_library_and_round_trips(spark):
    import sentencepiece

    random.seed(3)
    texts = [None, "", " ", "  lead and trail  ", "Hello, world! \n\tTabs", "日本語と한국어 😀", "a" * 300, "x" * 61 + "e" * 70 + " " * 45 + "q", "é" * 200, "\x00\x01", "1234567890" * 20]
    texts += ["".join(random.choice("abcdeht  ,.\né語") for _ in range(random.randint(1, 300))) for _ in range(40)]
    table = pieces.load_model(MODEL)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.decode(pieces.encode(docs, table, chunk_bytes=4000), table).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == reference.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.decoded == (texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


@needs_model
def test_odd_rows(spark):
    table = pieces.load_model(MODEL)
    docs = odd_documents(spark)
    got = pieces.decode(pieces.encode(docs, table), table)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids", "decoded"]
    assert sorted(r.decoded for r in got.collect()) == sorted(r.text or "" for r in docs.collect())
    assert pieces.encode(empty_documents(spark), table).count() == 0
    digests = pieces.encode(docs.withColumn("decoded_sha256", F.lit("of another")), table, digest=True)
    assert digests.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids", "decoded_sha256"]
    assert sorted(r.decoded_sha256 for r in digests.collect()) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())


@needs_model
def test_decoding_a_few_ids_at_a_time(spark):
    table = pieces.load_model(MODEL)
    rows = [(i, [table.byte0 + 65 + k for k in range(i % 7)] if i % 5 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1)
    want = {i: "".join(chr(65 + k) for k in range(len(x or []))) for i, x in rows}
    assert {r.i: r.decoded for r in pieces.decode(docs, table, most=4).collect()} == want


@needs_model
def test_decoding_any_ids(spark):
    table = pieces.load_model(MODEL)
    byte = lambda b: table.byte0 + b
    rows = [(1, None), (2, []), (3, [byte(0xC3), byte(0xA9)]), (4, [byte(0xC3)]), (5, [10**6, byte(65), -1]), (6, [0, 1, 2]), (7, [byte(10), byte(9), byte(0)])]
    got = {r.i: r.decoded for r in pieces.decode(spark.createDataFrame(rows, "i int, ids array<int>"), table).collect()}
    assert got == {1: "", 2: "", 3: "é", 4: "\ufffd", 5: "A", 6: "", 7: "\n\t\x00"}


def _score(parts, scores):
    return sum(scores[p] for p in parts)


def test_unigram_models_take_the_best_path(spark):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -2.2, "aba": -4.6, "▁a": -2.1, "bb": -6.0, "abab": -5.5}
    table = pieces.PieceTable(tuple((p, i + 1, s) for i, (p, s) in enumerate(scores.items())), unigram=True, unknown=0)
    id_of = {p: i for p, i, _ in table.pieces}

    def brute(word):
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:k])
                    last = k
            parts.append(word[last:])
            if all(p in scores for p in parts) and (best is None or _score(parts, scores) > best + 1e-12):
                best = _score(parts, scores)
        return best

    words = ["▁" + "".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)]
    segments = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "sid long, seg string, carry int")
    by_id = {i: p for p, i in id_of.items()}
    by_piece = {p: (i, s) for p, i, s in table.pieces}
    for r in pieces.encode_segments(segments, table).collect():
        parts = [by_id[i] for i in r.ids]
        assert "".join(parts) == r.seg and abs(_score(parts, scores) - brute(r.seg)) < 1e-9
        long = [by_id[i] for i in pieces.viterbi_long(r.seg, table, by_piece)]
        assert "".join(long) == r.seg and abs(_score(long, scores) - brute(r.seg)) < 1e-9
    unknown = pieces.encode_segments(spark.createDataFrame([(1, "ax", 1)], "sid long, seg string, carry int"), table).first()
    assert unknown.ids == [id_of["a"], 0]


def test_segments_cut_only_where_no_piece_reaches():
    table = pieces.PieceTable((("ab", 1, -1.0), ("▁a", 2, -2.0), ("語x", 3, -3.0)), unigram=False)
    segs, ends = pieces.Cutter(table)(["▁ab", "ba", "語xy", "q"])
    assert segs == ["▁ab", "b", "a", "語x", "y", "q"] and ends.tolist() == [1, 3, 5, 6]


def test_segments_encoded_a_few_at_a_time():
    table = pieces.PieceTable((("ab", 1, -1.0), ("a", 2, -2.0), ("b", 3, -3.0)), unigram=False)
    segments, bounds = ["ab", "aba", "b", "xab"], np.array([0b101, 0b1101, 0b11, 0b1011])
    whole = pieces._WordIds(table, segments, bounds)
    for at_once in (1, 2, 3):
        parts = pieces._WordIds(table, segments, bounds, at_once=at_once)
        assert parts.ids.tolist() == whole.ids.tolist() == [1, 1, 2, 3, 0, 1]
        assert parts.at.tolist() == whole.at.tolist() and parts.size.tolist() == whole.size.tolist()
    assert pieces._WordIds(table, [], np.zeros(0, np.int64)).ids.tolist() == []


def test_a_chunk_that_is_written_keeps_no_texts():
    table = pieces.PieceTable((("ab", 1, -1.0), ("a", 2, -2.0), ("b", 3, -3.0), ("aa", 4, -4.0), ("ba", 5, -5.0), ("bb", 6, -6.0)), unigram=False)
    random.seed(7)
    texts = [" ".join("".join(random.choice("cdefghij") for _ in range(3)) + "".join(random.choice("ab") for _ in range(14)) for _ in range(2000)) for _ in range(20)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    rows = pa.Table.from_batches(list(pieces._pack([0])(iter([batches[0].slice(0, 0), *batches]))))
    chunk = pieces._list_segments(table)((pa.scalar(0, pa.int32()),), rows)
    size = np.array([len(s) for s in chunk.column("seg").to_pylist()])
    encoded = chunk.append_column("bounds", pa.array((1 << size + 1) - 1))
    assert len(encoded) > 10_000
    tracemalloc.start()
    try:
        out = pieces._write_out(table, ["doc_id", "n_tokens", "ids"], False)(rows, encoded)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 100_000  # no blob of texts behind the columns that pass through
    got = dict(zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True))
    by_char = {"a": [2], "b": [3], "▁": [0]}
    for k, t in enumerate(texts):
        assert got[k] == [i for c in "▁" + t.replace(" ", "▁") for i in by_char.get(c, [0])]


def test_segments_of_a_slice_of_words():
    table = pieces.PieceTable((("ab", 1, -1.0), ("語x", 2, -2.0), ("😀a", 3, -3.0)), unigram=False)
    words = ["zz", "é語xy", "😀ab", "▁", "q😀"]
    segs, ends = pieces.Cutter(table).segments(pa.array(words, pa.large_string()).slice(1, 3))
    assert segs.to_pylist() == ["é", "語x", "y", "😀ab", "▁"] and ends.tolist() == [3, 4, 5]
