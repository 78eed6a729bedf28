import hashlib
import os
import random

import pytest

import corpus_pipeline
from lumenfold.llm import mixing
from lumenfold.llm.queries import ORACLE_SQL, QUERIES, TOKENIZERS

from .helpers import words
from .test_neardup import brute as groups

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files")


def corpus():
    random.seed(9)
    prose = [[f"{random.choice('abcdefgh')}{random.choice('aeiou')}{random.randint(1, 99)}x" for _ in range(60)] for _ in range(30)]
    shared = "This passage stands in many of the documents and is long enough to be a repeated line."
    rows = []
    for i in range(60):
        w = list(prose[i % 30])
        if i >= 30:
            w[random.randrange(60)] = "changed"
        rows.append((i, " ".join(w[:40]) + "\n" + (shared + "\n" if i % 3 == 0 else "") + " ".join(w[40:]), "en", f"s{i % 4}"))
    rows += [(100, "too short", "en", "s1"), (101, None, None, None), (102, "again and again it goes " * 20, "en", "s2")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_each_stage_works_on_what_the_one_before_kept(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, tables).cache()
        assert docs.columns == columns, name
        after = docs.collect()
        kept[name] = after
        assert {r.doc_id for r in after} <= set(before)
        assert all(r.n_chars == len(r.text) for r in after), name
    quality_ids = {r.doc_id for r in kept["quality rules"]}
    assert quality_ids == set(range(60))
    shared = [r.doc_id for r in kept["line dedup"] if "This passage" in r.text]
    assert shared == [57]
    want = groups([(r.doc_id, r.text) for r in kept["line dedup"]], 80)
    assert {r.doc_id for r in kept["near dedup"]} == {i for i, (_, c) in want.items() if c == i}
    sizes = {}
    for r in kept["near dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    taken = dict.fromkeys(sizes, 0)
    for r in kept["mixing"]:
        taken[r.source] += len(words(r.text))
    goal = mixing.targets(sizes)
    assert all(goal[s] - 1 < taken[s] <= goal[s] for s in goal)


def test_the_whole_pipeline(spark, tables):
    import sentencepiece

    got = corpus_pipeline.run(spark, tables).collect()
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    mixed = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        mixed = stage(spark, mixed, tables)
    reference = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((r.doc_id, reference.encode(r.text)) for r in mixed.collect())


def test_ids_of_the_last_stage_decode_to_the_mixed_text(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("text is not null")
    got = corpus_pipeline.encode_pieces(spark, docs, tables).select("doc_id", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"]
