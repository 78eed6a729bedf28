import os
import random

import pytest

from lumenfold.llm import tokens

from .helpers import empty_documents, odd_documents

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")


def brute(texts, rule):
    """Token by token: which section holds its first, last or most bytes."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    ids = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("\n".join(texts))
    length = {v: len(k) for k, v in ranks.items()}
    owner, section = [], 0
    for k, text in enumerate(texts):
        for i, line in enumerate(text.encode().split(b"\n")):
            last = i == text.count("\n")
            owner += [section] * (len(line) + (not last or k < len(texts) - 1))
            section += 1
    counts, crossing, at = [0] * section, 0, 0
    for t in ids:
        own = owner[at : at + length[t]]
        at += length[t]
        crossing += len(set(own)) > 1
        counts[{"first": own[0], "last": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]] += 1
    assert at == len(owner)
    return len(ids), section, crossing, counts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_equals_brute_force(spark, rule):
    random.seed(4)
    texts = ["", "\n", "\n\n\n", "a\n\n\nb", "word.\n  next\n", "é\n😀 \n日本", " "] + ["".join(random.choice("ab \n\t.é") for _ in range(random.randint(1, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.count_tokens(docs, RANKS, rule=rule).collect():
        assert (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == brute([texts[r.doc_id]], rule), texts[r.doc_id]
        assert sum(r.section_tokens) == r.n_tokens == sum(r.field_tokens)


def test_fields(spark):
    rows = [(1, "a title\n", "The text.\nMore"), (2, None, "x"), (3, "", ""), (4, None, None)]
    got = {r.doc_id: r for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, title string, body string"), RANKS, ("title", "body")).collect()}
    for i, a, b in rows:
        n, sections, crossing, counts = brute([a or "", b or ""], "first")
        r = got[i]
        assert (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == (n, sections, crossing, counts)
        assert len(r.field_tokens) == 2 and sum(r.field_tokens) == n


def test_odd_rows(spark):
    docs = odd_documents(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = tokens.count_tokens(docs, RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == brute([texts[r.doc_id]], "first")
    assert tokens.count_tokens(empty_documents(spark), RANKS).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, RANKS, rule="none")


def test_long_white_space_and_texts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for run in (" " * 60_000, "\n" * 60_000, " \n\t" * 20_000, "\u3000 " * 30_000):
        for a, b in (("", ""), ("x", "y"), ("x", ""), ("", "1"), ("x.", "!")):
            assert tokens.encode_whole(a + run + b, encoding) == encoding.encode_ordinary(a + run + b)
    rows = [(1, " " * 2_000_000), (2, "\n" * 1_500_000 + "end"), (3, "word " * 400_000)]
    got = {r.doc_id: r for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), RANKS).collect()}
    assert all(sum(got[i].section_tokens) == got[i].n_tokens > 0 for i in (1, 2, 3)) and got[2].n_sections == 1_500_001 and got[3].n_tokens == 400_001
