import re

import pytest

from lumenfold.llm import licenses
from lumenfold.llm.licenses import evaluate, licenses_of, parse_expression

from .helpers import empty_documents, lower, odd_documents


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_equal_brute_force(spark):
    texts = [
        "Under the MIT License, under the mit license under the\nMIT-license.", "licensed under CC BY-NC 4.0 and cc by ncx", "Apache License, Version 2.0", "apache license version 20",
        "xunder the mit license", "éunder the mit license", "under the mit license", "THE İ CC\x00BY\x7fNC", "cc by nc cc by nc by nc",
    ]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_tags_and_notices(spark):
    texts = ["# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */", "SPDX-License-Identifier: MIT AND\n", "GNU General Public License, version 3.", "nothing"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].labels == "apache-2.0,gpl-2.0-only,mit" and got[0].score == 1.0
    assert got[0].expressions == ["MIT Apache-2.0 OR GPL-2.0-only Classpath-exception-2.0 WITH AND"]
    assert got[1].malformed == 1 and got[1].labels == ""
    assert got[2].labels == "gpl-3.0" and got[3].score == 0.0


@pytest.mark.parametrize(
    ("text", "rpn"),
    [("MIT", ["MIT"]), ("a or b and c", ["a", "b", "c", "AND", "OR"]), ("(a OR b) AND c", ["a", "b", "OR", "c", "AND"]), ("a WITH x OR b", ["a", "x", "WITH", "b", "OR"]), ("a AND", None), ("(a", None), ("a)", None), ("", None), ("OR a", None), ("a b", ["a"])],
)
def test_expressions(text, rpn):
    assert parse_expression(text) == rpn


def test_evaluation():
    allows = lambda name, exception: name in ("MIT", "GPL") and (name != "GPL" or exception == "cp")
    for text, met in (("MIT", True), ("GPL", False), ("GPL WITH cp", True), ("GPL OR MIT", True), ("GPL AND MIT", False), ("(BSD OR GPL WITH cp) AND MIT", True)):
        assert evaluate(parse_expression(text), allows) is met
    assert licenses_of(parse_expression("(A OR b) AND C WITH e")) == {"a", "b", "c"}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
    assert licenses.scan(empty_documents(spark)).count() == 0


def test_expressions_decide_what_is_permitted(spark):
    tag = "SPDX-License-Identifier: "
    texts = [f"{tag}MIT OR GPL-3.0-only", f"{tag}MIT AND GPL-3.0-only", f"{tag}GPL-2.0-only WITH Classpath-exception-2.0", f"{tag}GPL-2.0-only", "under the mit license", f"{tag}MIT\n{tag}AGPL-3.0-only", f"{tag}(ISC OR X) AND (Y OR Zlib)"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].permitted for i in range(7)] == [True, False, True, False, None, False, True]
    assert got[0].score == got[2].score == 1.0 and got[1].score < 1.0


def test_many_places_take_time_in_proportion():
    import time

    import pyarrow as pa

    def took(n):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["x under the mit license cc by nc\n" * n]})
        began = time.perf_counter()
        row = next(licenses._scan(iter([batch]))).to_pylist()[0]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (8 * n, 2 * n, 1, 8 * n - 3)
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 30 * max(took(16_000), 0.05)
