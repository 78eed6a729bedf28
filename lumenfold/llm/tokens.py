"""Token counts by offset-mapped attribution.

A document is encoded once, whole; the tokens' byte lengths give their spans, and the sorted spans
are interval-joined to the sorted spans of the document's sections. A token that crosses a boundary
goes to one section by an explicit rule: ``first`` (the section of its first byte), ``last`` (of its
last byte) or ``most`` (the section with most of its bytes, the earlier one of equals). So the
counts of a document's sections always add up to its tokens.

Sections are the fields of a row, in the given order, and the lines of each field; a line's span
holds its line feed, and fields are encoded with one line feed between them.

Defined results: a null field counts as empty; a document of only empty fields has no tokens, and
one section for each field; an empty last line is a section without tokens; repeated rows and null
doc_ids are counted like any other row; an empty table gives an empty result; texts of any length
are encoded whole. Columns that are not named as fields are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text before byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Runs of white space of so many characters overflow the tokenizer's stack from some size on; they
#: are cut out before, where the pattern itself ends a match.
LONG_RUN = 50_000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, field_tokens array<long>, section_tokens array<long>"


def attribute(ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    ``ends`` are the tokens' end offsets and ``cuts`` the sections' end offsets, both ascending.
    """
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(cuts, starts, "right")
    last = np.searchsorted(cuts, ends - 1, "right")
    to = {"first": first, "last": last, "most": first.copy()}[rule]
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for t in crossing:
            edges = np.concatenate([[starts[t]], cuts[first[t] : last[t]], [ends[t]]])
            to[t] = first[t] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(cuts)) if len(cuts) else np.zeros(0, int), len(crossing)


def encode_whole(text: str, encoding) -> list[int]:
    """The ids of a text of any length.

    The pattern takes a run of white space up to its last character, which goes with what follows, or
    whole at the text's end: that stretch is one match, so it is merged by itself and the parts around
    it keep their ids.
    """
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def _count(vocabulary: bytes, fields: list[str], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            length[rank] = len(piece)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                texts = [(batch.column(f)[k].as_py() or "") for f in fields]
                whole = "\n".join(texts)
                sizes, lines = [], []
                for i, text in enumerate(texts):
                    own = [len(x) + 1 for x in text.encode().split(b"\n")]
                    own[-1] -= i == len(texts) - 1
                    sizes += own
                    lines.append(len(own))
                ends = np.cumsum(length[np.array(encode_whole(whole, encoding), np.int64)]) if whole else np.zeros(0, np.int64)
                counts, crossing = attribute(ends, np.cumsum(sizes), rule)
                at = np.concatenate([[0], np.cumsum(lines)])
                total = np.concatenate([[0], np.cumsum(counts)])
                rows.append((len(ends), len(sizes), crossing, np.diff(total[at]), counts))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, fields: tuple[str, ...] = ("text",), rule: str = "first") -> DataFrame:
    """Tokens of each row, by field and by section; ``vocabulary`` is the path of a rank file on the driver."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    names = [f"f{i}" for i in range(len(fields))]
    narrow = docs.select(F.col("doc_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(fields, names, strict=True)])
    return narrow.mapInArrow(_count(ranks, names, rule), SCHEMA)
