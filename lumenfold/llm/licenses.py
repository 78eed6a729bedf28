"""License scans: an Aho-Corasick automaton over whole words, and license expressions.

A text is cut into words of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. One automaton finds all notice phrases and the identifier tag in one pass over the
words joined by single spaces; expressions behind a tag are read by a shunting-yard parser with
``with`` over ``and`` over ``or``, and evaluated: ``permitted`` tells whether all expressions of a text
can be met by allowed licenses alone (null without an expression), and the score is lower where not.

Defined results: a null or empty text has no words, no places, empty labels and score 0; places of
a phrase that overlap all count; a malformed expression gives no labels and is listed as
malformed; repeated rows and null doc_ids are scanned like any other row; an empty table gives an
empty result; texts of any length are scanned whole. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "the unlicense": "unlicense",
}
#: Licenses that allow use without passing terms on, and licenses that do so with an exception.
ALLOWED = frozenset("0bsd apache-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc0-1.0 isc mit mit-0 unlicense zlib".split())
ALLOWED_WITH = frozenset({
    ("gpl-2.0-only", "classpath-exception-2.0"), ("gpl-2.0-or-later", "classpath-exception-2.0"), ("apache-2.0", "llvm-exception"),
})
TAG_WORDS = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier\s*:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"OR": 1, "AND": 2, "WITH": 3}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Expression = list[str]


def parse_expression(text: str) -> Expression | None:
    """The expression at the start of ``text`` in reverse Polish order; None if malformed.

    Reading ends at the first character that cannot belong to an expression (a comment's end).
    """
    out: Expression = []
    stack: list[str] = []
    operand, at = True, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        word = token.upper()
        if word in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif not operand:
            break  # a word after a whole expression: prose
        else:
            out.append(token)
            operand = False
        at = m.end()
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: Expression, allows: Callable[[str, str | None], bool]) -> bool:
    """Whether the expression can be met where ``allows(license, exception)`` holds."""
    values: list = []
    for token in expression:
        if token not in _BINDS:
            values.append(token)
            continue
        b, a = values.pop(), values.pop()
        if token == "WITH":
            values.append(allows(a, b) if isinstance(a, str) and isinstance(b, str) else False)
            continue
        a, b = (allows(x, None) if isinstance(x, str) else x for x in (a, b))
        values.append(a and b if token == "AND" else a or b)
    return allows(values[0], None) if isinstance(values[0], str) else values[0]


def allows(license: str, exception: str | None) -> bool:
    """Whether a license, with an exception or without, is among those allowed."""
    license, exception = license.lower(), exception and exception.lower()
    return license in ALLOWED or exception is not None and (license, exception) in ALLOWED_WITH


def licenses_of(expression: Expression) -> set[str]:
    """The license identifiers of an expression, exceptions left out, in lower case."""
    found: list = []
    for token in expression:
        if token not in _BINDS:
            found.append({token.lower()})
        else:
            b, a = found.pop(), found.pop()
            found.append(a if token == "WITH" else a | b)
    return found[0]


def _automaton(phrases):
    import ahocorasick

    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(f" {phrase} ", phrase)
    made.make_automaton()
    return made


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, malformed long, permitted boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = _automaton([*BASE, *NOTICES, TAG_WORDS])
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            words = text.encode().translate(_LOWER).split()
            joined = f" {b' '.join(words).decode('latin-1')} " if words else ""
            base: list[int] = []
            base_labels, labels, tagged = set(), set(), False
            # each hit ends at a space; the spaces before it are counted on from the hit before
            passed = spaces = 0
            for end, phrase in find.iter(joined):
                if phrase in BASE:
                    spaces += joined.count(" ", passed, end)
                    passed = end
                    base.append(spaces - phrase.count(" ") - 1)
                    base_labels.add(BASE[phrase])
                elif phrase in NOTICES:
                    labels.add(NOTICES[phrase])
                else:
                    tagged = True
            valid, wrong, met = [], 0, True
            for m in _TAG.finditer(text) if tagged else ():
                parsed = parse_expression(m[1])
                if parsed is None:
                    wrong += 1
                else:
                    valid.append(" ".join(parsed))
                    met &= evaluate(parsed, allows)
                    labels |= licenses_of(parsed)
            labels |= base_labels
            score = (1.0 if met else 0.95) if valid else min(0.9, 0.5 + 0.1 * len(base) + 0.1 * len(labels)) if labels else 0.0
            rows.append((len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, valid, wrong, met if valid else None))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.int64(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: words, base places, labels, expressions in reverse Polish order."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
