"""Line-first quality rules in DataFrame functions only.

Every line is judged on its own (symbols, punctuation, letters, shouting, navigation, boilerplate); failing
lines leave the text, and a document goes if it loses too much of its text or fails the
document-wide base rules (too few words, too much repetition).

Defined results: a null or empty text has no words and fails the base rules; lines without a word
leave the text but count neither as failed nor as lost text; equal lines are judged alike; a text
of any length is handled within its row; repeated rows and rows with a null doc_id are judged like
any other; an empty table gives an empty result. Working columns carry the prefix ``__q_``, so
other columns of the input may have any names; a column of the input that bears an output name is
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS

#: Phrases of web boilerplate, matched without regard to case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "uses cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "subscribe to our",
    "sign up for our",
    "skip to content",
    "back to top",
    "lorem ipsum",
)

#: Punctuation marks that are counted against a line's words.
MARKS = ".,;:!?…"

#: Separators of navigation lines.
BARS = "|»›•·"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; percentages are whole numbers so that comparisons are exact."""

    min_words: int = 20
    window: int = 8
    max_repeat_pct: int = 30
    #: a line fails with more symbols than this share of its words
    max_line_symbol_pct: int = 50
    #: a line fails with fewer letters than this share of its visible characters
    min_line_letter_pct: int = 50
    #: a line of at least ``marks`` punctuation marks fails with more of them than this share of its words
    marks: int = 5
    max_line_mark_pct: int = 100
    #: a line of at least ``shout_words`` words fails with capitals above this share of its letters
    max_line_upper_pct: int = 80
    shout_words: int = 5
    #: navigation: so many separators, and at most so many words for each
    nav_separators: int = 3
    nav_words_each: int = 4
    #: a boilerplate phrase fails a line of at most so many words
    phrase_words: int = 15
    #: a document goes if its failed lines hold more than this share of its visible characters
    max_lost_pct: int = 50


def _count(text: Column, not_wanted: str) -> Column:
    """Code points left when all of ``not_wanted`` (a pattern) is taken out."""
    return F.length(F.regexp_replace(text, not_wanted, ""))


def _repeat_words(words: Column, n: Column, flagged: Column, window: int) -> Column:
    """Words inside windows that occur twice or more; worked out only where ``flagged``.

    Windows are compared as whole strings: sorted with their places, a window repeats if a
    neighbour is equal; the places then count the union of their windows.
    """
    spans = F.array_sort(
        F.transform(
            F.sequence(F.lit(1), n - window + 1),
            lambda i: F.struct(F.array_join(F.slice(words, i, window), " ").alias("w"), i.alias("i")),
        )
    )
    def places(s):
        return F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda x, k: F.struct(
                            x["i"].alias("i"),
                            (
                                (F.get(s, k - 1)["w"].eqNullSafe(x["w"]))
                                | (F.get(s, k + 1)["w"].eqNullSafe(x["w"]))
                            ).alias("again"),
                        ),
                    ),
                    lambda x: x["again"],
                ),
                lambda x: x["i"],
            )
        )
    def covered(p):
        return F.aggregate(
            F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))),
            F.lit(0),
            lambda a, x: a + x,
        )
    # a one-element array binds an intermediate value, so that it is worked out once
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(flagged, bind(spans, lambda s: bind(places(s), covered))).otherwise(F.lit(0))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """Add the rules' figures and verdicts to every row of ``docs``.

    New columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_failed_lines, lost_chars, clean_text, base_failed, kept.
    """
    w = rules.window
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "clean_text", "base_failed", "kept"]
    base = docs.withColumn("__q_t", F.coalesce(F.col(text), F.lit("")))
    base = base.drop(*[c for c in new if c != text])
    words, n, lines = F.col("__q_words"), F.size("__q_words"), F.col("__q_lines")
    split = lambda s: F.array_remove(F.split(s, f"[{WS}]+"), "")
    first = base.withColumn(
        "__q_lines",
        F.transform(
            F.transform(F.split("__q_t", "\n"), lambda s: F.struct(s.alias("s"), split(s).alias("w"))),
            lambda x: F.struct(
                x["s"].alias("s"),
                x["w"].alias("w"),
                F.length(F.array_join(x["w"], "")).alias("seen"),
                _count(x["s"], r"[^#*$%&|<>]+").alias("symbols"),
                _count(x["s"], r"[^a-z]+").alias("lower"),
                _count(x["s"], f"[^{MARKS}]+").alias("marks"),
                F.when(reduce(lambda a, b: a | b, [F.contains(x["s"], F.lit(c)) for c in BARS]), _count(x["s"], f"[^{BARS}]+")).otherwise(0).alias("bars"),
            ),
        ),
    )
    def bad(x):
        size = F.size(x["w"])
        # where half of the visible characters are a to z, neither share can fail
        plain = x["lower"] * 200 >= x["seen"] * max(100, 2 * rules.min_line_letter_pct, 2 * (100 - rules.max_line_upper_pct))
        letters, upper = _count(x["s"], r"\P{L}+"), _count(x["s"], r"\P{Lu}+")
        odd = (letters * 100 < x["seen"] * rules.min_line_letter_pct) | ((size >= rules.shout_words) & (upper * 100 > letters * rules.max_line_upper_pct))
        return (
            (x["symbols"] * 100 > size * rules.max_line_symbol_pct)
            | ((x["marks"] >= rules.marks) & (x["marks"] * 100 > size * rules.max_line_mark_pct))
            | ((x["bars"] >= rules.nav_separators) & (size <= x["bars"] * rules.nav_words_each))
            | (~plain & odd)
            | ((size <= rules.phrase_words) & x["s"].rlike("(?i)" + "|".join(BOILERPLATE)))
        )
    judged = first.withColumns(
        {
            "__q_lines": F.transform(
                F.filter(lines, lambda x: F.size(x["w"]) > 0),
                lambda x: F.struct(x["s"].alias("s"), x["seen"].alias("seen"), x["symbols"].alias("symbols"), bad(x).alias("bad")),
            ),
            "__q_words": F.flatten(F.transform(lines, lambda x: x["w"])),
        }
    ).withColumn("__q_hash", F.when(n >= w, F.transform(F.sequence(F.lit(0), n - w), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(w)]))))
    total = lambda what, keep=None: F.aggregate(lines if keep is None else F.filter(lines, keep), F.lit(0).cast("long"), lambda a, x: a + x[what])
    # not deterministic in name: else a filter on a verdict is pushed through and repeats all this work
    pinned = lambda value: F.when(F.spark_partition_id() >= 0, value)
    flagged = F.coalesce(F.size(F.array_distinct("__q_hash")) < F.size("__q_hash"), F.lit(False))
    figures = judged.withColumns(
        {name: pinned(value) for name, value in {
            "n_words": n.cast("long"),
            "word_chars": total("seen"),
            "n_symbols": total("symbols"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["s"])))).cast("long"),
            "n_repeat_words": _repeat_words(words, n, flagged, w).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_failed_lines": F.size(F.filter(lines, lambda x: x["bad"])).cast("long"),
            "lost_chars": total("seen", lambda x: x["bad"]),
            "clean_text": F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["s"]), "\n"),
        }.items()}
    ).drop("__q_t", "__q_words", "__q_lines", "__q_hash")
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    return figures.withColumn("base_failed", failed).withColumn(
        "kept",
        ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_pct) & (F.col("lost_chars") < F.col("word_chars")),
    )


def clean(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their failing lines removed; the columns of ``docs``."""
    kept = judge(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__q_row"), F.col("text").alias("text")), rules).where("kept")
    change = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[change.get(c, F.col("__q_row")[c]).alias(c) for c in docs.columns])
