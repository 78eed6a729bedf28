"""Mixing sources to target weights.

Sources, in code point order with null last, take the given weights in turn and share a budget of
``budget_pct`` of all sizes; a target stops at ``max_epochs`` times its source's size and the excess
is shared again by weight until none is above. Every row gets a hash-random key; rows are dealt into
ranges of that key within their source, range totals give each range its place in the source's
prefix sums, and a row's own prefix is summed inside its range alone. A target of e full epochs and
a rest takes every row e times and once more the rows up to the cut; the row on the cut gives just
the words that the budget still has, so a source's taken size is its target without the fraction.

Defined results: rows of equal key are ordered by doc_id and then size, so reruns agree; rows of a
null doc_id all share one key and are ordered by size; a source of size 0 has target 0 and takes
nothing; a null source is a source of its own; an empty table gives an empty result; sizes of texts
of any length are counted whole. Columns of the input keep their values; one named like an output
column is replaced. Only the totals of the sources are gathered on the driver, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WS

OUTPUT = ("size", "source_size", "target", "epochs", "part", "taken")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    # a cut at white space gives an empty first or last piece where the text begins or ends with it
    pieces = F.size(F.split(t, f"[{WS}]+"))
    edges = t.rlike(f"^[{WS}]").cast("int") + F.substring(t, -1, 1).rlike(f"[{WS}]").cast("int")
    return F.when(t == "", F.lit(0)).otherwise(pieces - edges).cast("long")


def targets(totals: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), budget_pct: int = 150, max_epochs: int = 2) -> dict[str | None, float]:
    """Each source's target size."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, found, rest = sum(totals.values()) * budget_pct / 100, {}, list(order)
    while rest:
        share = left / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * share > max_epochs * totals[s]]
        if not over:
            return found | {s: weight[s] * share for s in rest}
        for s in over:
            found[s] = float(max_epochs * totals[s])
            left -= found[s]
        rest = [s for s in rest if s not in found]
    return found


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", seed: int = 0, ranges: int | None = None, **how) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, epochs (times taken whole), part (words of one more
    time, up to the cut) and taken (all words taken)."""
    spark = docs.sparkSession
    if ranges is None:  # so many that one holds about 50,000 rows at most
        ranges = max(4096, docs.count() // 50_000)
    bits = max(1, (ranges - 1).bit_length())
    kept = [c for c in docs.columns if c not in OUTPUT]
    # the first 60 bits of a digest that SQL engines have as well
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sized = docs.select(*kept, (word_count(F.col("text")) if size is None else size).alias("size"), F.col(source).alias("__m_source"), key.alias("__m_key"))
    sized = sized.withColumn("__m_range", F.shiftright("__m_key", 60 - bits))
    by_range = sized.groupBy("__m_source", "__m_range").agg(F.sum("size").alias("__m_sum"))
    totals = {r[0]: r[1] for r in by_range.groupBy("__m_source").agg(F.sum("__m_sum")).collect()}
    goal = spark.createDataFrame(
        [(s, totals[s], t, int(t // totals[s]) if totals[s] else 0) for s, t in targets(totals, **how).items()],
        "__m_s string, source_size long, target double, __m_full long",
    )
    before = Window.partitionBy("__m_source").orderBy("__m_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("__m_start", F.coalesce(F.sum("__m_sum").over(before), F.lit(0))).drop("__m_sum")
    starts = starts.join(goal, F.col("__m_source").eqNullSafe(F.col("__m_s"))).select(F.col("__m_source").alias("__m_s"), F.col("__m_range").alias("__m_r"), "__m_start", "source_size", "target", "__m_full")
    inside = Window.partitionBy("__m_source", "__m_range").orderBy("__m_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("__m_end", F.sum("size").over(inside))
    placed = placed.join(starts, F.col("__m_source").eqNullSafe(F.col("__m_s")) & (F.col("__m_range") == F.col("__m_r")))
    budget = F.floor("target") - F.col("__m_full") * F.col("source_size")
    before_row = F.col("__m_start") + F.col("__m_end") - F.col("size")
    more = F.least(F.greatest(budget - before_row, F.lit(0)), F.col("size"))
    whole = more == F.col("size")
    placed = placed.withColumn("epochs", F.when(F.col("size") > 0, F.col("__m_full") + whole.cast("long")).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("part", F.when(whole, F.lit(0)).otherwise(more).cast("long"))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part")).select(*kept, *OUTPUT)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{WS}]*[^{WS}]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def clean(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as the mix takes it; the columns of ``docs``."""
    row = docs.select(F.struct(*docs.columns).alias("__m_row"), "doc_id", "source")
    mixed = mix(row, size=word_count(F.col("__m_row.text")), **how)
    # a copy for each whole time (0), and one more with the words up to the cut
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    taken = mixed.select("__m_row", F.explode(copies).alias("__m_words"))
    cut = F.when(F.col("__m_words") > 0, first_words(F.col("__m_row.text"), F.col("__m_words"))).otherwise(F.col("__m_row.text"))
    change = {"text": cut}
    if "n_chars" in docs.columns:
        change["n_chars"] = F.when(F.col("__m_words") > 0, F.length(cut).cast("long")).otherwise(F.col("__m_row")["n_chars"])
    return taken.select(*[change.get(c, F.col("__m_row")[c]).alias(c) for c in docs.columns])
