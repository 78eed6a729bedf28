"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmltext, langid, licenses, linededup, mixing, neardup, pieces, quality, tokens
from ._common import materialize

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("text", "clean_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.NearDup(similarity_pct=85))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), langid.held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(materialize(docs, "sizes"), size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pieces.load_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), table, digest=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken").drop("field_tokens")


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_html_text": op8_html_text,
    "op9_license_scan": op9_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_duplicates": op5_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
}

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS had FROM documents),
l AS (SELECT doc_id, unnest(had) AS line, generate_subscripts(had, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, common.last IS NOT NULL AND k.doc_id < common.last AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, doc_id = min(r.b) AS kept
FROM documents JOIN r ON r.a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id, n.n
"""

# a target is its cap, twice the source's size, for a prefix of the sources in the order of cap by weight; the others share the rest by weight
_MIX_SOURCES = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * total / w, source IS NULL, source) AS k FROM s),
c AS (SELECT *, sum(total) OVER () * 150 / 100 - coalesce(sum(2 * total) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM o),
f AS (SELECT rest::DOUBLE / weights::DOUBLE AS share, k FROM c WHERE w * (rest::DOUBLE / weights::DOUBLE) <= 2 * total ORDER BY k LIMIT 1),
t AS (SELECT c.source, c.total, CASE WHEN f.k IS NULL OR c.k < f.k THEN (2 * total)::DOUBLE ELSE w * share END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT doc_id, size, total AS source_size, target, floor(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken FROM p
"""

_PHRASES = "|".join(quality.BOILERPLATE)
_QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s FROM d),
m AS (SELECT doc_id, s, len(regexp_extract_all(s, '{_WORD}')) AS words, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g')) AS seen,
  length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS symbols, length(regexp_replace(s, '\PL+', '', 'g')) AS letters,
  length(regexp_replace(s, '[^{quality.MARKS}]+', '', 'g')) AS marks, length(regexp_replace(s, '\P{{Lu}}+', '', 'g')) AS upper_, length(regexp_replace(s, '[^{quality.BARS}]+', '', 'g')) AS bars FROM l),
j AS (SELECT *, symbols * 100 > words * 50 OR letters * 100 < seen * 50 OR (words >= 5 AND upper_ * 100 > letters * 80)
  OR (marks >= 5 AND marks * 100 > words * 100) OR (bars >= 3 AND words <= bars * 4) OR (words <= 15 AND regexp_matches(s, '(?i){_PHRASES}')) AS bad FROM m WHERE words > 0),
f AS (SELECT doc_id, sum(words) AS n_words, sum(seen) AS word_chars, sum(symbols) AS n_symbols, count(*) - count(DISTINCT s) AS n_dup_lines,
  count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(seen) FILTER (WHERE bad), 0) AS lost_chars FROM j GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_symbols, 0)::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars FROM d LEFT JOIN f USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * 50 AND lost_chars < word_chars AS kept FROM b
"""

#: The others have no SQL: fitted or hashed choices, tokenizers, expressions and markup are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": _MIX_SOURCES,
    "op4_line_dedup": _LINE_DEDUP,
    "op5_near_duplicates": _NEAR_DUPLICATES,
    "op10_quality_rules": _QUALITY_RULES,
}
