import random
import zlib

from pyspark.sql import functions as F

from lumenfold.llm import langid

from .helpers import empty_documents, odd_documents

SYLLABLES = {"xa": "ka lo mi tu ra", "xb": "schu ber ung kei zü", "xc": "çion eau ré oi ment"}


def corpus(n=240):
    random.seed(2)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        text = " ".join("".join(random.choices(SYLLABLES[lang].split(), k=3)) for _ in range(random.randint(3, 40)))
        rows.append((i, text.upper() if i % 7 == 0 else text, lang))
    return rows


def test_held_out_languages_are_found(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs, model).collect()
    truth = {i: lang for i, _, lang in corpus()}
    assert all(r.lang_pred == truth[r["row"].doc_id] for r in got) and len(got) == len(truth)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 5
    odd = langid.predict(spark.createDataFrame([(1, "мы говорим по русски")], "doc_id long, text string"), model).first()
    assert odd.rejected


def test_held_out_is_crc32_of_the_id(spark):
    got = spark.range(500).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)


def test_odd_rows(spark):
    docs = odd_documents(spark, [(7, "123 ... !!", "en", "a")])
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["row"].doc_id in (1, 2, 3, 7):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    nothing = langid.fit(empty_documents(spark))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {langid.UNKNOWN}
    assert langid.predict(empty_documents(spark), model).count() == 0
