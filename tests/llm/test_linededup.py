from collections import defaultdict

from pyspark.sql import functions as F

from lumenfold.llm import linededup

from .helpers import WS, empty_documents, lower, odd_documents

LINE = "This line is long enough to be judged by its key, surely."


def brute(rows, least=5, chars=40):
    key = lambda x: lower(x.strip(WS))
    holds = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holds[k].append(i)
    out = []
    for i, t in rows:
        had = (t or "").split("\n")
        kept = [x for x in had if len(key(x)) < chars or len(holds[key(x)]) < least or i == max(holds[key(x)])]
        out.append((i, len(had), len(had) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(df, **how):
    return sorted((r["row"].doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(df, **how).collect())


def test_equals_brute_force(spark):
    rows = [(i, f"own line of document {i}\n  {LINE.upper() if i % 2 else LINE}\t\n{LINE}\nshort\nshort") for i in range(7)]
    rows += [(20 + i, f"{'x' * 39}\n{'y' * 40}\n\n{'é' * 41}\r") for i in range(6)] + [(30 + i, f"{LINE} only four") for i in range(4)] + [(40, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for batches, fanout in ((1, 2), (4, 4), (5, 2)):
        assert run(df, batches=batches, fanout=fanout) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(9, LINE)] * 5 + [(None, LINE)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["row"].doc_id or 0, r.kept_text) for r in got) == [(0, "")] + [(9, LINE)] * 5


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert linededup.clean(docs).columns == docs.columns
    assert sorted(map(str, linededup.clean(docs).where("text is not null and text != ''").collect())) == sorted(map(str, docs.where("text is not null and text != ''").collect()))
    assert linededup.dedup_lines(empty_documents(spark)).count() == 0


def test_runs_of_a_growing_corpus(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    seen = set()
    for batch in ([1, 2], [2, 3], [3, 4, 1], [5], [5, 6]):
        texts = [(100 * k, "\n".join([f"{LINE} number {k}"])) for k in batch]
        hashes = linededup.line_hashes(spark.createDataFrame(texts, "doc_id long, text string"))
        assert {r.doc_id // 100 for r in runs.unseen(hashes).collect()} == set(batch) - seen
        runs.add(hashes)
        seen |= set(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    counts = {r.max_doc // 100: r.n_docs for r in runs.counts().collect()}
    assert counts == {1: 2, 2: 2, 3: 2, 4: 1, 5: 2, 6: 1}
    for level in runs.levels:
        for at in level:
            for part in spark.read.parquet(at).select(F.input_file_name().alias("f")).distinct().collect():
                keys = [(r.h1, r.h2) for r in spark.read.parquet(part.f).collect()]
                assert keys == sorted(keys)
    runs.drop()


def test_each_batch_of_a_table_meets_the_runs(spark, monkeypatch):
    fed, feed = [], linededup.LineRuns.feed

    def watch(self, hashes):
        feed(self, hashes)
        keys = [(r.h1, r.h2) for r in self._read(sum(self.levels, [])).collect()]
        assert len(keys) == len(set(keys))
        fed.append([[len(x) for x in levels] for levels in (self.levels, self.updates)])

    monkeypatch.setattr(linededup.LineRuns, "feed", watch)
    rows = [(i, f"{LINE}\n{LINE} number {i % 9}\n{LINE} of its own {i}") for i in range(60)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), batches=5, fanout=2) == brute(rows)
    # all batches pass by the runs, whose levels reach the third
    assert [x[0] for x in fed] == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]] and fed[-1][1] == [0, 0, 1]
