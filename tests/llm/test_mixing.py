from collections import Counter

from lumenfold.llm import mixing

from .helpers import empty_documents, odd_documents, words


def test_targets():
    assert mixing.targets({}) == {}
    # equal sources: 3, 1, 2 sixths of 450, and the first stops at twice its size
    got = mixing.targets({"a": 100, "b": 100, "c": 100})
    assert got["a"] == 200 and abs(sum(got.values()) - 450) < 1e-9 and abs(got["c"] - 2 * got["b"]) < 1e-9
    got = mixing.targets({None: 50, "z": 10, "a": 0, "Z": 1000})
    assert list(sorted(got, key=lambda s: (s is None, s or ""))) == ["Z", "a", "z", None]
    assert got["a"] == 0 and all(got[s] <= 2 * n for s, n in {None: 50, "z": 10, "Z": 1000}.items())
    assert abs(sum(got.values()) - 1.5 * 1060) < 1e-6


def test_each_source_takes_its_target(spark):
    rows = [(i, "w " * (i % 37), ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, ranges=16).collect()
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(7), ranges=16).collect()}
    assert all(again[r.doc_id] == r for r in got) and len(got) == 400
    taken, size = Counter(), Counter()
    for r in got:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size and r.taken == r.epochs * r.size + r.part
        taken[r.source] += r.taken
        size[r.source] += r.size
    goal = mixing.targets(dict(size))
    assert all(r.target == goal[r.source] and r.source_size == size[r.source] for r in got)
    assert all(goal[s] - 1 < taken[s] <= goal[s] for s in goal)
    other = {r.doc_id: r.taken for r in mixing.mix(docs, seed=1, ranges=16).collect()}
    assert other != {r.doc_id: r.taken for r in got}


def test_the_mix_itself(spark):
    rows = [(i, f"a{i} b\tc  d\ne{i} ", "ab"[i % 2]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = Counter()
    for r in mixing.clean(docs).collect():
        assert rows[r.doc_id][1].startswith(r.text)
        out[r.doc_id] += len(words(r.text))
    assert out == Counter({i: n for i, n in taken.items() if n})


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.size == len(words(r.text)) and r.taken <= 2 * r.size
    assert mixing.mix(empty_documents(spark)).count() == 0
    assert mixing.clean(docs).columns == docs.columns


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", " a b ", "a\x0bb\x0cc\rd\n", "a\x1cb c", "\t\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", mixing.word_count(df.t).alias("n")).collect():
        assert r.n == len(words(texts[r.i])), texts[r.i]


def test_takes_equal_a_plain_cut(spark):
    import hashlib
    from collections import defaultdict

    rows = [(i, "w " * (i % 23), ["a", "b", None][i % 3] if i % 5 else "a") for i in range(300)]
    got = {r.doc_id: (r.taken, r.target) for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ranges=8).collect()}
    by_source = defaultdict(list)
    for i, t, s in rows:
        by_source[s].append((hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], i, len(words(t))))
    goal = mixing.targets({s: sum(n for _, _, n in x) for s, x in by_source.items()})
    for s, listed in by_source.items():
        total = sum(n for _, _, n in listed)
        full, left = int(goal[s] // total), int(goal[s]) % total
        for _, i, n in sorted(listed):
            more = min(n, left)
            left -= more
            assert got[i] == (full * n + more, goal[s])
