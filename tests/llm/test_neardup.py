import random

import numpy as np
import pytest

from lumenfold.llm import neardup

from .helpers import empty_documents, odd_documents, words


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows, pct):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n_bases=4, copies=40):
    random.seed(5)
    rows = []
    for b in range(n_bases):
        base = [f"t{random.randint(0, 400)}" for _ in range(120)]
        for c in range(copies):
            text = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                text[random.randrange(len(text))] = f"n{random.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009, (" " if c % 2 else "\n").join(text).upper() if c % 5 == 0 else " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, "only three words"), (2003, "only THREE words"), (2004, "words three only"), (2005, " \t\n")]
    return rows


@pytest.mark.parametrize("pct", [85, 80])
def test_groups_equal_brute_force(spark, pct):
    rows = corpus()
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), neardup.NearDup(similarity_pct=pct)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, pct)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_are_found_through_contested_bands(spark):
    """Near copies that differ from the pivot by more than the limit, but little from each other."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        text = list(base)
        for e in range(k):
            text[8 * e + 3] = f"edit{e}"
        rows.append((k, " ".join(text)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDup(similarity_pct=85))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: c for i, (_, c) in brute(rows, 85).items()}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == 1 and by[1].n_shingles == 0 and by[3].kept and by[None].kept and by[None].component_id is None
    assert [r.component_id for r in got if r.doc_id == 4] == [4, 4]
    assert neardup.near_duplicates(empty_documents(spark)).count() == 0
    assert neardup.clean(docs).columns == docs.columns


def test_signatures(spark):
    """Equal positions estimate the similarity, with less spread than independent hashes; small sets fill all positions."""
    rng = np.random.default_rng(0)
    m, share, errors = 128, 0.6, []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        x, y = neardup.super_minhash([np.concatenate([common, a]), np.concatenate([common, b])], m)
        errors.append((x == y).mean() - share)
        alone = neardup.super_minhash([np.concatenate([common, a])], m)
        assert (alone[0] == x).all()
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < np.sqrt(share * (1 - share) / m)
    one = neardup.super_minhash([np.array([7], np.uint64)], m)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(m))


def test_components(spark):
    edges = [(i + 1, i) for i in range(50)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
