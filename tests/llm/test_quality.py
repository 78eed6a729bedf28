import random

from lumenfold.llm import quality

from .helpers import empty_documents, odd_documents, words


def brute(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    lines = [x for x in text.split("\n") if words(x)]
    spans = {}
    for i in range(len(w) - 7):
        spans.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in spans.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def figures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_base_figures_equal_brute_force(spark):
    random.seed(1)
    texts = []
    for _ in range(60):
        base = [random.choice("ab ü x* #| \n ccc dd\t".split(" ")) for _ in range(random.randint(0, 60))]
        texts.append(" ".join(base + base[: random.randint(0, 30)]) + random.choice(["", "\n", "\x0b ", "\r\nthe end"]))
    got = quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert figures(r) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert figures(r) == brute(r.text)
    assert quality.judge(empty_documents(spark)).count() == 0
    assert quality.clean(docs).columns == docs.columns


def test_line_rules_and_verdicts(spark):
    prose = "The committee met on Tuesday to talk about the new bridge, and it will meet again before the summer is over for good."
    other = "Nobody in the village had expected so many visitors, although posters were seen everywhere along that road since April."
    rows = [
        (1, prose),
        (2, f"Home | About | Contact | Login\n{prose}\nAll rights reserved.\n{other}"),
        (3, "BUY!! NOW!! THE!! BEST!! OFFER!! EVER!! SEEN!! HERE!! AND!! CHEAP!! FOR!! YOU!! ALL!! OF!! IT!! TODAY!! ONLY!! COME!! AND!! BUY!!"),
        (4, "word### " * 3 + " ".join(f"w{i}***" for i in range(30))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1].clean_text == prose
    assert got[2].clean_text.split("\n") == [prose, other] and got[2].n_failed_lines == 2
    assert {r.doc_id: r.text for r in quality.clean(docs).collect()} == {1: prose, 2: got[2].clean_text}


def test_a_filter_on_a_verdict_ends(spark):
    docs = spark.createDataFrame([(1, "some words " * 30)], "doc_id long, text string")
    assert quality.judge(docs).where("kept and n_repeat_words > 0").count() == 0


def test_plan_has_no_python(spark):
    plan = quality.judge(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_lines_of_punctuation(spark):
    prose = "The committee met on Tuesday to talk about the new bridge, and it will meet again before the summer is over for good."
    bad = ["Contents ......... 12", "so... well... then... no...", "?!?!?!", "a, b,, c;; d::"]
    good = ["Yes, no, perhaps, never, always, sometimes, often.", "Wait... what?", "Version 1.2.3 came out in May.", "He said: go, run, hide; then he left."]
    docs = spark.createDataFrame([(1, "\n".join([prose, *bad, *good]))], "doc_id long, text string")
    got = quality.judge(docs).first()
    assert got.clean_text.split("\n") == [prose, *good] and got.n_failed_lines == len(bad) and got.kept
