from collections import Counter

import pytest

from lumenfold.llm import htmltext
from lumenfold.llm.htmltext import main_text, read_page


def text(html):
    return main_text(html, set(), set())


ARTICLE = "<article><h1>Title &amp; more</h1><p>First  one<br>line</p><p>Second <b>bo</b>ld &lt;x&gt; &#233;<p>Third</article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div><div class=ad>Buy</div>
<header><p>Site</p></header>{ARTICLE}<aside>Side</aside><section id="comments"><p>I think</p></section><form><label>Mail</label><input></form><footer>&copy; x</footer>"""


def test_the_article_alone():
    assert text(PAGE) == "Title & more\n\nFirst one line\n\nSecond bold <x> é\n\nThird"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<p>a</p", "a"),
        ("<main><p>a</p><div class='share'>x</div></main>", "a"), ("<article><p>one</p><div class=sidebar><p>no</p></div><p>two</p></article>", "one\n\ntwo"),
        ("<article><header><h1>H</h1></header><p>b</p></article>", "H\n\nb"), ("<article><ul><li>x<li>y</ul><p><a href=1>all link</a></p></article>", "x\n\ny\n\nall link"),
        ("<div class='layout with-sidebar'><article class='post hasComments'><p>own</p></article><section id=comments class=comments><article><p>theirs</p></article></section></div>", "own"),
        ("<div class='page sideBar'><div class=text><p>all of it</p></div></div>", "all of it"), ("<article><p>a</p><article class=comment><p>c</p></article></article>", "a"),
        ("<article><script>if (a < b) { '<p>' }</script><p>t</p></article>", "t"), ("<article><p hidden>h</p><p style='display: none'>n</p><p>v</p></article>", "v"),
        ("<body><div id=menu><a>m</a></div><div class=content><p>" + "long text " * 9 + "</p></div><div>tail</div>", ("long text " * 9).strip()),
    ],
)
def test_pages(html, want):
    assert text(html) == want


def page(host, i, body):
    return (i, f"https://{host}/p/{i}?x=1", f"<html><body><div class=top><p>Welcome to {host}</p><p>Our motto is simple</p></div><div class=box><p>{body}</p></div><div class=end><p>See you soon</p></div></body></html>")


def test_text_that_a_site_repeats_is_deduced(spark):
    rows = [page("a.example", i, f"Page number {i} tells of {i * 7} things") for i in range(12)]
    rows += [page("b.example", 100 + i, "The same words everywhere") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert all(got[i] == f"Page number {i} tells of {i * 7} things" for i in range(12))
    # too few pages for a template: nothing is taken for repeated
    assert "The same words everywhere" in got[100]


def test_classes_share_their_occurrence_vector(spark):
    rows = [page("a.example", i, f"x{i}") for i in range(8)]
    df = spark.createDataFrame([("a.example", i, h) for i, _, h in rows], "host string, key long, html string").repartition(4)
    one = htmltext.deduce(df).first()
    assert "/html/body/div.box" in one.slots and len(one.texts) == 3
    tokens, blocks = read_page(rows[0][2])
    assert tokens == Counter({"/html": 1, "/html/body": 1, "/html/body/div.top": 1, "/html/body/div.top/p": 2, "/html/body/div.box": 1, "/html/body/div.box/p": 1, "/html/body/div.end": 1, "/html/body/div.end/p": 1})
    assert [b.text for b in blocks] == ["Welcome to a.example", "Our motto is simple", "x0", "See you soon"]


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, text string, token string, salt int"
    rows = [(1, None, None), (2, "::odd", ""), (3, "http://h/", PAGE), (3, "http://h/", PAGE), (None, "http://h/", "<p>x"), (4, "http://h/", "<article>" + "<p>para</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], schema)
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == len(rows)
    by = {r.page_id: r.text for r in got.collect()}
    assert by[1] == by[2] == "" and by[None] == "x" and by[3].startswith("Title & more") and by[4].count("para") == 20_000
    assert htmltext.extract(df.limit(0)).count() == 0


def test_a_template_serves_inside_articles_too(spark):
    box = "<div class=box><p>Write to us at any time</p><p>We answer every letter</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<html><body><article><h1>Title {i}</h1><p>Own words {i * 3}</p>{box}</article></body></html>") for i in range(8)]
    # one article under many addresses, with an advert that differs
    rows += [(100 + i, f"http://b.example/{i}", f"<html><body><i>{i}</i><article><h1>Same</h1><p>one</p><p>two</p><p>{i} visits</p></article></body></html>") for i in range(8)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n\nOwn words {i * 3}" for i in range(8))
    assert all(got[100 + i] == f"Same\n\none\n\ntwo\n\n{i} visits" for i in range(8))


POST = "<div class=post><h1>Title {0}</h1><p>intro {0}</p><div class=entry><p>" + "long body {0} " * 30 + "</p></div><p>end {0}</p></div>"
LIST = "<p>before {0}</p><ul>" + "".join(f"<li>item {{0}} {k} of a long list" for k in range(30)) + "</ul><p>after {0}</p>"


def test_text_around_the_longest_container_stays(spark):
    def whole(i):
        return f"Title {i}\n\nintro {i}\n\n" + ("long body %d " % i * 30).strip() + f"\n\nend {i}"

    def listed(i):
        return "\n\n".join([f"before {i}", *(f"item {i} {k} of a long list" for k in range(30)), f"after {i}"])

    for around in ("{}", "<html><body>{}</body></html>", "<div class=page>{}</div>"):
        assert text(around.format(POST.format(1))) == whole(1) and text(around.format(LIST.format(1))) == listed(1)
    assert text("<div>Title</div><div><p>intro</p></div><div><p>" + "word " * 50 + "</p></div><div><p>end</p></div>") == "Title\n\nintro\n\n" + ("word " * 50).strip() + "\n\nend"
    site = "<html><body><div class=top><p>Our site</p><p>Its motto</p></div><div class=a>{}</div><div class=b>{}</div></body></html>"
    rows = [(i, f"http://a.example/{i}", site.format(POST.format(i), f"<p>also {i}</p>")) for i in range(6)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{whole(i)}\n\nalso {i}" for i in range(6))


def test_copies_are_no_evidence_of_a_template(spark):
    paragraphs = [f"Paragraph {k} of the copied text" for k in range(4)]
    copy = "<html><body><div class=post>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div></body></html>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(7)]
    rows += [(i, f"http://a.example/{i}", f"<html><body><div class=post><p>Own {i}</p><p>And more {i}</p></div></body></html>") for i in range(7, 10)]
    rows += [(20, "http://b.example/", copy)] * 5
    # the same template in even and odd numbers of copies
    rows += [r for i in range(6) for r in [page("c.example", 30 + i, f"Body {i}")] * (1 + i % 2)]
    got = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = [(r.page_id, r.text) for r in htmltext.extract(got).collect()]
    assert sorted(i for i, _ in got) == sorted(r[0] for r in rows)
    for i, found in got:
        if i >= 30:
            assert found == f"Body {i - 30}"
        else:
            assert found == ("\n\n".join(paragraphs) if i < 7 or i == 20 else f"Own {i}\n\nAnd more {i}")


@pytest.mark.parametrize("tag", ["noscript", "template", "svg", "canvas", "audio", "video", "object", "math"])
def test_an_element_without_its_end_tag_ends_no_page(tag):
    assert text(f"<article><p>a</p><{tag} src=x><p>b</p><p>c</p></article>") == "a\n\nb\n\nc"
    # the end tag of a later one is not its own
    assert text(f"<article><p>a</p><{tag}><p>b</p><{tag}></{tag}><p>c</p></article>") == "a\n\nb\n\nc"


def test_skipped_and_read_elements():
    assert text("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><object data=f><p>instead</p></object></article>") == "a x=1 b\n\ninstead"
    assert text("<article><template><p>t</p><template>u</template>v</template><p>a</p><svg><text>s</text></svg><video>no</video></article>") == "a"
    assert text("<article><p>a</p><script>var x = '<p>no'") == "a" and text("<article><p>a</p><textarea><p>no") == "a"
    assert text("<article>" + "<svg><p>x</p>" * 20_000) == "\n\n".join("x" * 20_000)


def test_vectors_equal_a_plain_deduction(spark):
    box = "<div class=box><p>Write to us</p><p>We answer</p></div>"
    rows = [(i, f"<html><body><div class=top><p>Site</p></div><article><h1>Title {i}</h1>{'<p>more</p>' * (i % 3)}<p>Own {i}</p>{box if i % 4 else ''}</article></body></html>") for i in range(9)]
    pages, seen = [read_page(h) for _, h in rows], {}
    for k, (tokens, blocks) in enumerate(pages):
        for t, n in [*tokens.items(), *Counter(f"{b.path}\x00{b.text}" for b in blocks).items()]:
            seen.setdefault(t, [0] * len(pages))[k] = n
    classes = {}
    for t, vector in seen.items():
        if sum(n > 0 for n in vector) >= 5 and sum(n > 0 for n in vector) >= 0.6 * len(pages):
            classes.setdefault(tuple(vector), []).append(t)
    texts, slots = set(), set()
    for own in classes.values():
        outer = min((t.split("\x00")[0] for t in own), key=lambda p: (len(p), p))
        if len(own) >= 3 and all(t.startswith(outer) for t in own):
            texts |= {htmltext._half(t, 0) for t in own if "\x00" in t}
            slots |= {t for t in own if "\x00" not in t}
    assert texts and slots
    once = spark.createDataFrame([("h", h) for _, h in rows], "host string, html string")
    for pages in (once, once.union(once), once.repartition(5)):
        got = htmltext.deduce(pages).first()
        assert set(got.texts) == texts and set(got.slots) == slots
    # the template decides: without it the box stays
    assert htmltext.main_text(rows[1][1], texts, slots) == "Title 1\n\nmore\n\nOwn 1" and "We answer" in text(rows[1][1])


def test_deep_nesting_and_open_quotes():
    for html in ("<div>" * 100_000 + "<p>deep</p>" + "</div>" * 100_000, "<div>" * 100_000 + "</i>" * 100_000 + "deep", "<b>" * 100_000 + "deep"):
        assert text(html) == "deep"
    assert max(len(p) for p in read_page("<div class=a>" * 50_000)[0]) < 2_000
    assert text("<p title=\"it's>one</p>") == "one" and text("<article><p title='a>one</p><p>two \"x\"</p></article>") == 'one\n\ntwo "x"'
    assert text('<p title="a>b">c</p>') == "c"
