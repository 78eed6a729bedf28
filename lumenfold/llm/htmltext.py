"""Main text of web pages by equivalence-class template deduction.

A page is cut into structural tokens (an element with its path and name) and text tokens (a block's
text with its path). Over the pages of a host, tokens with the same occurrence vector, the count on
every page, form an equivalence class. A class is valid if it is large enough, is found on enough of
the host's pages, and its structural tokens nest: their paths hang below the path of its outermost
token. The valid classes, nested by path, are the host's template: its structural tokens delimit
slots, and its text tokens are text that the site repeats. What a page has in the slots is data.

Occurrence vectors are compared by a 128-bit exclusive-or of hashes of (page, count), so that they
add up per task before any shuffle, and a host of any size is never gathered in one place.

The main text of a page is the data of its article, of the outermost ``article`` or ``main``
elements, else all its data; without the regions that bear a role of their own (menus, headers,
footers, sidebars, notices, adverts, forms, comments), by element, role or name, without text of the
template, and outside articles without blocks that are mostly links. Of a page without article and
template also text that stands loose in an outermost ``div`` or ``section`` goes, where it follows
the outermost element that holds at least 80 % of the text.
An article whose h1 headings, or all of whose text,
would go as text of the template is a copied article and stays whole.

Defined results: a null or empty html, or one without text, gives an empty text; a null or odd url
has the empty host; unclosed and misplaced tags end where an enclosing or block element does;
a tag with an unclosed quote ends at the next ">"; elements nested deeper than ``MAX_DEPTH`` are read like
any other and share their paths; equal pages of a host count as one for its template, and each has its row; an empty table gives an empty result; pages of
any length are read whole. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: pages of a host that a class must be found on, and the share of them
    min_pages: int = 5
    min_share: float = 0.6
    #: tokens of a class
    min_tokens: int = 3
    #: a block with more than this share of its characters in links is navigation
    max_link_share: float = 0.5
    #: parts that a host's pages are dealt into where they meet its template
    salts: int = 16


#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content HTML reads as raw text, to the page's end if need be; it is no text of the page.
RAW = frozenset("script style iframe textarea".split())
#: Elements whose content is drawn, played or inert, and skipped up to their own end tag if there is one.
SKIPPED = frozenset("noscript template svg canvas audio video".split())
#: Elements with a role of their own.
ROLE_TAGS = frozenset("head title nav header footer aside form menu button select option label input dialog".split())
#: Values of the role attribute with a role of their own.
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that tell such regions.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar colophon sidebar side aside widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe subscription signup login search form pagination pager toolbar "
    "copyright disclaimer skip hidden".split()
)
#: Those that tell an ``article`` element that is not the page's own.
NOT_OWN = frozenset("comment comments commentlist reply replies respond related recommended recommendations teaser ad advert sponsored promo".split())
#: Elements that a start tag of the same kind closes.
CLOSES = {
    "li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
}

#: Elements nested deeper share the path down to this depth, and add their own name to it.
MAX_DEPTH = 128

#: A tag's quotes may hold ">"; where a quote is never closed, the tag ends at the first ">".
_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)|(?P<loose>[^>]*)(?:>|$))",
    re.S,
)


def _attrs(m: re.Match) -> str:
    return m["loose"] if m["attrs"] is None else m["attrs"]


_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _names(attrs: str) -> tuple[str, bool, set[str]]:
    """The element's name for its path, whether its role or state sets it apart, and the parts of its names."""
    label, odd, names = "", False, set()
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            names.update(_PARTS.findall(_HUMP.sub("-", value).lower()))
            value = value.lower()
            if key == "class":
                label += "." + ".".join(sorted(set(value.split())))
        elif key == "role":
            odd |= value.lower() in ROLES
        elif key == "hidden":
            odd = True
        elif key == "aria-hidden":
            odd |= value.lower() == "true"
        else:
            odd |= "display:none" in value.lower().replace(" ", "")
    return label, odd, names


def _is_not_own(path: str) -> bool:
    """Whether a class of a path's last element begins with a word that tells what is not the page's article."""
    heads = [_PARTS.match(c) for c in path.rpartition("/")[2].split(".")[1:]]
    return any(h and h[0] in NOT_OWN for h in heads)


def _ends(html: str, at: int, tag: str) -> dict[int, int]:
    """From ``at``, behind a start tag: where each element ``tag`` begins its content to where its own end tag ends."""
    found, open_ = {}, [at]
    for m in _MARKUP.finditer(html, at):
        if (m["tag"] or "").lower() != tag:
            continue
        if not m["end"]:
            if not _attrs(m).rstrip().endswith("/"):
                open_.append(m.end())
        elif open_:
            found[open_.pop()] = m.end()
    return found


@dataclass
class Block:
    path: str
    text: str
    links: int
    #: inside a region set apart by its element, role or state; by its name; inside an article or main element
    odd: bool
    named: bool
    article: bool


def read_page(html: str | None) -> tuple[Counter, list[Block]]:
    """Counts of the page's structural tokens, and its blocks of text in page order."""
    tokens: Counter = Counter()
    blocks: list[Block] = []
    # tag, path, odd, named, article, link, whether a path so far tells what is not the page's own
    stack: list[tuple[str, str, bool, bool, bool, bool, bool]] = []
    open_: Counter = Counter()
    # path down to MAX_DEPTH and depth of the block elements that are open; equal paths are one string
    deep: list[tuple[str, int]] = []
    paths: dict[str, str] = {}

    def close() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        if tag in BLOCK:
            deep.pop()
        return tag

    parts: list[str] = []
    links = 0
    # text collected so far belongs to the block element that was open when it began
    def flush() -> None:
        nonlocal links
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, path, odd, named, article, _, _ = next((e for e in reversed(stack) if e[0] in BLOCK), ("", "", False, False, False, False, False))
            blocks.append(Block(path, text, links, odd, named, article))
        links = 0

    def add(text: str) -> None:
        nonlocal links
        parts.append(text)
        if stack and stack[-1][5]:
            links += len(text.strip())

    html = html or ""
    at = 0
    ends: dict[str, dict[int, int]] = {}
    for m in _MARKUP.finditer(html):
        if m.start() < at:
            continue  # inside an element whose content is no markup
        add(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            add(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in BLOCK:
                flush()
            if open_[tag]:
                while close() != tag:
                    pass
            continue
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if not _attrs(m).rstrip().endswith("/"):
                at = ended.end() if ended else len(html)
            continue
        if tag in SKIPPED:
            if not _attrs(m).rstrip().endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(html, at, tag)
                at = ends[tag].get(at, at)
            continue
        if tag in ("br", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
            for closed in (c for c in CLOSES.get(tag, ("p",)) if open_[c]):
                # an open element of the kind, unless a container stands between
                for e in reversed(stack):
                    if e[0] == closed:
                        while close() != closed:
                            pass
                        break
                    if e[0] in BLOCK and e[0] not in CLOSES and e[0] not in ("tbody", "thead", "tfoot"):
                        break
        label, odd, names = _names(_attrs(m)) if _attrs(m) else ("", False, set())
        _, path, was_odd, was_named, was_article, was_link, not_own = stack[-1] if stack else ("", "", False, False, False, False, False)
        if tag in BLOCK:
            stem, depth = deep[-1] if deep else ("", 0)
            path = f"{stem}/{tag}{label}"
            path = paths.setdefault(path, path)
            tokens[path] += 1
            not_own = not_own or _is_not_own(path)
        # a page's own article or main element is not set apart by names, its own or those around it
        named = was_named or not names.isdisjoint(NAMES)
        own = tag == "main" or tag == "article" and not was_article and not not_own
        if own or tag in ("html", "body"):
            named = False
        is_article = was_article or own
        # a header element inside an article holds its title
        own_role = tag in ROLE_TAGS and not (tag == "header" and was_article)
        entry = (tag, path, was_odd or odd or own_role, named, is_article, was_link or tag == "a", not_own)
        if tag not in EMPTY and not _attrs(m).rstrip().endswith("/"):
            stack.append(entry)
            open_[tag] += 1
            if tag in BLOCK:
                deep.append((path if depth < MAX_DEPTH else stem, depth + 1))
    add(html[at:])
    flush()
    return tokens, blocks


def _half(text: str, salt: int) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass"), salt), "big", signed=True)


def _text_token(block: Block) -> str:
    return f"{block.path}\x00{block.text}"


TOKENS = "host string, token long, path string, text boolean, v1 long, v2 long, pages long"


def _list_tokens(most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        held: dict[tuple, list] = {}
        seen: set[tuple] = set()

        def out() -> pa.RecordBatch:
            rows = [(h, t, p, x, *v) for (h, t), (p, x, *v) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

        for batch in batches:
            for host, key, page in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html"), strict=True):
                if (host, key) in seen:
                    continue
                seen.add((host, key))
                tokens, blocks = read_page(page.as_py())
                found = [(path, path, False, n) for path, n in tokens.items()]
                found += [(t, t.split("\x00", 1)[0], True, n) for t, n in Counter(_text_token(b) for b in blocks).items()]
                for token, path, text, n in found:
                    e = held.setdefault((host, _half(token, 0)), [path, text, 0, 0, 0])
                    e[2] ^= _half(f"{key}:{n}", 1)
                    e[3] ^= _half(f"{key}:{n}", 2)
                    e[4] += 1
            if len(held) > most:
                yield out()
        if held:
            yield out()

    return run


def _deal(rows: DataFrame, cfg: Template) -> DataFrame:
    """``rows`` with key, the same for equal html, and salt; a host's equal pages in one partition."""
    dealt = rows.withColumn("key", F.xxhash64("html"))
    return dealt.withColumn("salt", F.pmod("key", F.lit(cfg.salts)).cast("int")).repartition("host", "salt")


def deduce(pages: DataFrame, cfg: Template = Template()) -> DataFrame:
    """(host, texts, slots): the template of each host of ``pages`` (host, html).

    ``texts`` are the tokens of repeated text, ``slots`` the paths of the structural tokens.
    """
    return _deduce(_deal(pages, cfg), cfg)


def _deduce(dealt: DataFrame, cfg: Template) -> DataFrame:
    # equal pages are in one partition and count once
    listed = dealt.mapInArrow(_list_tokens(), TOKENS).groupBy("host", "token").agg(F.first("path").alias("path"), F.first("text").alias("text"), F.bit_xor("v1").alias("v1"), F.bit_xor("v2").alias("v2"), F.sum("pages").alias("pages"))
    sizes = dealt.groupBy("host").agg(F.count_distinct("key").alias("n"))
    often = listed.join(sizes, "host").where((F.col("pages") >= cfg.min_pages) & (F.col("pages") >= cfg.min_share * F.col("n")))
    # a class nests if the shortest path of its structural tokens leads to all their paths
    outer = F.min_by("path", F.struct(F.length("path"), F.col("path")))
    classes = often.groupBy("host", "v1", "v2").agg(F.count("*").alias("size"), outer.alias("outer"), F.collect_list(F.struct("token", "path", "text")).alias("own"))
    valid = classes.where((F.col("size") >= cfg.min_tokens) & F.forall("own", lambda t: t["path"].startswith(F.col("outer"))))
    own = valid.select("host", F.explode("own").alias("t")).select("host", "t.*")
    return own.groupBy("host").agg(F.collect_set(F.when(F.col("text"), F.col("token"))).alias("texts"), F.collect_set(F.when(~F.col("text"), F.col("path"))).alias("slots"))


def main_text(html: str | None, texts: set[int], slots: set[str], cfg: Template = Template()) -> str:
    """The data of the page's article, blocks joined by two line feeds."""
    _, blocks = read_page(html)
    own = [b for b in blocks if b.article and not b.odd and not b.named]
    if own:
        data = [b for b in own if not texts or _half(_text_token(b), 0) not in texts]
        # an article that is repeated with its headings, or without a rest, is a copy and no template
        heads = [b for b in own if b.path.rpartition("/")[2].split(".")[0] == "h1"]
        copied = not data or heads and not any(b in data for b in heads)
        return "\n\n".join(b.text for b in (own if copied else data))
    plain = [b for b in blocks if not b.odd and b.links <= cfg.max_link_share * len(b.text) and _half(_text_token(b), 0) not in texts]
    # where names set everything apart, they are those of the page's layout
    data = [b for b in plain if not b.named] or plain
    return "\n\n".join(b.text for b in (data if slots else _without_tail(data)))


def _region(path: str) -> str:
    """The outermost element of a path below html and body."""
    return next((p for p in path.split("/")[1:] if p.split(".")[0] not in ("html", "body")), "")


def _without_tail(data: list[Block]) -> list[Block]:
    """The blocks without loose text of outermost divs and sections that follows the one with nearly all text."""
    sizes: Counter = Counter()
    for b in data:
        sizes[_region(b.path)] += len(b.text)
    best, most = max(sizes.items(), key=lambda x: x[1], default=("", 0))
    if best.split(".")[0] not in ("div", "section") or 10 * most < 8 * sizes.total():
        return data
    last = max(k for k, b in enumerate(data) if _region(b.path) == best)
    loose = lambda b: b.path.rpartition("/")[2] == _region(b.path) and _region(b.path).split(".")[0] in ("div", "section")
    return [b for k, b in enumerate(data) if k <= last or not loose(b)]


def _extract(cfg: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            last: tuple = (None, set(), set())
            for host, page, texts, slots in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("texts"), batch.column("slots"), strict=True):
                if last[0] != host:
                    last = (host, set(texts.as_py() or ()), set(slots.as_py() or ()))
                out.append(main_text(page.as_py(), last[1], last[2], cfg))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, cfg: Template = Template()) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    dealt = _deal(rows, cfg)
    # templates are small and exist for hosts of many pages only: each goes to every salt of its pages
    templates = _deduce(dealt, cfg).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    joined = dealt.join(templates.hint("merge"), ["host", "salt"], "left")
    return joined.mapInArrow(_extract(cfg), f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
