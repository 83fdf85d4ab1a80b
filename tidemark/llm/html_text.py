"""Main text of web pages by removal of site templates.

Pages are parsed into elements. Every element has a hash of its subtree (tag names and text, not addresses, which differ
from page to page). Hashes are counted per host, once for pages of the same content; a subtree that recurs on many pages of
its host is template and is deleted. Elements that say what they are (menus, forms, comments of readers, ..) are deleted by
name. Inside an article this holds for whatever holds blocks (boxes, sections, lists, tables) and for elements without a meaning;
its own paragraphs, headings and quotations are its text, also a sentence that many articles share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, whole_text
from tidemark.session import materialise

#: A subtree is template if so many pages of a host, and this share of them, have it.
MIN_PAGES, MIN_SHARE = 5, 0.3

#: Elements that are never text of an article, elements without an end, and elements that make a block.
DROPPED = frozenset(
    "script style noscript template nav header footer aside form button select option textarea input label svg math iframe object embed canvas "
    "audio video map menu dialog head title datalist fieldset".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An article's own blocks of prose, with all that is in them, and what is part of a sentence; neither is template there.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dd dt caption figcaption summary".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
PARTS = frozenset("tbody thead tfoot tr td th".split())  # of a table: no template on their own, but what is in them can be
#: An element with more of an article's text than this is no template of it: copies that differ in a few words.
MOST = 0.9
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar side aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments discussion disqus replies reply respond related "
    "recommended recommendations widget toolbar pagination pager search contentinfo complementary skip".split()
)
_MARK_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "marks", "children", "parent")

    def __init__(self, tag: str, marks: str = "", parent: Element | None = None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list[Element | str] = []

    @property
    def named(self) -> bool:
        """Does the element say that it is not article text?"""
        if self.tag in DROPPED:
            return True
        return self.tag not in ("html", "body", "article", "main") and any(w in MARKS for w in _MARK_WORD.findall(_CAMEL.sub(" ", self.marks).lower()))


class PageParser(HTMLParser):
    """Elements of a page; copes with what is left open: a paragraph ends where a block begins, an end closes what is in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Element("html")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and tag != "br":
            self._end_paragraph(tag)
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        if any(k in ("hidden", "aria-hidden") and v in (None, "", "hidden", "true") for k, v in attrs):
            marks += " popup"
        made = Element(tag, marks, self.open)
        self.open.children.append(made)
        if tag not in VOID:
            self.open = made

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def _end_paragraph(self, tag: str) -> None:
        node = self.open
        while node.parent is not None and (node.tag not in BLOCKS or node.tag in ("p", "li", "dd", "dt")):
            if node.tag == "p" or (node.tag == tag and tag in ("li", "dd", "dt")):
                self.open = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            if node.tag in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table"):
                return  # an end that was never begun
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Element:
    parser = PageParser()
    parser.feed(html)
    parser.close()
    return parser.root


def _walk(root: Element) -> Iterator[Element]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


def _mains(root: Element) -> list[Element]:
    """The elements that hold the article: ``article``, else ``main``. Those within what is deleted by name do not count,
    unless there is no other and only the class of what surrounds them speaks against them."""
    for strict in (True, False):
        found: dict[str, list[Element]] = {"article": [], "main": []}
        stack = [root]
        while stack:
            node = stack.pop()
            if node is not root and (node.tag in DROPPED or (strict and node.named)):
                continue
            if node.tag in found:
                found[node.tag].append(node)
            if node.tag != "article":
                stack.extend(c for c in reversed(node.children) if isinstance(c, Element))
        if found["article"] or found["main"]:
            break
    return found["article"] or found["main"]


def subtree_hashes(root: Element) -> dict[Element, int]:
    """A 64-bit hash for each element: tag, and hashes or text (white space as one space) of what is in it."""
    order = list(_walk(root))
    hashes: dict[Element, int] = {}
    for node in reversed(order):
        digest = blake2b(node.tag.encode(), digest_size=8)
        for child in node.children:
            if isinstance(child, str):
                digest.update(b"\0" + _SPACE.sub(" ", child).strip().encode())
            else:
                digest.update(b"\1" + hashes[child].to_bytes(8, "little", signed=True))
        hashes[node] = int.from_bytes(digest.digest(), "little", signed=True)
    return hashes


def _containers(main: Element) -> Iterator[Element]:
    """The elements within an article that may be template; what is deleted by name is left out."""
    stack = [main]
    while stack:
        node = stack.pop()
        if node is not main:
            if node.tag in PROSE or node.tag in INLINE or node.tag in VOID or node.named:
                continue
            if node.tag not in PARTS:
                yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element))


def _template_candidates(root: Element) -> tuple[set[int], int]:
    """Hashes of the subtrees that may be template, and the hash of the page's content: its articles, else its body."""
    mains = _mains(root)
    hashes = subtree_hashes(root)
    if not mains:
        bodies = [n for n in _walk(root) if n.tag == "body"] or [root]
        return {h for n, h in hashes.items() if n.parent is not None and n.tag not in ("html", "body", "head")}, _content(bodies, hashes)
    return {hashes[n] for main in mains for n in _containers(main)}, _content(mains, hashes)


def _content(nodes: list[Element], hashes: dict[Element, int]) -> int:
    digest = blake2b(b"".join(hashes[n].to_bytes(8, "little", signed=True) for n in nodes), digest_size=8)
    return int.from_bytes(digest.digest(), "little", signed=True)


def _weights(root: Element) -> dict[Element, int]:
    """Characters of each element's text, white space and what is deleted by name left out."""
    weights: dict[Element, int] = {}
    for node in reversed(list(_walk(root))):
        own = sum(len("".join(c.split())) if isinstance(c, str) else weights[c] for c in node.children)
        weights[node] = 0 if node is not root and node.named else own
    return weights


def _deleted(root: Element, mains: list[Element], template: set[int]) -> set[Element]:
    """The elements that are template."""
    if not template:
        return set()
    if not mains:
        return {n for n, h in subtree_hashes(root).items() if h in template}
    found: set[Element] = set()
    for main in mains:
        candidates = list(_containers(main))
        if candidates:
            hashes, weights = subtree_hashes(main), _weights(main)
            found.update(n for n in candidates if hashes[n] in template and weights[n] <= MOST * weights[main])
    return found


def main_text(root: Element, template: set[int]) -> str:
    """Text of the blocks of the article, or of the page without an article, less what is deleted."""
    mains = _mains(root)
    deleted = _deleted(root, mains, template)
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            blocks.append(text)
        run.clear()

    for main in mains or [root]:
        stack: list[tuple[Element | str | None, bool]] = [(main, False)]
        while stack:
            node, closing = stack.pop()
            if isinstance(node, str):
                run.append(node)
            elif closing:
                end()
            elif node is not main and (node.named or node in deleted):
                if node.tag in BLOCKS:
                    end()
            else:
                if node.tag in BLOCKS:
                    end()
                    stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
        end()
    return " ".join(blocks)


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, hash, content), each once per batch; hash null counts the pages themselves."""
    for batch in batches:
        seen: dict[tuple[str, int | None, int], None] = {}
        for host, html in zip(batch["_host"], batch["_html"]):
            hashes, content = _template_candidates(parse(html))
            seen[host, None, content] = None
            seen.update(((host, h, content), None) for h in hashes)
        made = pd.DataFrame(list(seen), columns=["host", "hash", "content"])
        yield made.assign(hash=pd.array([b for _, b, _ in seen], dtype="Int64"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per host that has template: host, template (hashes). ``pages`` has _host and _html.

    Pages of a host with the same content count as one, so an article with many copies is no template. A page has a bounded
    share in a subtree's count, so a host has at most ``elements of a page / min_share`` of them.
    """
    seen = pages.mapInPandas(_hash_rows, "host string, hash long, content long").distinct()
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = materialise(counts.where((F.col("n") >= min_pages) | F.col("hash").isNull()), "subtrees")
    sizes = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    frequent = counts.where("hash is not null").join(sizes, "host").where(F.col("n") >= min_share * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list("hash").alias("template"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", name: str = "main_text") -> DataFrame:
    """Add ``name``: the main text of each page, all other columns kept.

    Null html counts as empty: an empty text. Pages without an address share the host ''. Repeated rows count once
    for templates. A page of any length is parsed whole; the parser's state is the page's elements.
    """
    bounded_batches(pages.sparkSession)
    address = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.lower(address)
    read = pages.select(host.alias("_host"), whole_text(F.col(html)).alias("_html"))
    templates = materialise(site_templates(read), "templates")
    marked = pages.withColumn("_tidemark_host", host).join(templates.withColumnRenamed("host", "_tidemark_host").withColumnRenamed("template", "_tidemark_template"), "_tidemark_host", "left")

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, templates in batches:
            yield pd.Series([main_text(parse(h), set(t) if t is not None else set()) for h, t in zip(htmls, templates)], dtype=object)

    made = marked.withColumn(name, text_of(whole_text(F.col(html)), F.col("_tidemark_template")))
    return made.drop("_tidemark_host", "_tidemark_template")
