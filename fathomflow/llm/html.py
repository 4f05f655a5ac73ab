"""Main text of web pages: site templates are removed by counting element subtrees per host.

Pages are parsed twice. First every page gives the hashes of all its block subtrees with text, menus and footers among
them, and Spark counts, per host, the pages that hold each; a second parse deletes the subtrees that recur across many
pages of the host. What recurrence cannot show, because its text differs from page to page or the host has few pages, is
then dropped by its kind, role or class (adverts, notices, forms, comments, and menus and footers of small sites).
If what is left has an article or main element with text, the text is taken from there.

Counts are shuffled as pairs of hashes, not pages; recurring subtrees are broadcast up to a checked size, and
beyond it each page gets its own by a join.

Defined results: a null page is empty; a page that ends anywhere is closed there; unclosed and stray tags are
repaired; a null URL belongs to the empty host; null ids and repeated rows do not matter (equal pages of one
host and pages with the same article count once); other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Container, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, written
from .urls import parse_url
from .workers import tidy

#: A subtree outside of an article is template when this many different pages of a host hold it, plus the binary logarithm of the host's
#: pages: a notice of several wordings or the menu of a section is on many pages, not on most.
MIN_PAGES = 4
#: Tags with a quote that never closes, after which quotes of a page no longer hide the end of a tag. Each costs a look at the rest of the page.
OPEN_QUOTES = 32
#: Inside of an article, where copies of texts recur too, most pages of a large host must hold it.
MIN_ARTICLE_PAGES = 20
MIN_ARTICLE_SHARE = 0.6
#: Up to this many recurring subtrees are broadcast (16 bytes each).
BROADCAST_SUBTREES = 1_000_000

# Elements by their kind.
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav aside footer form button select option textarea input label dialog menu map".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption address hr form fieldset details summary center".split())
CONTENT = frozenset(("article", "main"))
#: Blocks of running text: they are no template in the element that directly holds most of a page's own text.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote figure figcaption".split())
# Roles, and words of classes and ids, that mark what is no article.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
    "reply replies respond disqus share sharing social related recommended popup modal overlay pagination pager widget toolbar skip".split()
)
# An opening tag closes an open element of these kinds, up to the nearest of the bounds.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table article main section div body html td th aside nav footer header form blockquote".split())

_PLAIN = r"(?P<plain_close>/?)(?P<plain>[a-zA-Z][^\s/>]*)(?P<plain_attributes>[^>]*)(?P<plain_end>>|\Z)"
_OTHERS = r"!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)"
_TAG = re.compile(rf"<(?:(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?P<end>>|\Z)|{_OTHERS}|{_PLAIN})", re.S)
#: The same without regard to quotes.
_PLAIN_TAG = re.compile(rf"<(?:{_OTHERS}|{_PLAIN})", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
#: A class that begins or ends with one of these says what an element lacks, or what stands beside it.
_NEGATIONS = frozenset("no non not without has have with free less hide hidden is".split())
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MASK = (1 << 63) - 1


class Element:
    """An element or, without a tag, a text; ``key`` is the hash of the subtree, 0 without any text; ``content`` tells whether
    it is or holds an article or main element."""

    __slots__ = ("attributes", "children", "content", "key", "tag", "text")

    def __init__(self, tag: str, attributes: str = "", text: str = ""):
        self.tag, self.attributes, self.text, self.children, self.key, self.content = tag, attributes, text, [], 0, tag in CONTENT


class _Open:
    """The open elements of a page; where the last one of a kind and the last bound stand is known without a walk."""

    def __init__(self):
        self.stack = [Element("")]
        self.places: dict[str, list[int]] = {}
        self.bounds = [0]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in _BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append(element)

    def last(self, tag: str) -> int:
        """The depth of the last open element of a kind, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, depth: int) -> None:
        """Closes open elements down to a depth, hashing each subtree from its children's hashes."""
        while len(self.stack) > depth:
            element = self.stack.pop()
            if self.stack:
                self.places[element.tag].pop()
                if element.tag in _BOUNDS:
                    self.bounds.pop()
            element.content = element.content or any(c.content for c in element.children)
            parts = [str(c.key) for c in element.children if c.key]
            if parts:
                element.key = xxhash.xxh64_intdigest(f"{element.tag} {' '.join(parts)}") & _MASK


def parse(page: str) -> Element:
    """The tree of a page, however broken, in a time that grows with its length alone."""
    opened, at, n, broken = _Open(), 0, len(page), 0
    stack = opened.stack
    root = stack[0]

    def add_text(raw: str) -> None:
        if raw:
            leaf = Element("", text=entities.unescape(raw) if "&" in raw else raw)
            if words := " ".join(leaf.text.split()):
                leaf.key = xxhash.xxh64_intdigest(words) & _MASK
            stack[-1].children.append(leaf)

    while m := (_TAG if broken < OPEN_QUOTES else _PLAIN_TAG).search(page, at):
        add_text(page[at : m.start()])
        at = m.end()
        found = m.groupdict()
        broken += found["plain"] is not None
        tag = found["plain"] or found.get("tag")
        if not tag or not (found["plain_end"] or found.get("end")):  # a comment, a declaration, or a tag that the end of the page cuts
            continue
        tag = tag.lower()
        if found["plain_close"] or found.get("close"):
            if depth := opened.last(tag):
                opened.close(depth)
            continue
        if tag in BLOCKS or tag in _CLOSES:
            depth = max(map(opened.last, _CLOSES.get(tag, ())), default=0)
            if tag in BLOCKS:
                depth = max(depth, opened.last("p"))
            if depth and depth >= opened.bounds[-1]:
                opened.close(depth)
        attributes = found["plain_attributes"] or found.get("attributes") or ""
        element = Element(tag, attributes)
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            stop, after = (end.start(), end.end()) if end else (n, n)
            if tag not in DROPPED:
                opened.push(element)
                add_text(page[at:stop])
                opened.close(len(stack) - 1)
            at = after
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            opened.push(element)
    add_text(page[at:] if at < n else "")
    opened.close(0)
    return root


def article_key(root: Element) -> int:
    """A hash of the page's article and main elements, or of the whole page where it has none with text: copies of a page differ in nothing else that counts."""
    if not root.content:
        return root.key
    keys, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.tag in CONTENT:
            keys.append(element.key)
        elif element.content:
            stack.extend(element.children)
    return xxhash.xxh64_intdigest(" ".join(map(str, keys)), 4) & _MASK if any(keys) else root.key


def is_boilerplate(element: Element, in_content: bool) -> bool:
    """Whether an element is no article by its kind, role, class or id. A header inside of an article is kept: it holds the title."""
    tag = element.tag
    if tag in DROPPED or tag == "header" and not in_content:
        return True
    if tag in ("html", "body", "main") or not element.attributes:
        return False
    # Wrappers of the article are often named after what else they hold.
    named = not element.content
    for name, *values in _ATTRIBUTE.findall(element.attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN_STYLE.search(value):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id") and named:
            for words in map(_WORDS.findall, value.lower().split()):
                if words and (words[0] in DROPPED_WORDS or words[-1] in DROPPED_WORDS) and _NEGATIONS.isdisjoint((words[0], words[-1])):
                    return True
    return False


def subtree_keys(root: Element) -> tuple[set[int], set[int]]:
    """Hashes of all block subtrees with text, outside and inside of article elements."""
    outside, inside = set(), set()
    stack = [(c, False) for c in root.children]
    while stack:
        element, in_content = stack.pop()
        if not element.key or not element.tag:
            continue
        in_content = in_content or element.tag in CONTENT
        if element.tag in BLOCKS and element.tag not in ("html", "body", *CONTENT):
            (inside if in_content else outside).add(element.key)
        stack.extend((c, in_content) for c in element.children)
    return outside, inside


def densest(root: Element, outside: Container[int]) -> Element:
    """The element, no block of running text itself, that directly holds most text without the template subtrees."""
    held: dict[int, int] = {}
    best, stack = root, [(root, root)]
    while stack:
        element, holder = stack.pop()
        if not element.tag:
            held[id(holder)] = held.get(id(holder), 0) + len(element.text.strip())
            if held[id(holder)] > held.get(id(best), 0):
                best = holder
        elif is_boilerplate(element, False) or element.key and element.key in outside:
            continue
        elif element.tag in BLOCKS and element.tag not in TEXTS:
            holder = element
        stack.extend((c, holder) for c in element.children)
    return best


def extract(root: Element, outside: Container[int] = (), inside: Container[int] = ()) -> tuple[str, int]:
    """The main text (blocks in page order, one a line) and how many subtrees were deleted for their hashes."""
    deleted = 0
    blocks: list[tuple[bool, str]] = []
    words: list[str] = []

    def flush(in_content: bool) -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append((in_content, text))

    # An entry is (element, inside of content) to open, or (None, inside) to end a block.
    stack: list[tuple[Element | None, bool, Element]] = [(root, False, root)]
    main = None
    while stack:
        element, in_content, holder = stack.pop()
        if element is None:
            flush(in_content)
            continue
        if not element.tag:
            words.append(element.text)
            stack.extend((c, in_content, holder) for c in reversed(element.children))
            continue
        if element.tag == "br":
            words.append(" ")
            continue
        template = element.key and element.tag in BLOCKS and element.key in (inside if in_content else outside)
        if template and not in_content and element.tag in TEXTS:
            main = main or densest(root, outside)
            template = holder is not main
        if template or is_boilerplate(element, in_content):
            deleted += bool(template)
            flush(in_content)
            continue
        block, within = element.tag in BLOCKS, in_content or element.tag in CONTENT
        if block:
            flush(in_content)
            stack.append((None, within, holder))
            holder = holder if element.tag in TEXTS else element
        stack.extend((c, within, holder) for c in reversed(element.children))
    flush(False)
    content = [t for inner, t in blocks if inner]
    return "\n".join(content or [t for _, t in blocks]), deleted


def _scoped(host: str, key: int, content: bool) -> int:
    """A subtree's key within a host; subtrees in articles have keys of their own."""
    return xxhash.xxh64_intdigest(f"{host} {key}", 2 + content) & _MASK


_SUBTREES = "page_hash long, host_key long, key long, content int, body long"


@tidy
def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each subtree of each page with a hash of its article; a row with content -1 counts the page itself."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for page_hash, host, page in zip(*(batch.column(c).to_pylist() for c in ("page_hash", "host", "html")), strict=True):
            root = parse(page or "")
            host_key = xxhash.xxh64_intdigest(host, 1) & _MASK
            body = article_key(root)
            rows.append((page_hash, host_key, host_key, -1, body))
            for content, keys in enumerate(subtree_keys(root)):
                rows += [(page_hash, host_key, _scoped(host, k, bool(content)), content, body) for k in keys]
        columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int32() if i == 3 else pa.int64()) for i in range(5)], names=["page_hash", "host_key", "key", "content", "body"])


class _HostScope:
    """The dropped subtrees of one host, looked up in sorted keys."""

    def __init__(self, host: str, content: bool, keys: np.ndarray):
        self.host, self.content, self.keys = host, content, keys

    def __contains__(self, key: int) -> bool:
        scoped = _scoped(self.host, key, self.content)
        at = int(np.searchsorted(self.keys, scoped))
        return at < len(self.keys) and int(self.keys[at]) == scoped


_RESULT = "page_id long, url string, text string, n_chars long, n_templates long"


def _extract(broadcast):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = broadcast.value if broadcast is not None else None
        for batch in batches:
            own = batch.column("dropped").to_pylist() if shared is None else [None] * batch.num_rows
            found = []
            for host, page, dropped in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), own, strict=True):
                keys = shared if shared is not None else np.sort(np.array(dropped or [], np.int64))
                found.append(extract(parse(page), _HostScope(host, False, keys), _HostScope(host, True, keys)) if page else ("", 0))
            columns = [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "n_chars", "n_templates"])

    return run


def _templates(subtrees: DataFrame) -> DataFrame:
    """(key): the subtrees that are template on their host."""
    counted = subtrees.select("host_key", "key", "content", "body").distinct().groupBy("host_key", "key", "content").agg(F.count("*").alias("n"))
    totals = counted.where("content = -1").select("host_key", F.col("n").alias("pages"))
    common = counted.where((F.col("content") >= 0) & (F.col("n") >= MIN_PAGES)).join(totals, "host_key")
    outside = (F.col("content") == 0) & (F.col("n") >= MIN_PAGES + F.log2("pages"))
    inside = (F.col("content") == 1) & (F.col("pages") >= MIN_ARTICLE_PAGES) & (F.col("n") >= MIN_ARTICLE_SHARE * F.col("pages"))
    return common.where(outside | inside).select("key")


def extract_text(pages: DataFrame, broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates) of each row of (page_id, url, html); n_templates counts the subtrees deleted
    because they recur on the host."""
    spark = bounded_batches(pages.sparkSession)
    hosted = pages.select("page_id", "url", "html", parse_url(F.col("url"))[0].alias("host"), F.xxhash64("url", "html").alias("page_hash"))
    subtrees = hosted.select("page_hash", "host", "html").mapInArrow(_emit, _SUBTREES)
    templates = written(_templates(subtrees), "html-templates")
    if templates.count() <= broadcast_subtrees:
        keys = np.sort(templates.toPandas()["key"].to_numpy(np.int64))
        return hosted.select("page_id", "url", "html", "host").mapInArrow(_extract(spark.sparkContext.broadcast(keys)), _RESULT)
    own = subtrees.where("content >= 0").select("page_hash", "key").join(templates, "key").groupBy("page_hash").agg(F.collect_set("key").alias("dropped"))
    return hosted.join(own, "page_hash", "left").select("page_id", "url", "html", "host", "dropped").mapInArrow(_extract(None), _RESULT)
