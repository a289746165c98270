"""Main text of web pages by site template removal.

Each page becomes a light element tree. Every block element's subtree (tag,
class, id, text, children) is hashed, and Spark counts on how many pages of a
host each hash recurs; pages with the same content count once, so a group of
copies doesn't turn an article into a template. Subtrees that recur on
``MIN_PAGES`` contents of a host, however many pages it has, are deleted from
all its pages. Paragraph-level blocks inside an article are content and never
deleted that way.

Of what no other page repeats, elements go whose tag or role says menu, header,
footer, sidebar, notice, advert, form, script or comment, unless they hold the
article, or whose class or id is such a name as a whole: every word of it
outside an article may be a common filler ("site-header"), inside none. Of the
rest, all article (or else main) elements that aren't teasers or comments are
the text, in page order, where a page has any.

The templates of all hosts travel with the tasks while they are ``PACKED`` at
most (8 bytes each), so no html is shuffled; beyond that they are joined to the
pages whose text holds any.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.llm.text import chunks, mix, small_batches
from vetrina.session import cut_lineage

MIN_PAGES = 5
PACKED = 1 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe title textarea noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                    "strike strong sub sup time tt u var wbr img".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption".split())
_CHROME = frozenset("nav aside footer header form button select option fieldset dialog menu svg math canvas object audio video map head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
                   "notification alert newsletter subscribe subscription signup menu nav navbar navigation breadcrumb breadcrumbs sidebar widget "
                   "widgets related recommended share sharing social comment comments disqus replies respond footer header masthead popup modal "
                   "overlay toolbar pagination pager login search skip copyright disclaimer hidden".split())
_FILLER = frozenset("site page main global top bottom left right inner outer box bar block area wrapper wrap container content section group list item "
                    "items link links button buttons icon icons form post posts entry text column col row panel card primary secondary".split())
_NOT_ARTICLE = frozenset("ad ads advert comment comments promo promoted recommended related replies reply sponsored teaser widget".split())
_CLOSES = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
           "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
           "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_KEEP = frozenset(["html", "body", "article", "main", "#page"])

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "names", "inside", "role", "unseen", "hash", "holds")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.inside, self.hash = tag, [], 0
        found = {k.lower(): (v or "").strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attributes))} if attributes.strip() else {}
        self.names = f"{found.get('class', '')} {found.get('id', '')}"
        self.role = found.get("role", "").lower()
        self.unseen = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        self.holds = tag in ("main", "h1") or self.role == "main" or (tag == "article" and not _named(self, _NOT_ARTICLE))


def parse(page: str) -> Node:
    """The element tree of a page; text is in ``inside``, between children.
    Time is linear in the page, and there is no recursion."""
    root = Node("#page")
    open_ = [root]
    places: dict[str, list[int]] = {}  # open elements of each tag
    blocks = [0]  # open elements that aren't inline
    at, tag_pattern = 0, _TAG

    def close(i: int) -> None:
        for node in open_[i:]:
            places[node.tag].pop()
        del open_[i:]
        while blocks[-1] >= i:
            blocks.pop()

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            less = len(page)
        if less > at:
            open_[-1].inside.append(entities.unescape(page[at:less]))
        at = less
        if at >= len(page):
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = len(page) if end < 0 else end + 3
            continue
        if page[at + 1:at + 2] in ("!", "?") or (page[at + 1:at + 2] == "/" and not page[at + 2:at + 3].isalpha()):
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
            continue
        if not page[at + 1:at + 2].isascii() or not (page[at + 1:at + 2].isalpha() or page[at + 1:at + 2] == "/"):
            open_[-1].inside.append("<")
            at += 1
            continue
        m = tag_pattern.match(page, at)
        if not m and tag_pattern is _TAG:
            tag_pattern = _LOOSE_TAG  # an open quote; from here on > ends a tag
            m = tag_pattern.match(page, at)
        if not m:
            break  # the page ends within a tag
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close(places[tag][-1])
            continue
        while len(open_) > 1 and tag in _CLOSES.get(open_[-1].tag, ()):
            close(len(open_) - 1)
        if tag not in _INLINE and tag in _CLOSES.get(open_[blocks[-1]].tag, ()):
            close(blocks[-1])  # a block ends a paragraph whose inline elements are still open
        node = Node(tag, m[3])
        open_[-1].inside.append(node)
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 if end else len(page)
            at = at or len(page)
        elif tag not in _VOID and not m[3].endswith("/"):
            places.setdefault(tag, []).append(len(open_))
            if tag not in _INLINE:
                blocks.append(len(open_))
            open_.append(node)
    return root


def _after_children(root: Node) -> Iterator[Node]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.inside if isinstance(x, Node)]
    return reversed(order)


def digest(root: Node) -> None:
    """Hashes of all subtrees, and which of them hold an article or heading."""
    for node in _after_children(root):
        parts = [node.tag, node.names]
        for x in node.inside:
            if isinstance(x, Node):
                node.holds |= x.holds
                if x.tag not in _RAW:
                    parts.append(f"\x01{x.hash}")
            elif text := " ".join(x.split()):
                parts.append(text)
        node.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"), 7) - (1 << 63)


def _walk(root: Node, cut, inside: bool = False) -> Iterator[tuple[Node, bool]]:
    """(element, within an article) from the top in page order; below
    elements that ``cut`` names nothing comes."""
    todo = [(root, inside)]
    while todo:
        node, within = todo.pop()
        if cut(node, within):
            continue
        yield node, within
        within |= node.tag in ("article", "main")
        todo += [(x, within) for x in reversed(node.inside) if isinstance(x, Node)]


def candidates(tops: list[tuple[Node, bool]], cut) -> set[int]:
    """Hashes of the subtrees below ``tops`` that may be templates."""
    return {n.hash for top, inside in tops for n, within in _walk(top, cut, inside)
            if n.tag not in _KEEP and n.tag not in _INLINE and not (within and n.tag in _TEXT) and not _holds_article(n)}


def _unread(node: Node, within: bool) -> bool:
    return node.tag in _RAW or node.tag in _VOID


def _holds_article(node: Node) -> bool:
    return any(isinstance(x, Node) and x.holds for x in node.inside)


def _chrome(node: Node, within: bool) -> bool:
    if node.tag in _RAW:
        return True
    if node.tag in _KEEP:
        return not node.holds and node.tag == "article"
    if node.unseen:
        return True
    if node.holds and node.tag != "head" and not (node.tag in ("footer", "aside", "nav") and not _holds_article(node)):
        return False
    return node.tag in _CHROME or node.role in _ROLES or _named(node, _NAMES, within)


def _named(node: Node, names: frozenset[str], strict: bool = False) -> bool:
    """Whether one of the element's names says so as a whole: all its words
    are of ``names``; with fillers between them, unless ``strict``."""
    for name in node.names.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & names and words <= (names if strict else names | _FILLER):
            return True
    return False


def _text(node: Node, cut) -> str:
    out: list[str] = []
    todo: list = [(node, False)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        x, within = x
        if cut(x, within):
            out.append(" ")
            continue
        within |= x.tag in ("article", "main")
        edge = "" if x.tag in _INLINE else " "
        out.append(edge)
        todo.append(edge)
        todo += [c if isinstance(c, str) else (c, within) for c in reversed(x.inside)]
    return " ".join("".join(out).split())


def main_part(root: Node, templates: frozenset[int]) -> tuple[str, list[tuple[Node, bool]]]:
    """The page's article without templates and chrome, white space as one
    space; and the elements that it is taken from."""
    def cut(node: Node, within: bool) -> bool:
        return _chrome(node, within) or (node.hash in templates and node.tag not in _KEEP and not (within and node.tag in _TEXT))

    for tag in ("article", "main"):
        tops, skip = [], set()
        for node, _ in _walk(root, cut):
            top = node.tag == tag or (tag == "main" and node.role == "main")
            if top and id(node) not in skip:
                tops.append((node, False))
            if top or id(node) in skip:
                skip.update(id(x) for x in node.inside if isinstance(x, Node))
        texts = [_text(n, cut) for n, _ in tops]
        if any(texts):
            return " ".join(filter(None, texts)), tops
    return _text(root, cut), [(root, False)]


def main_text(root: Node, templates: frozenset[int]) -> str:
    return main_part(root, templates)[0]


# ---- over tables

def _host():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _keyed(pages: DataFrame) -> DataFrame:
    """With the host and a key of the row's content; equal rows share results."""
    return pages.select("page_id", "url", "html", F.xxhash64(_host()).alias("host"), F.xxhash64("url", "html").alias("row_key"))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: a hash of its main text as one page alone shows it, its
    candidates, and those that the main text holds."""
    for batch in chunks(batches, "html"):
        content, found, live = [], [], []
        for page in batch.column("html").to_pylist():
            root = parse(page or "")
            digest(root)
            text, tops = main_part(root, frozenset())
            content.append(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7) - (1 << 63))
            found.append(sorted(candidates([(root, False)], _unread)))
            live.append(sorted(candidates(tops, _chrome)))
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "row_key")] + [
            pa.array(content, pa.int64()), pa.array(found, many), pa.array(live, many)],
            names=["page_id", "host", "row_key", "content", "hashes", "live"])


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash) of subtrees that recur on many contents of their host."""
    return (subtrees.select("host", "content", F.explode("hashes").alias("hash")).distinct()
            .groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash"))


def packed_keys(host, hashes: np.ndarray) -> np.ndarray:
    """One number for each pair of host and subtree hash."""
    return mix(np.asarray(hashes, np.int64).view(np.uint64) ^ mix(np.atleast_1d(np.asarray(host, np.int64)).view(np.uint64)))


def _extract(packed: np.ndarray | None):
    """mapInArrow function: texts without the templates in ``packed`` (sorted
    keys), or without those in the rows' own ``gone``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = []
            which = batch.column("gone" if packed is None else "host").to_pylist()
            for page, of in zip(batch.column("html").to_pylist(), which, strict=True):
                root = parse(page or "")
                digest(root)
                gone = of or ()
                if packed is not None:
                    found = np.array(sorted({n.hash for n in _after_children(root)}), np.int64)
                    keys = packed_keys(of, found)
                    at = np.searchsorted(packed, keys)
                    gone = found[(at < len(packed)) & (packed[np.minimum(at, len(packed) - 1)] == keys)].tolist() if len(packed) else ()
                texts.append(main_text(root, frozenset(gone)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, packed: int = PACKED) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars
    (code points of text).

    A null or empty page has an empty text. Pages whose url is null or has no
    host count as one host. Repeated rows each get their row; other columns
    are ignored.
    """
    small_batches(pages.sparkSession)
    rows = _keyed(pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    subtrees = cut_lineage(rows.drop("url").mapInArrow(
        _subtrees, f"page_id {kind}, host long, row_key long, content long, hashes array<long>, live array<long>"), "subtrees")
    recurring = cut_lineage(templates(subtrees, min_pages), "templates")
    out = f"page_id {kind}, url string, text string, n_chars long"
    if recurring.count() <= packed:
        found = recurring.toPandas()
        keys = np.sort(packed_keys(found["host"].to_numpy(np.int64), found["hash"].to_numpy(np.int64)))
        return rows.select("page_id", "url", "html", "host").mapInArrow(_extract(keys), out)
    # only pages whose main text holds a template need another look; written, so that the planner knows how many
    gone = cut_lineage(subtrees.select("page_id", "row_key", "host", "live", F.explode("hashes").alias("hash"))
                       .select("page_id", "row_key", "host", "hash", F.array_contains("live", F.col("hash")).alias("live"))
                       .join(recurring, ["host", "hash"])
                       .groupBy("page_id", "row_key").agg(F.collect_set("hash").alias("gone"), F.max("live").alias("live"))
                       .where("live").drop("live"), "gone")
    found = rows.drop("host").alias("p").join(gone.alias("g"), F.expr("p.page_id <=> g.page_id AND p.row_key = g.row_key"), "left")
    return found.select("p.page_id", "url", "html", "gone").mapInArrow(_extract(None), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
