"""HTML extraction (8): the article's text by tree scoring.

A forgiving tokenizer builds a tree. Elements that are never article text (scripts, navigation, asides, hidden ones)
are left out. Forms and elements that a class, id or role marks as menu, notice, advert, comments and the like are left
out too, unless they are around the largest <article> or <main> or, on pages without, hold most of the unlinked text
(which comment sections may not claim): a mark then only lowers the score. If no text is left, all marks do no more. A class or id is a
mark by its head word (`blog-sidebar`, `ad-slot`), not by any word in it (`no-sidebar`, `related-work`).

Every paragraph, that is an element with text of its own, passes points for its length and its commas to its ancestors,
less with each level; a container's points are discounted by its link density. The best container is kept whole, with
those siblings, and text beside it, that score enough or have few links. A container inside an <article> or <main>
stands for that element, one that directly holds some for the largest of them; the siblings of that element follow the
same rule.

Defined cases: null or empty html gives the empty text. Repeated rows are extracted each. Pages without any markup
are one block. Elements may nest to any depth. Only page_id, url and html of the input are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.cluster import prepare

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style textarea title xmp iframe noembed noframes noscript template head nav aside footer button select option input svg math canvas object audio video dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SCOPE = frozenset("html body article main section div td th table ul ol dl blockquote li".split())
#: Elements that may stand inside a paragraph without ending it.
WITHIN = INLINE | (VOID - {"hr"}) | frozenset("script style template noscript button select option textarea title iframe object audio video canvas svg math".split())
CLOSES_ITSELF = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside notice notices cookie cookies consent gdpr banner alert popup modal overlay ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion form login signup newsletter subscribe subscription search share sharing social comment comments commentlist disqus reply replies respond related recommended "
    "pagination pager toolbar widget skip".split()
)
#: Words after a mark that leave it one (`ad-slot`), and before it that take it away (`no-sidebar`).
NEUTRAL = frozenset("area aside bar block body bottom box button buttons col column container content foot group head holder icons inner inset item items left link links list main menu module nav outer panel post posts article articles primary right row secondary section site slot small story stories top unit widget widgets wrap wrapper zone".split())
WITHOUT = frozenset("no not non with without has have is hide hides below above".split())
#: A class or id that begins with one of these is a reader's part, however long.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: What a mark leaves of the score of an element that stays.
MARKED = 0.75
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("children", "dropped", "links", "mark", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, mark: str = ""):
        self.tag, self.parent, self.dropped, self.mark = tag, parent, dropped, mark
        self.children: list[Node | str] = []
        self.score, self.size, self.links = 0.0, 0, 0


def _marked(value: str, marks: frozenset[str] | set[str]) -> str:
    """The mark of a class or id: "comments", "other" or none."""
    found = ""
    for name in value.split():
        words = [w for w in _WORD.findall(name) if not w.isdigit()]
        if WITHOUT.intersection(words):
            continue
        while len(words) > 1 and words[-1] in NEUTRAL and words[-1] not in marks:
            words.pop()
        if words and (words[-1] in marks or words[0] in marks and words[0] in COMMENTS):
            if words[0] in COMMENTS or words[-1] in COMMENTS:
                return "comments"
            found = "other"
    return found


def _unwanted(tag: str, attributes: str, parent: Node) -> tuple[bool, str]:
    """Whether an element is never article text, and its mark: "comments", "other" or none."""
    if tag in NEVER:
        return True, ""
    if tag == "header":
        while parent is not None and parent.tag not in ("article", "main"):
            parent = parent.parent
        return parent is None, ""
    mark = "other" if tag == "form" else ""
    if not attributes or tag in ("html", "body", "main"):
        return False, mark
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if tag == "article":
            # An article may still be a reader's comment.
            marks = {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo"}
        else:
            marks = MARKS
        if name in ("class", "id"):
            own = _marked(value, marks)
            mark = own if own == "comments" else mark or own
        if name == "role" and value in ROLES:
            mark = mark or "other"
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, ""
    return False, mark


def parse(page: str) -> Node:
    root = at = Node("html", None)
    position, n = 0, len(page)
    while position < n:
        m = _TAG.search(page, position)
        if m is None:
            at.children.append(page[position:])
            break
        if m.start() > position:
            at.children.append(page[position : m.start()])
        position = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag not in WITHIN:
            node = at
            while node.parent is not None and node.tag not in SCOPE and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in CLOSES_ITSELF:
            node, own = at, CLOSES_ITSELF[tag].split()
            while node.parent is not None and node.tag not in own and node.tag not in ("ul", "ol", "dl", "table", "select"):
                node = node.parent
            if node.tag in own:
                at = node.parent
        node = Node(tag, at, *_unwanted(tag, m[3], at))
        at.children.append(node)
        if tag in RAW:
            m = _RAW_END[tag].search(page, position)
            end = m.start() if m else n
            close = page.find(">", end)
            position = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
    return root


def settle(root: Node, keep_all: bool = False) -> bool:
    """Drop the marked elements that may go, or none; whether any element is marked."""
    order, stack = [], [(root, False, False)]
    while stack:
        x, link, comment = stack.pop()
        order.append((x, link, comment))
        stack += [(c, link or c.tag == "a", comment or c.mark == "comments") for c in x.children if not isinstance(c, str) and not (c.dropped and not c.mark)]
    marked = [x for x, _, _ in order if x.mark]
    if not marked:
        return False
    free: dict[int, int] = {}
    for x, link, _ in reversed(order):
        own = 0 if link else sum(len(c) - c.count(" ") for c in x.children if isinstance(c, str) and c.strip())
        free[id(x)] = own + sum(free.get(id(c), 0) for c in x.children if not isinstance(c, str))
    spared: set[int] = set()
    articles = [x for x, _, comment in order if x.tag in ("article", "main") and not x.mark and not comment and free[id(x)]]
    up = max(articles, key=lambda x: free[id(x)], default=None)
    largest = 0 if up is not None else 2  # without an article, what holds more than half of the text may be the page
    while up is not None:
        spared.add(id(up))
        up = up.parent
    for x in marked:
        x.dropped = not (keep_all or id(x) in spared or x.mark != "comments" and largest * free[id(x)] > free[id(root)])
    return True


def _measure(node: Node, in_link: bool, found: list[Node]) -> None:
    """Sizes and link sizes of all kept nodes, and the paragraphs; no recursion, pages may be deep."""
    order, stack = [], [(node, in_link)]
    while stack:
        x, link = stack.pop()
        order.append((x, link))
        for c in x.children:
            if not isinstance(c, str) and not c.dropped:
                stack.append((c, link or c.tag == "a"))
    for x, link in reversed(order):
        own = 0
        for c in x.children:
            if isinstance(c, str):
                own += len(c) - c.count(" ") if c.strip() else 0
        x.size += own
        if link:
            x.links += own
        if x.parent is not None and x is not node:
            x.parent.size += x.size
            x.parent.links += x.links
    for x, _ in order:
        if x.tag not in INLINE and any(isinstance(c, str) and c.strip() or not isinstance(c, str) and c.tag in INLINE and not c.dropped and c.size for c in x.children):
            found.append(x)


def _commas(node: Node) -> int:
    """Commas of a paragraph's own text and of the inline elements in it, however deep they nest."""
    n, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                n += c.count(",")
            elif c.tag in INLINE and not c.dropped:
                stack.append(c)
    return n


def choose(root: Node) -> list[Node | str]:
    """The best container and the siblings that belong to it, in page order."""
    found: list[Node] = []
    _measure(root, False, found)
    if not found:
        return []
    scored: dict[int, Node] = {}
    for p in found:
        points = (1 + _commas(p) + min(p.size / 100, 30)) * (1 - p.links / max(p.size, 1))
        level, node = 1.0, p.parent or p  # a float: deep levels fade to nothing; text outside of all elements counts for the page
        while node is not None:
            node.score += points / level * (MARKED if node.mark else 1)
            scored[id(node)] = node
            level, node = level * 2 if level < 4 else level * 3, node.parent
    best = max(scored.values(), key=lambda x: x.score * (1 - x.links / max(x.size, 1)))
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            return _with_siblings(up)
        up = up.parent
    inner = [c for c in best.children if not isinstance(c, str) and not c.dropped and c.tag in ("article", "main")]
    if inner:
        return _with_siblings(max(inner, key=lambda x: x.size))
    return _with_siblings(best)


def _with_siblings(best: Node) -> list[Node | str]:
    if best.parent is None:
        return [best]
    least = max(10.0, best.score * 0.2)
    kept = []
    for c in best.parent.children:
        if isinstance(c, str):
            kept.append(c)
        elif not c.dropped:
            dense = c.links / max(c.size, 1)
            if c is best or c.score * (1 - dense) >= least or c.size and dense < 0.25:
                kept.append(c)
    return kept


def blocks_of(nodes: list[Node | str]) -> Iterator[str]:
    """Texts of the blocks, references decoded and white space made single."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    edge = object()
    while stack:
        x = stack.pop()
        if x is edge:
            if parts:
                yield " ".join(html.unescape("".join(parts)).split())
                parts = []
        elif isinstance(x, str):
            parts.append(x)
        elif x.dropped:
            continue
        elif x.tag in INLINE:
            stack.extend(reversed(x.children))
        else:
            stack.append(edge)
            stack.extend(reversed(x.children))
            stack.append(edge)
    if parts:
        yield " ".join(html.unescape("".join(parts)).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    marked = settle(root)
    text = " ".join(x for x in blocks_of(choose(root)) if x)
    if marked and not text:
        root = parse(page)
        settle(root, keep_all=True)
        text = " ".join(x for x in blocks_of(choose(root)) if x)
    return text


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    prepare(pages.sparkSession)
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
