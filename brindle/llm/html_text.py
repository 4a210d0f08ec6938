"""Main text of web pages by tree scoring.

A page becomes a tree. Each block's own text, inline elements included, gives points for its length and its commas to its
ancestors, less the further up they are; a container's points are discounted by its share of linked text. The best container
is kept, with its siblings: beside an article or main those that score well against it or are plain text of their own, and a
main heading before one that has none; else all but what is mostly linked, headings, lists and short sections included.
Inside, boilerplate goes by tag, role and the words of class and id, and cells that hold links alone beside the one that holds most of the page;
buttons and labels stay where a paragraph's words name them. What goes by such words, or as a form, stays if it
holds most of the page's unlinked text. Parsing and scoring take time in proportion to the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import by_bytes

#: A tag behind its "<": quotes hold a ">" only where they are an attribute's value. Possessive, so that one look is one pass.
_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_BARE_END = re.compile(r"=\s*+[^\s\"'>=]++\Z")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags whose text is never the article's.
DROPPED = frozenset("script style noscript template iframe object embed svg annotation annotation-xml canvas audio video map head title nav aside footer form fieldset button select option input textarea label dialog menu".split())
#: Of these, what stands in a paragraph's own words is named in the text.
_NAMED = frozenset("button label".split())
#: A start tag that ends an open one.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table ul ol dl body html article section div main td th blockquote".split())
_WORDS = "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus foot footer footnav gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion rail recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split()
#: A class or id is boilerplate if it is one of the words, or words alone with parts that tell place or shape.
_SHAPES = "left right top bottom site global box wrap wrapper container list area block bar links [0-9]+".split()
_BOILERPLATE = re.compile(r"(?:^|\s)(?:(?:{s})[_-]+)*(?:{w})(?:[_-]+(?:{w}|{s}))*(?=$|\s)".format(w="|".join(_WORDS), s="|".join(_SHAPES)))
#: Readers' replies and consent texts are often longer than the article: they stay only where there is no other text.
_APART = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|consent|cookies?|gdpr)(?:$|[\s_-])")
#: Their ids are slugs of their text.
_SLUGS = frozenset("h1 h2 h3 h4 h5 h6 p pre dt dd".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form toolbar".split())
_PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
_CONTAINER = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "body": -5.0, "html": -10.0}


class Node:
    __slots__ = ("tag", "hint", "role", "hidden", "parent", "parts", "size", "linked", "points", "prose", "inside", "widest")

    def __init__(self, tag: str, parent: Node | None, hint: str = "", role: str = "", hidden: bool = False):
        self.tag, self.parent, self.hint, self.role, self.hidden = tag, parent, hint, role, hidden
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.parts: list[Node | str] = []
        self.size = self.linked = self.prose = self.widest = 0
        self.points = 0.0

    def never(self) -> bool:
        """Boilerplate however much it holds."""
        if self.tag in _NAMED and self.parent is not None and self.parent.tag == "p":
            return self.hidden or sum(len(x.strip()) for x in self.parent.parts if isinstance(x, str)) <= sum(len(x.strip()) for x in self.parts if isinstance(x, str))
        if self.tag in DROPPED and self.tag not in ("form", "fieldset") or self.hidden or self.role in _ROLES and self.role != "form":
            return True
        return self.tag == "header" and not self.inside

    def boilerplate(self, whole: int) -> bool:
        """Whether it goes from a page of so much unlinked text."""
        if self.never():
            return True
        if self.tag in ("form", "fieldset") or self.role == "form":
            return 2 * self.prose <= whole
        # links beside the cell of a layout that holds the page
        if self.tag in ("td", "th") and not self.prose and self.parent is not None and 2 * self.parent.widest > whole:
            return True
        if self.hint and self.tag not in ("html", "body", "article", "main") and _BOILERPLATE.search(self.hint):
            return 2 * self.prose <= whole or bool(_APART.search(self.hint)) and self.prose < whole
        return False

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


def _attributes(source: str, tag: str) -> tuple[str, str, bool]:
    hint, role, hidden = [], "", False
    for m in _ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class" or name == "id" and tag not in _SLUGS:
            hint.append(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return " ".join(hint), role, hidden


class _Open:
    """The open elements. What a tag may close is found by counts, so that a step up is paid for by the element it closes."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.scopes = [root], [root], [root]
        self.tags: dict[str, int] = {}
        self.in_block: list[dict[str, int]] = [{}]  # inline elements above each open block
        self.in_scope: list[dict[str, int]] = [{}]  # elements above each of _SCOPE

    def push(self, node: Node) -> None:
        self._count(node.tag, 1)
        self.stack.append(node)
        if node.tag in BLOCKS:
            self.blocks.append(node)
            self.in_block.append({})
        if node.tag in _SCOPE:
            self.scopes.append(node)
            self.in_scope.append({})

    def _count(self, tag: str, by: int) -> None:
        for counts in (self.tags, self.in_scope[-1], *([] if tag in BLOCKS else [self.in_block[-1]])):
            counts[tag] = counts.get(tag, 0) + by

    def pop(self) -> Node:
        node = self.stack.pop()
        if node.tag in BLOCKS:
            self.blocks.pop()
            self.in_block.pop()
        if node.tag in _SCOPE:
            self.scopes.pop()
            self.in_scope.pop()
        self._count(node.tag, -1)
        return node

    def close(self, tags: set[str]) -> None:
        while self.pop().tag not in tags:
            pass

    def end(self, tag: str) -> None:
        """An end tag; an inline one doesn't reach over an open block, and one that nothing open answers to is nothing."""
        if (self.tags if tag in BLOCKS else self.in_block[-1]).get(tag):
            self.close({tag})

    def make_room(self, tag: str) -> None:
        """Closes what a start tag ends."""
        if tag in BLOCKS:
            block = self.blocks[-1].tag
            if block == "p" or block in _HEADINGS and tag in _HEADINGS:
                self.close({block})
        ends = ENDS.get(tag, ())
        while ends and (any(self.in_scope[-1].get(x) for x in ends) or self.scopes[-1].tag in ends):
            self.close(ends)
            if tag not in ("tr", "thead", "tbody", "tfoot"):
                break


def parse(source: str) -> Node:
    """The page's tree. Unclosed and misnested tags are closed as far as the open ones tell; nothing is refused. A tag that
    the page's end cuts off goes, with what is in it. Time grows with the page's length."""
    root = Node("html", None)
    opened = _Open(root)
    begin = at = 0  # of the text not yet kept, and of the search
    last = source.rfind(">")
    quotes = True

    def keep(stop: int) -> None:
        if stop > begin:
            text = source[begin:stop]
            opened.stack[-1].parts.append(html.unescape(text) if "&" in text else text)

    while (at := source.find("<", at)) >= 0:
        mark = source[at + 1 : at + 2]
        if mark == "!" or mark == "?":
            keep(at)
            for head, tail in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                if source.startswith(head, at):
                    stop = source.find(tail, at + len(head))
                    if head == "<![CDATA[":
                        opened.stack[-1].parts.append(source[at + 9 : stop if stop >= 0 else len(source)])
                    begin = at = stop + len(tail) if stop >= 0 else len(source)
                    break
            continue
        name = source[at + 2 : at + 3] if mark == "/" else mark
        if not (name.isascii() and name.isalpha()):
            at += 1
            continue
        keep(at)
        if at > last:
            begin = len(source)
            break
        m = _TAG.match(source, at + 1) if quotes else None
        if m is None:
            # a quoted value has no end: from here on tags end at the next ">"
            quotes = False
            m = _PLAIN_TAG.match(source, at + 1)
        begin = at = m.end()
        tag = m[2].lower()
        if tag == "html":
            continue
        if m[1]:
            opened.end(tag)
            continue
        opened.make_room(tag)
        own = Node(tag, opened.stack[-1], *(_attributes(m[3], tag) if m[3].strip() else ("", "", False)))
        opened.stack[-1].parts.append(own)
        # a slash that ends a value without quotes is the value's
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and not _BARE_END.search(m[3]):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            begin = at = end.end() if end else len(source)
            continue
        opened.push(own)
    keep(len(source))
    return root


def _weigh(root: Node) -> None:
    """Sets every node's unlinked text size, without what never stays."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "a" or node.parent is not None and node.never():
            continue
        order.append(node)
        stack += [x for x in node.parts if isinstance(x, Node)]
    for node in reversed(order):
        node.prose = sum(len(x.strip()) if isinstance(x, str) else x.prose for x in node.parts)
        node.widest = max((x.prose for x in node.parts if isinstance(x, Node)), default=0)


def _measure(root: Node) -> list[Node]:
    """Sets every node's text size and linked size, boilerplate left out; returns nodes in page order."""
    _weigh(root)
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.boilerplate(root.prose) and node.parent is not None:
            node.size = -1
            continue
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    for node in reversed(order):
        node.size = sum(len(x.strip()) if isinstance(x, str) else max(0, x.size) for x in node.parts)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in node.parts if isinstance(x, Node) and x.size > 0)
    return order


def _own_text(node: Node) -> str:
    """A block's text without that of blocks inside it."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(node.parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in BLOCKS and x.size >= 0:
            stack += reversed(x.parts)
    return "".join(out)


def _with_siblings(top: Node) -> Node:
    """A container of top and what is beside it, without blocks and runs of inline text that are mostly linked."""
    while top.parent is not None and top.parent.size == top.size:
        top = top.parent
    if top.parent is None:
        return top
    shell = Node("div", None)
    run: list[Node | str] = []
    for x in (*top.parent.parts, None):
        if isinstance(x, str) or x is not None and x.tag not in BLOCKS:
            run.append(x)
            continue
        for group in (run, [x] if x is not None else []):
            size = sum(len(y.strip()) if isinstance(y, str) else max(0, y.size) for y in group)
            linked = sum(y.linked for y in group if isinstance(y, Node) and y.size > 0)
            if top in group or 2 * linked < size:
                shell.parts += group
        run = []
    return shell


def _titled(top: Node) -> bool:
    """Whether a main heading stays inside."""
    stack = [top]
    while stack:
        node = stack.pop()
        if node.tag == "h1" and node.size > 0:
            return True
        stack += [x for x in node.parts if isinstance(x, Node) and x.size > 0]
    return False


def best(root: Node) -> list[Node]:
    """The container of most points and the siblings that go with it, in page order or in a container of their own."""
    order = _measure(root)
    held: list[Node] = []
    for node in order:
        if node.tag in BLOCKS and (text := _own_text(node).strip()):
            points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 30)
            start = node if node.tag not in _PARAGRAPHS else node.parent
            for k, up in enumerate((start, *islice(start.above(), 5)) if start else ()):
                if up.points == 0:
                    held.append(up)
                    up.points = _CONTAINER.get(up.tag, 0.0) or 1e-6
                up.points += points / (1, 2, 4, 8, 16, 32)[k]
    if not held:
        return []
    value = {id(n): n.points * (1 - (n.linked / n.size if n.size else 0)) for n in held}
    top = max(held, key=lambda n: value[id(n)])
    # a single article or main that holds the winner is the whole of the text
    for up in (top, *top.above()):
        if up.tag in ("article", "main") and up.size >= top.size:
            top = up
    if top.tag not in ("article", "main"):
        return [_with_siblings(top)]
    if top.parent is None:
        return [top]
    floor = max(10.0, 0.2 * value.get(id(top), 0.0))
    titled = _titled(top)
    kept = []
    for x in top.parent.parts:
        if not isinstance(x, Node) or x.size <= 0:
            continue
        if x.tag == "h1" and not titled and 2 * x.linked < x.size and top not in kept:
            kept.append(x)
            continue
        density = x.linked / x.size
        plain = x.tag == "p" and (x.size > 80 and density < 0.25 or density == 0 and re.search(r"[.!?](\s|$)", _own_text(x)))
        if x is top or value.get(id(x), 0.0) >= floor and density < 0.5 or plain:
            kept.append(x)
    return kept


def blocks(node: Node) -> Iterator[str]:
    """The texts of a container's blocks in page order, white space in them single."""
    out: list[str] = []

    def flush() -> str:
        text = " ".join("".join(out).split())
        out.clear()
        return text

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        x, over = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in BLOCKS and (text := flush()):
            yield text
        if over or x.size < 0:
            continue
        if x.tag == "br":
            out.append(" ")
        if x.tag in BLOCKS:
            stack.append((x, True))
        stack += [(y, False) for y in reversed(x.parts)]
    if text := flush():
        yield text


def main_text(source: str | None) -> str:
    """The article of a page; empty if it has none."""
    return "\n".join(t for node in best(parse(source or "")) for t in blocks(node))


def extract(pages: DataFrame, source: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages have the empty text. Repeated pages are extracted each, a null page_id or url stays null,
    empty input gives no rows, other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column("html")):
                part = batch.slice(a, b - a)
                texts = [main_text(None if t is None else t.decode("utf-8", "replace")) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("binary").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
