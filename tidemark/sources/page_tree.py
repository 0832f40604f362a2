"""A page as a tree of elements, and what stands around its links, dates and files. Per page; rules over it are Columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements and class names that pages use.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CLOSED_BY_BLOCKS = ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
CLOSED_BY_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FRAME = ("nav", "footer", "aside")
DROPPED = ("nav", "footer", "aside", "script", "style", "noscript", "svg")
ENTRY_WORDS = ("result", "listing", "news", "publication", "media")
ENTRY_CLASSES = ("views-row", "bu-updates__item", "bu-link")
# End of fixed values.

SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}


class Node:
    """An element: its name, attributes, parent and parts (elements and texts) in order."""

    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.parts: list[Node | str] = []

    def up(self) -> Iterator[Node]:
        """The element and its ancestors, from the inside out."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def down(self) -> Iterator[Node]:
        """The elements below, in the order of the page."""
        waiting = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def text(self, without: tuple[str, ...] = ("script", "style")) -> str:
        out, waiting = [], list(reversed(self.parts))
        while waiting:
            part = waiting.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in without:
                waiting += reversed(part.parts)
        return "".join(out)

    def first(self, fits: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.down() if fits(n)), None)

    def nearest(self, fits: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.up() if fits(n)), None)

    def named(self, *tags: str) -> bool:
        return self.tag in tags

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page")

    def _leave(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the nearest open element of these, unless one of ``within`` is nearer."""
        for node in self.at.up():
            if node.tag in within:
                return
            if node.tag in tags and node.parent is not None:
                self.at = node.parent
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_BLOCKS:
            self._leave(("p",), ("button", "td", "th", "table", "object"))
        if tag in CLOSED_BY_KIND:
            for kind in CLOSED_BY_KIND[tag]:
                self._leave((kind,), SCOPES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "p":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for node in self.at.up():
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.parts.append(data)


def page(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def body(root: Node) -> Node:
    return root.first(lambda n: n.named("body")) or root


def _main(root: Node) -> Node | None:
    return root.first(lambda n: n.named("main")) or root.first(lambda n: n.get("role") == "main")


def content(root: Node) -> Node:
    """Where a page's own text stands: main, an article, or the body."""
    return _main(root) or root.first(lambda n: n.named("article")) or body(root)


def semantic_text(root: Node) -> str:
    """The text of the page's content without its frame; of a body also without the headers that are its own children."""
    held = content(root)
    if held.tag in ("body", "#page"):
        held.parts = [p for p in held.parts if isinstance(p, str) or p.tag != "header"]
    return squeeze(held.text(DROPPED if held.tag != "#page" else (*DROPPED, "head", "title")))


def _is_entry(node: Node) -> bool:
    """An element that stands for one publication or result."""
    kind, words = node.get("class"), node.get("class").split()
    if node.tag == "article" or any(w in kind for w in ENTRY_WORDS) or any(w in words for w in ENTRY_CLASSES):
        return True
    return node.tag == "datatable-body-row" and node.get("role") == "row"


def _is_row(node: Node) -> bool:
    return node.tag == "tr" and node.first(lambda n: n.tag == "td" and "views-field" in n.get("class")) is not None


def _is_list(node: Node) -> bool:
    return (node.tag in ("ul", "ol") or node.get("role") == "list") and any(w in node.get("class") for w in ENTRY_WORDS)


def _in(node: Node, *tags: str) -> bool:
    return node.nearest(lambda n: n.tag in tags) is not None


def _links(node: Node) -> Iterator[Node]:
    return (n for n in node.down() if n.tag == "a" and "href" in n.attrs)


def entry_links(root: Node) -> list[dict]:
    """The links of an index page that stand for entries, each with its entry's text and what may be its date, by rank.

    Not in the frame, nor in a header outside any entry; in an item of a list of entries or else in an entry; and the
    entry's first link, or in a heading.
    """
    out = []
    for link in _links(_main(root) or body(root)):
        header = link.nearest(lambda n: n.tag == "header")
        if _in(link, *FRAME) or (header is not None and header.nearest(_is_entry) is None):
            continue
        item = link.nearest(lambda n: n.tag == "li")
        if item is None or item.nearest(_is_list) is None:
            item = link.nearest(lambda n: _is_entry(n) or _is_row(n))
        if item is None:
            continue
        if not _in(link, "h2", "h3", "h4") and next((n for n in _links(item) if not _in(n, *FRAME)), None) is not link:
            continue
        timed, time = item.first(lambda n: n.tag == "time" and "datetime" in n.attrs), item.first(lambda n: n.tag == "time")
        text = item.text()
        dates = [timed.get("datetime") if timed else "", time.text() if time else "", text]
        out.append({"at": len(out), "href": link.get("href"), "title": squeeze(link.text()), "text": squeeze(text), "dates": dates})
    return out


def date_evidence(root: Node) -> dict:
    """What may say when a page was published: its visible text, metadata, and times with the words around them."""
    metas = [n for n in root.down() if n.tag == "meta"]
    meta = lambda key, name: next((n.get("content") for n in metas if n.get(key) == name), None)
    shown = root.first(lambda n: n.named("main", "article") or n.get("role") == "main") or body(root)
    times = []
    for time in root.down():
        if time.tag != "time" or "datetime" not in time.attrs:
            continue
        around, before = time.parent, ""
        for part in around.parts if around else ():
            if part is time:
                break
            before = part.text() if isinstance(part, Node) else before
        named = [time.get(a) for a in ("class", "id", "aria-label", "title")] + [around.get(a) for a in ("class", "id")]
        own = "".join(p for p in around.parts if isinstance(p, str))
        times.append({"value": time.get("datetime"), "property": time.get("itemprop").lower(), "context": " ".join([*filter(None, named), before, own, time.text()])})
    return {
        "shown": squeeze(shown.text()),
        "metas": [meta("property", "article:published_time"), meta("name", "dcterms.issued"), meta("itemprop", "datePublished")],
        "times": times,
        "others": [meta("name", "dcterms.date"), meta("name", "date")],
    }


def fields(root: Node) -> dict:
    """The titles that a page gives itself, what may date it, and its text."""
    og = root.first(lambda n: n.tag == "meta" and n.get("property") == "og:title")
    named = {tag: root.first(lambda n, tag=tag: n.tag == tag) for tag in ("h1", "title")}
    out = {"og": og.get("content") if og else "", "h1": named["h1"].text() if named["h1"] else "", "title": named["title"].text() if named["title"] else ""}
    return out | {"evidence": date_evidence(root), "text": semantic_text(root)}


def file_references(root: Node) -> list[dict]:
    """References of a page's content to files, each with its words, its section's heading and the page's."""
    held = content(root)
    inside = lambda n: not _in(n, *DROPPED)
    top = held.first(lambda n: n.tag == "h1" and inside(n))
    out = []
    for tag, attribute in (("a", "href"), ("iframe", "src"), ("embed", "src"), ("object", "data")):
        for node in held.down():
            value = node.get(attribute).strip()
            if node.tag != tag or not value or not inside(node):
                continue
            section = node.nearest(lambda n: n.tag in ("section", "article", "div"))
            heading = section.first(lambda n: n.tag in ("h1", "h2", "h3", "h4") and inside(n)) if section else None
            out.append(
                {"at": len(out), "tag": tag, "value": value, "words": squeeze(node.text()), "type": node.get("type"), "download": tag == "a" and "download" in node.attrs,
                 "headings": f"{heading.text().strip() if heading else ''} {top.text().strip() if top else ''}"}
            )
    return out
