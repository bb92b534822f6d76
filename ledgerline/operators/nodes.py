"""Parsing filing HTML into element rows: one document at a time, in Arrow batches. What the rows mean is said in DataFrames.

The tree follows a lenient parser: void elements close at once; an end tag closes everything up to the nearest open element
of its name and is ignored if there is none; nothing closes by implication; the last of repeated attributes counts, and
one without a value is empty. Text leaves out comments and the contents of script, style and template.

Parsing takes time in proportion to the html, however deeply it nests: a document's text is kept once, with white space collapsed,
and an element is a span of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML's void elements, and elements whose content is no text of the document.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset(("script", "style", "template"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

# Links and place of a table of contents; characters of an element's text, of a label, and of what is read around a
# link's target; elements, characters and children of item lines.
TOC_TABLE_LINKS, TOC_TABLE_PLACE = 3, 0.42
TEXT_CHARS, LABEL_CHARS, ROW_CHARS, ELEMENT_CHARS = 900, 220, 1200, 800
ITEM_TAGS, ITEM_CHARS, ITEM_CHILDREN = frozenset(("p", "td", "div", "font", "span")), (8, 350), 8

# An element's table, row and cell.
_NOTHING = (None, None, None)
_SURROUNDING = frozenset(("table", "tr", "td", "th"))


class Element:
    """An element: its place in the html, the nearest table, row and cell around it, and the spans of its text."""

    __slots__ = ("tag", "attrs", "start", "inside", "around", "children", "element_children", "links", "shown", "spaced")

    def __init__(self, tag: str, attrs: dict[str, str], start: int, parent: Element | None, links: int, shown: int, spaced: int):
        self.tag, self.attrs, self.start = tag, attrs, start
        self.children = self.element_children = 0
        if parent is None:
            self.inside, self.around = False, _NOTHING
        else:
            self.inside, self.around = parent.inside, parent.around
            if parent.tag in _SURROUNDING:
                table, row, cell = parent.around
                self.around = (parent, row, cell) if parent.tag == "table" else (table, parent, cell) if parent.tag == "tr" else (table, row, parent)
        self.links, self.shown, self.spaced = -links, (shown, shown), (spaced, spaced)

    table, row, cell = (property(lambda self, k=k: self.around[k]) for k in range(3))

    def own_id(self) -> str:
        """The id; of a link without one, its name."""
        own = self.attrs.get("id", "") if self.attrs else ""
        return own or (self.attrs.get("name", "").strip() if self.tag == "a" else "")

    def fragment(self) -> str:
        """What an in-document link points to; empty for other elements."""
        href = self.attrs.get("href", "") if self.tag == "a" else ""
        return unquote(href.strip()[1:]) if href.startswith("#") else ""


# Markup as nearly all filings write it: tags whose attributes are quoted or bare, comments, a document type. What is written in another way is left
# to the lenient parser. White space of tags is ASCII.
_W = r"[\t\n\r\f ]"
_ATTRIBUTES = rf"""(?>{_W}+[a-zA-Z_:][a-zA-Z0-9_:.-]*(?>{_W}*={_W}*(?>"[^"]*"|'[^']*'|[^\t\n\r\f "'=<>`/]+(?=[\t\n\r\f >])))?)*"""
_MARKUP = re.compile(rf"""<(?:(?P<start>[a-zA-Z][a-zA-Z0-9:_-]*)(?P<attributes>{_ATTRIBUTES}){_W}*(?P<closed>/?)>|/(?P<end>[a-zA-Z][a-zA-Z0-9:_-]*){_W}*>|!--(?P<comment>(?!-?>)[^-]*(?>-(?!-)[^-]*)*)-->|![dD][oO][cC][tT][yY][pP][eE]{_W}[^<>"'\[\]]*>)""")
_ATTRIBUTE = re.compile(rf"""([a-zA-Z_:][a-zA-Z0-9_:.-]*)(?:{_W}*={_W}*(?:"([^"]*)"|'([^']*)'|([^\t\n\r\f "'=<>`/]+)))?""")
#: Elements whose content is read in another way: as it is written, up to their end tag, or (in some versions of the lenient parser) without tags.
_CLOSING = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in ("script", "style")}
AS_WRITTEN, TAGLESS = frozenset(_CLOSING), frozenset(("title", "textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"))


class Irregular(Exception):
    """Markup that only the lenient parser reads."""


class Tree(HTMLParser):
    """The elements of a document in order, and its text in two forms: as it is read, and piece by piece with spaces between.

    Regular markup is read by one pattern, in half the time; a document with anything else is read by the lenient parser, with the same result.
    """

    def __init__(self, html: str, regular: bool = True):
        super().__init__(convert_charrefs=True)
        try:
            if not regular:
                raise Irregular
            self._begin()
            self._read_regular(html)
        except Irregular:
            self._begin()
            self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
            self.feed(html)
            self.close()
        self._end_text()
        while self.open:
            self._close_last()
        self.shown, self.spaced = ("".join(p) for p in self.parts)

    def _begin(self) -> None:
        self.elements: list[Element] = []
        self.open: list[Element] = []
        self.names: Counter[str] = Counter()
        self.node: list[str] | None = None
        self.links, self.has_body, self.unshown = 0, False, 0
        self.parts: tuple[list[str], list[str]] = [], []
        self.sizes, self.after_space = [0, 0], True

    def _read_regular(self, html: str) -> None:
        """What the methods below do for each piece of markup, in one loop over regular html."""
        at, size, markup, find = 0, len(html), _MARKUP.match, html.find
        elements, opened, names, links, unshown = self.elements, self.open, self.names, 0, 0
        within = ""  # the element whose content has no tags
        while at < size:
            opening = find("<", at)
            if opening != at:
                text = html[at : opening if opening >= 0 else size]
                if opened:
                    opened[-1].children += 1
                if not unshown:
                    self._add_text(unescape(text) if "&" in text else text)
                if opening < 0:
                    break
            found = markup(html, opening)
            if found is None:
                raise Irregular
            start, attributes, closed, end, _ = found.groups()
            at = found.end()
            if within:
                if end is None or end.lower() != within:
                    raise Irregular
                within = ""
            if start is not None:
                tag, parent = start.lower(), None
                if opened:
                    parent = opened[-1]
                    parent.children += 1
                    parent.element_children += 1
                e = Element(tag, self._attributes(attributes) if attributes else {}, opening, parent, links, *self.sizes)
                elements.append(e)
                if tag == "a" and e.attrs.get("href", "").startswith("#"):
                    links += 1
                if tag in VOID:
                    e.links += links
                    continue
                opened.append(e)
                names[tag] += 1
                if tag in UNSHOWN:
                    unshown += 1
                elif tag == "body" and not self.has_body:
                    self.has_body = e.inside = True
                if closed:
                    end = tag
                elif tag in AS_WRITTEN:
                    closing = _CLOSING[tag].search(html, at)
                    after = closing.start() if closing else size
                    end_tag = markup(html, after)
                    if end_tag is None or (end_tag["end"] or "").lower() != tag:
                        raise Irregular
                    if after > at:
                        e.children += 1
                    at, end = end_tag.end(), tag
                elif tag in TAGLESS:
                    within = tag
            elif end is None and opened:
                opened[-1].children += 1
            if end is not None:
                tag = end.lower()
                if names[tag]:
                    shown, spaced = self.sizes
                    last = ""
                    while last != tag:
                        e = opened.pop()
                        last = e.tag
                        names[last] -= 1
                        if last in UNSHOWN:
                            unshown -= 1
                        e.links += links
                        e.shown, e.spaced = (e.shown[0], shown), (e.spaced[0], spaced)
        self.links, self.unshown = links, unshown

    @staticmethod
    def _attributes(written: str) -> dict[str, str]:
        found = {}
        for name, double, single, bare in _ATTRIBUTE.findall(written):
            value = double or single or bare
            if "&" in value:
                raise Irregular
            found[name.lower()] = value
        return found

    def _end_text(self) -> None:
        """Ends a run of text: adds it to both forms of the text."""
        node, self.node = self.node, None
        if node and not self.unshown:
            self._add_text("".join(node))

    def _add_text(self, run: str) -> None:
        if words := " ".join(run.split()):
            self.parts[1].append(" " + words)
            self.sizes[1] += len(words) + 1
            text = f"{'' if self.after_space or not run[0].isspace() else ' '}{words}{' ' if run[-1].isspace() else ''}"
        else:
            text = " " if run and not self.after_space else ""
        if text:
            self.parts[0].append(text)
            self.sizes[0] += len(text)
            self.after_space = text[-1] == " "

    def _child(self, element: bool = False) -> None:
        self._end_text()
        if self.open:
            self.open[-1].children += 1
            self.open[-1].element_children += element

    def _close_last(self) -> None:
        e = self.open.pop()
        self.names[e.tag] -= 1
        self.unshown -= e.tag in UNSHOWN
        e.links += self.links
        e.shown, e.spaced = (e.shown[0], self.sizes[0]), (e.spaced[0], self.sizes[1])

    def handle_starttag(self, tag, attrs):
        line, column = self.getpos()
        self._start(tag, {k: v or "" for k, v in attrs}, self.lines[line - 1] + column)

    def _start(self, tag: str, attributes: dict[str, str], place: int) -> None:
        self._child(True)
        e = Element(tag, attributes, place, self.open[-1] if self.open else None, self.links, *self.sizes)
        self.elements.append(e)
        self.links += tag == "a" and e.attrs.get("href", "").startswith("#")
        if tag in VOID:
            e.links += self.links
            return
        self.open.append(e)
        self.names[tag] += 1
        self.unshown += tag in UNSHOWN
        if tag == "body" and not self.has_body:
            self.has_body = e.inside = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        if self.names[tag]:
            while self.open[-1].tag != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        if self.node is None:
            self._child()
            self.node = []
        self.node.append(data)

    def handle_comment(self, data):
        self._child()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def body(self) -> list[Element]:
        """The elements inside the first body, in document order; empty without one."""
        inside = [e for e in self.elements if e.inside]
        return inside[1:]

    def text(self, e: Element, most: int) -> str:
        """The first `most` characters of an element's text."""
        first, after = e.shown
        return self.shown[first : min(after, first + most + 2)].strip(" ")[:most]

    def short_text(self, e: Element, most: int) -> str | None:
        """An element's text, or None if it has more than `most` characters."""
        first, after = e.shown
        if after - first > most + 2:
            return None
        text = self.shown[first:after].strip(" ")
        return text if len(text) <= most else None

    def spaced_text(self, e: Element, most: int) -> str:
        """The first `most` characters of an element's pieces of text, joined by spaces."""
        first, after = e.spaced
        return self.spaced[first : min(after, first + most + 1)].strip(" ")[:most]


def in_toc(e: Element, size: int) -> bool:
    """Whether the nearest table around an element looks like a table of contents: several in-document links, early in the html."""
    table = e if e.tag == "table" else e.around[0]
    return table is not None and table.links >= TOC_TABLE_LINKS and table.start <= TOC_TABLE_PLACE * size


def element_rows(html: str) -> Iterator[tuple]:
    """Rows of NODES (after the document's key) for every element of the body."""
    tree = Tree(html)
    size = max(1, len(html))
    for k, e in enumerate(tree.body()):
        own, name, href = map(e.attrs.get, ("id", "name", "href")) if e.attrs else _NOTHING
        yield k, e.tag, own, name, href, e.start, e.start / size, e.children, e.element_children, tree.short_text(e, TEXT_CHARS), in_toc(e, size)


def target_index(nodes: list[Element]) -> dict[tuple[str, str], Element]:
    """The first element of each id, of each link name, and of each id in lower case."""
    index: dict[tuple[str, str], Element] = {}
    for e in nodes:
        if not e.attrs:
            continue
        if own := e.own_id():
            index.setdefault(("id", own), e)
            index.setdefault(("folded", own.lower()), e)
        if e.tag == "a" and "name" in e.attrs:
            index.setdefault(("name", e.attrs["name"].strip()), e)
    return index


def anchor_element_rows(html: str) -> Iterator[tuple]:
    """Rows of ANCHOR_ELEMENTS for the elements that can give anchors: in-document links, headings, and short lines that begin with `item`.

    A link whose text begins so carries the text around its target and the target's own.
    """
    tree = Tree(html)
    nodes = tree.body()
    index = None
    for k, e in enumerate(nodes):
        if e.tag == "a" and (fragment := e.fragment()):
            label, around, own = tree.text(e, LABEL_CHARS) or fragment, None, None
            if label.lstrip()[:4].lower() == "item":
                index = target_index(nodes) if index is None else index
                target = index.get(("id", fragment)) or index.get(("name", fragment)) or index.get(("folded", fragment.lower()))
                if target is not None:
                    around, own = tree.spaced_text(target.row or target.cell or target, ROW_CHARS), tree.spaced_text(target, ELEMENT_CHARS)
            yield k, e.tag, fragment, label, around, own
        elif e.tag in HEADINGS:
            yield k, e.tag, e.own_id(), tree.text(e, LABEL_CHARS), None, None
        elif e.tag in ITEM_TAGS and e.children <= ITEM_CHILDREN:
            text = tree.short_text(e, ITEM_CHARS[1])
            if text is not None and len(text) >= ITEM_CHARS[0] and text[:4].lower() == "item":
                yield k, e.tag, e.own_id(), text, None, None


_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
#: Rows that a task gathers before it hands them to Spark.
OUTPUT_ROWS = 10_000
NODES = "seq int, tag string, id string, name string, href string, start int, place double, children int, element_children int, text string, in_toc boolean"
ANCHOR_ELEMENTS = "seq int, tag string, own_id string, text string, around string, target string"


def _per_document(pages: DataFrame, id_col: str, html_col: str, parse, fields: str) -> DataFrame:
    """Rows that parse gives for each html. Batches are bounded by bytes (spark.sql.execution.arrow.maxBytesPerBatch)."""
    read = pages.select(F.col(id_col).alias("doc"), F.col(html_col).alias("html")).where("html IS NOT NULL")
    schema = T.StructType([read.schema["doc"], *T._parse_datatype_string(fields).fields])
    names, kinds = schema.names, [_ARROW[f.dataType.simpleString()] for f in schema.fields[1:]]

    def batch_of(key: pa.DataType, docs: list, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs, key), *map(pa.array, zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, rows, key = [], [], None
        for batch in batches:
            key = batch.schema.field("doc").type
            for doc, html in zip(batch.column("doc").to_pylist(), batch.column("html")):
                for row in parse(html.as_py()):
                    docs.append(doc)
                    rows.append(row)
                    if len(rows) >= OUTPUT_ROWS:
                        yield batch_of(key, docs, rows)
                        docs, rows = [], []
        if rows:
            yield batch_of(key, docs, rows)

    return read.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def html_nodes(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """One row an element of every document's body: (id, *NODES). Text is null where it is longer than 900 characters.

    Operators that read nodes several times would parse as often: stage them first (sources.staging.staged).
    """
    return _per_document(pages, id_col, html_col, element_rows, NODES)


def anchor_elements(pages: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """The elements that can give anchors: (id, *ANCHOR_ELEMENTS); no body, no rows."""
    return _per_document(pages, id_col, html_col, anchor_element_rows, ANCHOR_ELEMENTS)
