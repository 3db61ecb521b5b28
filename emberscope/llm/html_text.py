"""Visible text of HTML pages as a browser without scripts would lay it out.

A tree builder reads tags and text, closes elements that HTML closes by implication
(paragraphs before blocks, list items, table rows and cells, options) and ignores end tags
without a start.  A renderer walks the tree: blocks start on lines of their own, paragraphs
and headings are set off by an empty line, list items get a bullet or a number and the
indentation of their depth, table cells are padded so that columns line up (several lines in
a cell and column spans included), preformatted text keeps its white space, other white
space collapses.

Hidden, with all they contain: head, title, script, style, template, iframe, noembed,
noframes, datalist, audio, video and canvas (their content is for browsers without them), the
attribute ``hidden``, ``display: none`` in the style attribute, closed ``details`` but for
their summary, closed ``dialog``, hidden and value-less controls.  ``visibility: hidden``
hides text until an element inside says ``visible``.  Shown as a browser shows them: the
content of ``textarea`` with its white space, the selected (else the first) option of a
``select`` and all options of a list box, the ``text`` elements of ``svg``, the fallback of
``object``, and ``noscript``.

Defined results: null and empty pages give empty text; rows are read one by one, so repeated
rows and null ids are like others; broken markup never fails; an empty table gives an empty
result.  Both steps use explicit stacks and know the open elements by name, so time and
memory follow the size of the page, however deep it nests: beyond ``MOST_INDENT`` levels the
indentation grows no further, and tables beyond ``MOST_TABLES`` levels are written row by row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberscope.llm.kernels import slices

#: Fixed values of HTML: element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes audio video canvas datalist".split())
SVG_TEXT = frozenset("text foreignobject".split())
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure fieldset hr article section".split())
BLOCK = SPACED | frozenset(
    "html body div header footer nav aside main address li dt dd tr td th thead tbody tfoot caption figcaption form details summary center legend dialog option optgroup".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option optgroup legend summary".split()) | {"summary"}
#: A start tag of the key ends the open elements named first, up to one of those named second.
IMPLIED_END = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th caption colgroup", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
    "caption": ("caption", "table"),
}
_IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED_END.items()}
_SCOPE = frozenset("table td th caption html template".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[ \t\n\r\f\v​]+")
_NOT_DISPLAYED = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")

MOST_INDENT = 40
MOST_TABLES = 8


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


class Builder:
    """Tags and text of one page to a tree."""

    def __init__(self, page: str):
        self.page = page
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # of open elements by name, in the stack
        self.none_left: set[str] = set()  # delimiters known not to come again
        self._read()

    def _find(self, what: str, at: int) -> int:
        if what in self.none_left:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_left.add(what)
        return found

    def _read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            tag = self._find("<", at)
            if tag < 0:
                self.text(page[at:])
                return
            after = page[tag + 1 : tag + 2]
            if after not in ("!", "?", "/") and not (after.isascii() and after.isalpha()):
                self.text(page[at : tag + 1])
                at = tag + 1
                continue
            if tag > at:
                self.text(page[at:tag])
            if after in ("!", "?"):
                if page.startswith("<!--", tag):
                    end = self._find("-->", tag + 4)
                    at = end + 3 if end >= 0 else n
                else:
                    end = self._find(">", tag)
                    at = end + 1 if end >= 0 else n
                continue
            closing = after == "/"
            name = _NAME.match(page, tag + 1 + closing)
            if not name:
                end = self._find(">", tag)
                at = end + 1 if end >= 0 else n
                continue
            attributes, at, self_closed = self._attributes(name.end())
            if closing:
                self.end(name[0].lower())
            else:
                at = self._start(name[0].lower(), attributes, self_closed, at)

    def _attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        page, found = self.page, {}
        while True:
            match = _ATTRIBUTE.match(page, at)
            if not match:
                break
            at = match.end()
            value = ""
            if match[2]:
                quote = page[at : at + 1]
                end = self._find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    plain = _UNQUOTED.match(page, at)
                    value, at = plain[0], plain.end()
            found.setdefault(match[1].lower(), value)
        end = self._find(">", at)
        if end < 0:
            return found, len(page), False
        return found, end + 1, page[end - 1] == "/"

    def _start(self, name: str, attributes: dict[str, str], self_closed: bool, at: int) -> int:
        if name == "html":
            return at
        self._imply(name)
        node = Node(name, attributes)
        self.stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(self.page, at) if name not in self.none_left else None
            if end is None:
                self.none_left.add(name)
                return len(self.page) if name in ("script", "style") else at
            if name not in HIDDEN:
                node.children.append(entities.unescape(self.page[at : end.start()]).removeprefix("\n"))
            close = self._find(">", end.end())
            return close + 1 if close >= 0 else len(self.page)
        if name not in VOID and not (self_closed and (name == "svg" or self.places.get("svg"))):
            self._open(node)
        return at

    def _open(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def _cut(self, at: int) -> None:
        """End the open elements from that place on."""
        for node in self.stack[at:]:
            self.places[node.name].pop()
        del self.stack[at:]

    def _last(self, names: frozenset[str]) -> int:
        """The place of the innermost open element of those names, 0 if there is none."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=0)

    def _imply(self, name: str) -> None:
        """End what this start tag ends."""
        if name in CLOSES_P:
            self._end_within("p", _SCOPE)
        if name[0] == "h" and name[1:].isdigit() and self.stack[-1].name[0] == "h" and self.stack[-1].name[1:].isdigit():
            self._cut(len(self.stack) - 1)
        if name in _IMPLIED:
            ends, limits = _IMPLIED[name]
            limit = self._last(limits)
            while (found := self._last(ends)) > limit:
                self._cut(found)
                if name not in ("tr", "thead", "tbody", "tfoot"):
                    break
        if name in ("td", "th") and self.stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            self.stack[-1].children.append(row)
            self._open(row)

    def _end_within(self, name: str, limits: frozenset[str]) -> bool:
        found = self._last(frozenset({name}))
        if found and found >= self._last(limits):
            self._cut(found)
            return True
        return False

    def end(self, name: str) -> None:
        if name == "br":
            self.stack[-1].children.append(Node("br", {}))
        elif name in ("html", "body"):
            return
        elif name in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
            self._end_within(name, frozenset() if name == "table" else frozenset({"table"}))
        elif not self._end_within(name, _SCOPE) and name == "p":
            self.stack[-1].children.append(Node("p", {}))

    def text(self, raw: str) -> None:
        self.stack[-1].children.append(entities.unescape(raw))


def _hidden(node: Node) -> bool:
    name, attributes = node.name, node.attributes
    if name in HIDDEN or "hidden" in attributes:
        return True
    if name == "dialog" and "open" not in attributes:
        return True
    return bool(_NOT_DISPLAYED.search(attributes.get("style", "").lower()))


def _shows(node: Node, around: bool) -> bool:
    """Whether text right inside the element is visible."""
    said = _VISIBILITY.search(node.attributes.get("style", "").lower())
    return said[1] == "visible" if said else around


def _options(select: Node) -> list[Node]:
    out, left = [], list(reversed(select.children))
    while left:
        node = left.pop()
        if isinstance(node, Node):
            if node.name == "option":
                out.append(node)
            else:
                left.extend(reversed(node.children))
    return out


def _is_list(select: Node) -> bool:
    size = re.match(r"\s*(\d{1,4})", select.attributes.get("size", ""))
    return "multiple" in select.attributes or bool(size and int(size[1]) > 1)


class Writer:
    """Lines of one flow of blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []  # pieces of the line being written
        self.depth = 0  # of indentation
        self.mark = ""  # bullet waiting for its line
        self.space = False
        self.gap = 0  # empty lines owed before the next text

    def text(self, raw: str, keep: bool) -> None:
        if keep:
            first, *rest = raw.split("\n")
            self._put(first)
            for line in rest:
                self.line(True)
                self._put(line)
            return
        words = _SPACE.split(raw)
        if words[0] == "" and len(words) > 1:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            self._put(f" {body}" if self.space and self.now else body)
            self.space = words[-1] == ""

    def _put(self, piece: str) -> None:
        if not piece:
            return
        if not self.now:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.now.append("  " * min(self.depth, MOST_INDENT) + self.mark)
            self.mark = ""
        self.now.append(piece)

    def line(self, always: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        elif always:
            self.lines.append("")
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced:
            self.gap = 1

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells of a table as lines, laid out once all are known."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns spanned, lines)
        self.busy: dict[int, int] = {}  # column to rows it is still taken by a cell above
        self.caption: list[str] = []

    def row(self) -> None:
        self.busy = {c: k - 1 for c, k in self.busy.items() if k > 1}
        self.rows.append([])

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        column = 0 if not self.rows[-1] else self.rows[-1][-1][0] + self.rows[-1][-1][1]
        while column in self.busy:
            column += 1
        self.rows[-1].append((column, across, lines))
        if down > 1:
            for c in range(column, column + across):
                self.busy[c] = down

    def lines(self, gap: str = "  ") -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for column, across, lines in row:
                if across == 1:
                    widths[column] = max(widths.get(column, 0), max(map(len, lines), default=0))
        for row in self.rows:  # what spans columns widens its last one
            for column, across, lines in row:
                have = sum(widths.get(c, 0) for c in range(column, column + across)) + len(gap) * (across - 1)
                need = max(map(len, lines), default=0)
                if across > 1 and need > have:
                    widths[column + across - 1] = widths.get(column + across - 1, 0) + need - have
        starts, at = {}, 0
        for c in range(max(widths, default=-1) + 1):
            starts[c] = at
            at += widths.get(c, 0) + (len(gap) if widths.get(c, 0) else 0)
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(starts.get(column, at)) + lines[i]
                out.append(line.rstrip())
        return out


_MOST_SPAN = 1000  # HTML's own limit


def _span(node: Node, name: str) -> int:
    digits = re.match(r"\s*(\d{1,4})", node.attributes.get(name, ""))
    return min(max(int(digits[1]), 1), _MOST_SPAN) if digits else 1


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    outer = Writer()
    writers, lists, pre, svg, svg_text = [outer], [], 0, 0, 0
    tables: list[Table | None] = []  # None: a table nested too deep to be aligned
    shown = [True]
    todo: list[tuple[bool, Node | str]] = [(True, Builder(page).root)]
    while todo:
        enters, node = todo.pop()
        if isinstance(node, str):
            if shown[-1] and (not svg or svg_text) and not (node.isspace() and not pre and not writers[-1].now):
                writers[-1].text(node, bool(pre))
            continue
        name, writer = node.name, writers[-1]
        aligned = bool(tables) and tables[-1] is not None
        if enters:
            if _hidden(node) or (svg and name in SVG_HIDDEN):
                continue
            todo.append((False, node))
            shown.append(_shows(node, shown[-1]))
            children = node.children
            if name == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
            elif name == "select" and not _is_list(node):
                own = _options(node)
                children = [o for o in own if "selected" in o.attributes][-1:] or own[:1]
                children = [" ", *(c for o in children for c in o.children), " "]
            todo.extend((True, c) for c in reversed(children))
            if name == "br":
                writer.line(True)
            elif name == "input":
                if shown[-1] and node.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text") and node.attributes.get("value"):
                    writer.text(f" {entities.unescape(node.attributes['value'])} ", False)
            elif name == "svg":
                svg += 1
            elif svg and name in SVG_TEXT:
                svg_text += 1
                writer.block(False)
            elif name == "table":
                writer.block(True)
                tables.append(Table() if len(tables) < MOST_TABLES else None)
            elif aligned and name == "tr":
                tables[-1].row()
            elif aligned and name in ("td", "th", "caption"):
                writers.append(Writer())
            elif tables and name in ("td", "th"):
                writer.text(" ", False)
            elif name in BLOCK:
                nested = name in ("ul", "ol") and lists
                writer.block(name in SPACED and not nested)
            if name in ("ul", "ol"):
                start = re.match(r"\s*(-?\d{1,9})", node.attributes.get("start", ""))
                lists.append([name, int(start[1]) if start else 1, writer.depth])
                if len(lists) > 1:
                    writer.depth += 1
            elif name == "li":
                if lists and lists[-1][0] == "ol":
                    writer.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    writer.mark = "- "
            elif name in ("blockquote", "dd"):
                writer.depth += 1
            elif name in ("pre", "textarea"):
                pre += 1
            elif name == "optgroup" and shown[-1]:
                writer.text(entities.unescape(node.attributes.get("label", "")), False)
            elif name == "q":
                writer.text('"', False)
        else:
            shown.pop()
            if name in ("pre", "textarea"):
                pre -= 1
            elif name == "svg":
                svg -= 1
            elif svg and name in SVG_TEXT:
                svg_text -= 1
                writer.block(False)
            elif name in ("ul", "ol"):
                writer.line()
                writer.depth = lists.pop()[2]
            elif name in ("blockquote", "dd"):
                writer.line()
                writer.depth -= 1
            elif name == "li":
                writer.line()
                writer.mark = ""
            elif name == "q":
                writer.text('"', False)
            if name == "table":
                table = tables.pop()
                writer.line()
                writer.block(True)
                for line in table.lines() if table else ():
                    writer._put(line)
                    writer.line()
                writer.block(True)
            elif aligned and name in ("td", "th"):
                lines = writers.pop().done()
                tables[-1].cell(lines, _span(node, "colspan"), _span(node, "rowspan"))
            elif aligned and name == "caption":
                tables[-1].caption = writers.pop().done()
            elif tables and name in ("td", "th"):
                writer.text(" ", False)
            elif name in BLOCK:
                nested = name in ("ul", "ol") and lists
                writer.block(name in SPACED and not nested)
    return "\n".join(outer.done())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            texts = [render(page) for page in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def visible_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of a table with columns page_id and html; no shuffle."""
    narrow = pages.select("page_id", F.col("html").cast("string").alias("html"))
    schema = T.StructType([T.StructField("page_id", narrow.schema[0].dataType), T.StructField("text", T.StringType())])
    return narrow.mapInArrow(_render, schema)
