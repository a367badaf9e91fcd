"""Visible text of web pages, laid out.

``parse`` reads tags, comments and text with one pattern and builds a tree: end tags that pages leave out are implied, stray ones
ignored. ``render`` walks the tree without recursion and writes what a reader sees: blocks on lines of their own with empty lines around
paragraphs and headings, list items with their marks, preformatted text as it is, and tables as aligned columns. Hidden elements (by kind, ``hidden``
attribute or inline style) are left out with all that they hold. Of invisible ones (``visibility``) the children that are set visible again are kept.
Formulas, the ``text`` of drawings and what an object holds for lack of its data are inline text.

Buttons show their value, images and image buttons their alternative text; what stands in fields is left out.

Null and empty pages give empty text. Markup of any nesting and length is read whole; tables within cells are laid out as lines. A column is padded to its
widest line of up to ``WIDE`` columns; wider lines stand out, so a page's text is at most some ``WIDE`` times its cells. Spans are as browsers
read them: ``colspan`` from 1 to 1000, ``rowspan`` from 0 (to the end of the table) to 65534, 1 where there is no number; places that a span takes hold no text.
Numbers of list items are whole numbers of up to 18 digits; others count as not given.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.files import ship
from limnos.llm.words import whole

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes audio video canvas datalist area base link meta".split())
# Drawings and formulas, in which "/>" ends an element; elements of theirs that hold markup of pages, and those that are not shown.
FOREIGN = frozenset("svg math".split())
EMBEDS = frozenset("foreignobject desc title mtext".split())
UNDRAWN = frozenset("title desc defs annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset details".split())
BLOCK = SPACED | frozenset(
    "address article aside body caption center dd dialog dir div dt figcaption footer form header hgroup html legend li main menu "
    "nav optgroup option section summary tbody td tfoot th thead tr".split()
)
# Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section summary table ul xmp li dt dd".split()
)
# Start tag: the open elements that it ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
# Kinds of inputs that are buttons, and where their text is.
BUTTONS = {"submit": "value", "reset": "value", "button": "value", "image": "alt"}
# Columns to which cells are padded at most.
WIDE = 80
# Elements that an end tag further out does not close.
FENCES = frozenset("table td th caption".split())
# What may stand in a head; anything else opens the body.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
    r"|<[!?/][^>]*>?",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.DOTALL)
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse|initial|inherit|unset)(?![\w-])", re.I)
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"']*/$")
_BLANKS = re.compile("[ \t\n\r\f]+")


class Node:
    """An element; children are elements and texts."""

    __slots__ = ("name", "attributes", "children", "foreign")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, foreign: bool = False):
        self.name, self.attributes, self.children, self.foreign = name, attributes or {}, [], foreign


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for match in _ATTRIBUTE.finditer(rest):
        value = match[2] if match[2] is not None else match[3] if match[3] is not None else match[4] or ""
        found.setdefault(match[1].lower(), entities.unescape(value))
    return found


class Builder:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.count = {"html": 1}

    def text(self, text: str) -> None:
        if text:
            if "head" in self.count and not text.isspace():
                self._end_through("head")
            self.open[-1].children.append(text)

    def _pop(self) -> Node:
        node = self.open.pop()
        self.count[node.name] -= 1
        if not self.count[node.name]:
            del self.count[node.name]
        return node

    def _end_through(self, name: str) -> None:
        while len(self.open) > 1 and self._pop().name != name:
            pass

    def _imply(self, ended: set[str], fences: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``ended`` that no fence shields, with all that is in it."""
        if not any(name in self.count for name in ended):
            return
        cut = None
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth].name
            if name in ended:
                cut = depth
            elif name in fences:
                break
        if cut is not None:
            while len(self.open) > cut:
                self._pop()

    def start(self, name: str, rest: str) -> None:
        if name in ("html", "body") and (name == "html" or "body" in self.count):
            return
        if "head" in self.count and name not in HEAD:
            self._end_through("head")
        if name in ENDS_P and "p" in self.count:
            self._imply({"p"}, FENCES | {"button", "object"})
        if name in IMPLIED:
            self._imply(*IMPLIED[name])
        if name == "a" and "a" in self.count:
            self._imply({"a"}, FENCES)
        if name in ("td", "th") and "table" in self.count and "tr" not in self.count:
            self._push("tr", "")
        self._push(name, rest)
        if name in VOID or (self.open[-1].foreign and rest.endswith("/") and not _UNQUOTED_SLASH.search(rest)):
            self._pop()

    def _push(self, name: str, rest: str) -> None:
        around = self.open[-1]
        foreign = name in FOREIGN or (around.foreign and around.name not in EMBEDS)
        node = Node(name, _attributes(rest) if rest and not rest.isspace() else None, foreign)
        around.children.append(node)
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name not in self.count:
            if name == "p":  # reads as an empty paragraph
                self._push("p", "")
                self._pop()
            elif name == "br":
                self._push("br", "")
                self._pop()
            return
        shields = FENCES if name not in FENCES and name not in ("tr", "tbody", "thead", "tfoot") else {"table"} - {name}
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == name:
                while len(self.open) > depth:
                    self._pop()
                return
            if self.open[depth].name in shields:
                return


def parse(page: str) -> Node:
    build, at, end = Builder(), 0, len(page)
    for match in iter(lambda: _TAG.search(page, at), None):
        if match.start() > at:
            build.text(entities.unescape(page[at : match.start()]))
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            build.end(name)
            continue
        build.start(name, match["rest"])
        if name in RAW and build.open[-1].name == name:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop, after = (close.start(), close.end()) if close else (end, end)
            raw = page[at:stop]
            build.text(entities.unescape(raw) if name in ("textarea", "title") else raw)
            build.end(name)
            at = after
    if at < end:
        build.text(entities.unescape(page[at:]))
    return build.root


def visibility(node: Node) -> str | None:
    """``visible``, ``hidden`` or ``collapse`` as the element says itself; None if it takes that of its parent."""
    found = _VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else None
    value = found[-1].lower() if found else node.attributes.get("visibility", "").lower() if node.foreign else ""
    return "visible" if value == "initial" else value if value in ("visible", "hidden", "collapse") else None


def hidden(node: Node) -> bool:
    """Is the element left out with all that it holds?"""
    has = node.attributes
    return (
        node.name in HIDDEN
        or "hidden" in has
        or (node.name == "input" and has.get("type", "").strip().lower() not in BUTTONS)
        or bool(has.get("style") and _GONE.search(has["style"]))
        or (node.name == "dialog" and "open" not in has)
        or (node.foreign and (node.name in UNDRAWN or has.get("display", "").lower() == "none"))
        or (node.name in ("tr", "tbody", "thead", "tfoot") and visibility(node) == "collapse")
    )


def showing(root: Node) -> set[int]:
    """``id`` of the elements that hold one that is set visible, or are set so themselves."""
    order: list[tuple[Node, int]] = [(root, -1)]
    for at, (node, _) in enumerate(order):
        order.extend((child, at) for child in node.children if isinstance(child, Node) and not hidden(child))
    marked = bytearray(len(order))
    for at in range(len(order) - 1, -1, -1):
        node, parent = order[at]
        if marked[at] or visibility(node) == "visible":
            marked[at] = 1
            if parent >= 0:
                marked[parent] = 1
    return {id(node) for at, (node, _) in enumerate(order) if marked[at]}


class Flow:
    """Lines of text under way: blanks run together, blocks start lines, and paragraphs are parted by one empty line."""

    __slots__ = ("lines", "line", "gap", "blank", "prefix")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # an empty line is due before the next text
        self.blank = False  # a blank is due before the next word of this line
        self.prefix: list[str] = []  # mark of an item, due before its first text

    def words(self, text: str) -> None:
        bare = _BLANKS.sub(" ", text)
        if bare.startswith(" "):
            self.blank, bare = True, bare[1:]
        if not bare:
            return
        self._begin()
        if self.blank and self.line and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.blank = bare.endswith(" ")
        self.line.append(bare.rstrip(" "))

    def _begin(self) -> None:
        if self.gap and not self.line:
            if self.lines:
                self.lines.append("")
            self.gap = False
        if self.prefix and not self.line:
            self.line.extend(self.prefix)
            self.prefix = []

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self._begin()
        self.line.append(first)
        for line in rest:
            self.stop()
            self._begin()
            self.line.append(line)

    def newline(self) -> None:
        self._begin()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def stop(self, gap: bool = False) -> None:
        """End the line, if one is under way; with ``gap`` an empty line is due."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False
        self.gap = self.gap or gap

    def text(self) -> str:
        self.stop()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def width(text: str) -> int:
    """Columns of a text: wide characters take two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def aligned(rows: list[list[str]]) -> list[str]:
    """Rows of cells as lines with aligned columns. A cell of several lines takes as many lines of its row; lines without text are left out, and
    so are a row's last cells if all their lines are empty."""
    split = [[cell.split("\n") for cell in row] for row in rows]
    widths: list[int] = []
    for row in split:
        while row and row[-1] == [""]:
            row.pop()
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], *(w if w <= WIDE else 0 for w in map(width, cell)))
    lines = []
    for row in split:
        for k in range(max((len(cell) for cell in row), default=0)):
            parts = [cell[k] if k < len(cell) else "" for cell in row]
            if any(part.strip() for part in parts):
                lines.append(" | ".join(part + " " * (widths[i] - width(part)) for i, part in enumerate(parts)).rstrip(" "))
    return lines


class Table:
    """Cells of a table as they are rendered."""

    __slots__ = ("rows", "spans")

    def __init__(self):
        self.rows: list[list[str]] = []
        self.spans: dict[int, int] = {}  # rows that a cell above still takes, by column

    def row(self) -> None:
        self.rows.append([])
        self._fill()

    def _fill(self) -> None:
        row = self.rows[-1]
        while self.spans.get(len(row)):
            self.spans[len(row)] -= 1
            row.append("")

    def cell(self, text: str, across: int, down: int) -> None:
        """``down`` 0 is to the end of the table."""
        if not self.rows:
            self.row()
        row = self.rows[-1]
        for k in range(across):
            if down != 1:
                self.spans[len(row)] = down - 1 if down else 1 << 62
            row.append(text if k == 0 else "")
        self._fill()


_WHOLE = re.compile(r"\s*([+-]?[0-9]{1,18})(?![0-9])")


def _number(node: Node, name: str, default: int) -> int:
    """The whole number that an attribute begins with, as browsers read it."""
    found = _WHOLE.match(node.attributes.get(name, ""))
    return int(found[1]) if found else default


def _span(node: Node, name: str, low: int, high: int) -> int:
    value = node.attributes.get(name, "").strip()
    if value.isdecimal() and value.isascii() and len(value) > 18:
        return high
    number = _number(node, name, 1)
    return 1 if number < low else min(number, high)


ENTER, LEAVE = 0, 1
# Where text stands: in the page or a formula, in a drawing (not shown), in the text of a drawing.
PAGE, DRAWING, LETTERING = 0, 1, 2


def render(root: Node) -> str:
    """Visible text of a tree, laid out."""
    flow = Flow()
    flows = [flow]
    tables: list[Table] = []
    lists: list[list] = []  # kind and next number of the open lists
    pre = 0
    shows: set[int] | None = None
    todo: list[tuple[int, object, int, bool]] = [(ENTER, root, PAGE, True)]
    while todo:
        what, node, place, visible = todo.pop()
        if isinstance(node, str):
            if not visible or place == DRAWING:
                continue
            if pre:
                flow.verbatim(node)
            elif not (node.isspace() and not flow.line):
                flow.words(node)
            continue
        name = node.name
        if what == ENTER:
            if hidden(node):
                continue
            own = visibility(node)
            visible = visible if own is None else own == "visible"
            if not visible:
                shows = showing(root) if shows is None else shows
                if id(node) not in shows:
                    continue
            if name == "svg":
                place = DRAWING
            elif place and name == "foreignobject":
                place = PAGE
            elif place == DRAWING and name == "text":
                place = LETTERING
                flow.blank = True
            if name == "br":
                flow.newline()
                continue
            if name == "img":
                if node.attributes.get("alt", "").strip():
                    flow.words(node.attributes["alt"])
                continue
            if name == "input":
                label = node.attributes.get(BUTTONS[node.attributes["type"].strip().lower()], "")
                if visible and label.strip():
                    flow.words(f" {label} ")
                continue
            if name == "hr":
                flow.stop(gap=True)
                continue
            if name == "wbr":
                continue
            todo.append((LEAVE, node, place, visible))
            shown = node.children
            if name == "details" and "open" not in node.attributes:
                shown = [c for c in shown if isinstance(c, Node) and c.name == "summary"][:1]
            todo.extend((ENTER, child, place, visible) for child in reversed(shown))
            if name in BLOCK:
                flow.stop(gap=name in SPACED and not (name in ("ul", "ol") and lists))
            if name in ("ul", "ol", "menu", "dir"):
                lists.append([name, _number(node, "start", 1) if name == "ol" else 0])
            elif name == "li":
                depth = "  " * (len(lists) - 1) if lists else ""
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = _number(node, "value", lists[-1][1])
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    mark = "- "
                flow.prefix = [depth, mark] if visible else []
            elif name == "dd":
                flow.prefix = ["  "]
            elif name == "pre":
                pre += 1
                if shown and isinstance(shown[0], str) and shown[0].startswith("\n"):
                    todo[-1] = (ENTER, shown[0][1:], place, visible)
            elif name == "q" and visible:
                flow.words('"')
            elif name == "table":
                tables.append(Table())
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in ("td", "th") and tables:
                flow = Flow()
                flows.append(flow)
            continue
        if name in ("td", "th") and tables:
            text = flows.pop().text()
            flow = flows[-1]
            tables[-1].cell(text, _span(node, "colspan", 1, 1000), _span(node, "rowspan", 0, 65_534))
        elif name == "table" and tables:
            flow.stop(gap=True)
            for line in aligned(tables.pop().rows):
                flow.verbatim(line)
                flow.stop()
            flow.stop(gap=True)
        elif name in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
            flow.prefix = []
            flow.stop(gap=not lists and name in SPACED)
        elif name == "q" and visible:
            flow.line.append('"')
        elif name == "text" and place == LETTERING:
            flow.blank = True
        else:
            if name == "pre":
                pre -= 1
            if name in ("li", "dd"):
                flow.prefix = []
            if name in BLOCK:
                flow.stop(gap=name in SPACED)
    return flow.text()


def text_of(page: str) -> str:
    return render(parse(page)) if page else ""


def rendered(pages: DataFrame, html: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", whole(html).alias("html")).mapInArrow(rows, f"page_id {kind}, url string, text string")
