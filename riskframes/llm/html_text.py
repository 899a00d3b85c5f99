"""Visible text of HTML pages, laid out.

A scanner and a tree builder with implied tags (a new paragraph ends the open one, list items, table rows and cells end
their like, text ends the head, what may not stand in a table goes before it, and so on) make a tree; a renderer walks it and emits all
visible text. Blocks stand on lines of their own, with a blank line around those that have a margin; list items have a bullet or number
and are indented by depth; cells of a table are padded to the columns' width. Elements that aren't displayed (by kind, ``hidden``, or
``display: none``) give nothing; under ``visibility: hidden`` only what is ``visible`` again does. White space collapses but for
preformatted text.

Columns are padded to ``WIDEST`` places at most, longer cells stick out; where even so a table would take more blanks than
``BLANKS`` and four times its text, columns get narrower, down to none. So the text is never longer than some multiple of the page.
Tables in tables are laid out to a depth of ``TABLE_DEPTH``; deeper ones are read as blocks, with all of their text.

Inputs: a null page gives a null text, an empty one an empty text; broken markup is read as far as it goes. Very long pages are read whole. Depth is no
limit: tree and renderer keep stacks of their own. An empty table of pages gives no rows. Repeated rows are read alike; extra columns
are ignored, those named in ``keep`` stay, where a clash with an output name is an error.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import frugal, slices

#: Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title meta link iframe object audio video canvas datalist noembed noframes param source track area base defs desc metadata input".split())
MARGIN = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu hr".split())
BLOCK = MARGIN | set("html body div section article header footer nav main aside address li dt dd tr form figcaption details summary caption legend center dir hgroup search option".split())
ENDS_PARAGRAPH = BLOCK - set("html body li dt dd tr caption legend option".split())
#: What a start tag ends, and the elements that such an end doesn't reach beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Where in an open table a start tag belongs; what is open below that ends.
SECTIONS = set("thead tbody tfoot".split())
BELONGS = {"tr": SECTIONS | {"table"}, "td": SECTIONS | {"table", "tr"}, "th": SECTIONS | {"table", "tr"}} | dict.fromkeys("caption colgroup thead tbody tfoot".split(), {"table"})
FRAME = SECTIONS | {"table", "tr", "colgroup"}  # elements of a table that hold no text themselves
IN_HEAD = set("base link meta title noscript noframes style script template head html".split())
SCOPE = set("table td th caption button object template html body".split())
_TAG = re.compile(r"<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str] | None = None) -> None:
        self.name, self.attributes, self.children = name, attributes or {}, []

    def displayed(self) -> bool:
        return self.name not in HIDDEN and (self._style("display") or ("none" if "hidden" in self.attributes else "")) != "none"

    def visible(self, above: bool) -> bool:
        """``above``: whether the element around it is."""
        own = self._style("visibility")
        return above if own in ("", "inherit") else own == "visible"

    def _style(self, name: str) -> str:
        """The last value of a property in the element's own style."""
        if "style" not in self.attributes:
            return ""
        return ([v.lower() for k, v in _STYLE.findall(self.attributes["style"]) if k.lower() == name] or [""])[-1]


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ('"', "'"):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def parse(page: str) -> Node:
    """The tree of a page. Text is kept as strings among the children."""
    root = Node("#root")
    open_: list[Node] = [root]
    counts: dict[str, int] = {}  # open elements of each name

    def push(node: Node) -> None:
        add(node)
        open_.append(node)
        counts[node.name] = counts.get(node.name, 0) + 1

    def pop_to(depth: int) -> None:
        while len(open_) > depth:
            counts[open_.pop().name] -= 1

    def end_like(names: set[str], bar: set[str]) -> None:
        """End the outermost open element of these names above the nearest of ``bar``."""
        if not any(counts.get(n) for n in names):
            return
        cut = 0
        for depth in range(len(open_) - 1, 0, -1):
            name = open_[depth].name
            if name in bar:
                break
            if name in names:
                cut = depth
        if cut:
            pop_to(cut)

    def add(child: Node | str) -> None:
        """Into the open element; before the table if that is a part of a table and takes no such child."""
        if open_[-1].name in FRAME and not (child.isspace() if isinstance(child, str) else child.name in BELONGS or child.name in HIDDEN):
            around = open_[_last(open_, "table") - 1].children  # the open table is its last child
            around.insert(len(around) - 1, child)
        else:
            open_[-1].children.append(child)

    def end_head() -> None:
        if counts.get("head") and not counts.get("noscript") and not counts.get("template"):
            end_like({"head"}, set())

    def add_text(text: str) -> None:
        if not text.isspace():
            end_head()
        add(html.unescape(text) if "&" in text else text)

    def in_cell() -> bool:
        """Whether the innermost table is open at a cell or caption."""
        return next((n.name not in FRAME for n in reversed(open_) if n.name in FRAME or n.name in ("td", "th", "caption")), False)

    at = 0
    while True:
        found = _TAG.search(page, at)
        if not found:
            if at < len(page):
                add_text(page[at:])
            return root
        if found.start() > at:
            add_text(page[at : found.start()])
        at = found.end()
        close, name, rest = found.groups()
        if not name:
            continue
        name = name.lower()
        if close:
            if name == "p" and not counts.get("p"):
                add(Node("p"))
            elif name == "br":
                add(Node("br"))
            elif counts.get(name):
                for depth in range(len(open_) - 1, 0, -1):
                    if open_[depth].name == name:
                        pop_to(depth)
                        break
                    if open_[depth].name in SCOPE and name not in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                        break
            continue
        if name not in IN_HEAD:
            end_head()
        if name in IMPLIED:
            end_like(*IMPLIED[name])
        if counts.get("table"):
            if name in BELONGS:
                depth = len(open_) - 1
                while open_[depth].name not in BELONGS[name]:
                    depth -= 1
                pop_to(depth + 1)
                if name in ("td", "th") and open_[-1].name != "tr":
                    push(Node("tr"))
            elif name == "table" and not in_cell():
                pop_to(_last(open_, "table"))
            elif name == "form" and open_[-1].name in FRAME:
                continue
        if name in ENDS_PARAGRAPH and counts.get("p"):
            end_like({"p"}, SCOPE)
        if name in ("html", "body") and counts.get(name):
            continue
        if name == "a" and counts.get("a"):
            end_like({"a"}, SCOPE)
        node = Node(name, _attributes(rest))
        if name in VOID:
            add(node)
            continue
        push(node)
        if name in RAW or name in ("title", "textarea"):
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            text = page[at : stop.start()] if stop else page[at:]
            if text:
                node.children.append(html.unescape(text) if name in ("title", "textarea") else text)
            at = stop.start() if stop else len(page)


def _last(nodes: list[Node], name: str) -> int:
    return max(i for i, n in enumerate(nodes) if n.name == name)


class _Lines:
    """Lines under construction: text flows into the last one; ``gap`` tells how many line ends must come before more text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.gap, self.mark, self.indent = False, 0, "", [""]  # mark: in place of the next line's indent

    def text(self, text: str, kept: bool) -> None:
        if kept:
            for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if k:
                    self.line_end()
                if line:
                    self.put(line)
            return
        body = _BLANKS.sub(" ", text)
        if body.startswith(" "):
            self.blank = self.blank or bool(self.parts)
            body = body[1:]
        if not body:
            return
        trailing = body.endswith(" ")
        self.put(body[:-1] if trailing else body)
        self.blank = trailing

    def put(self, text: str) -> None:
        if not self.parts:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.parts.append(self.mark or self.indent[-1])
            self.mark, self.blank = "", False
        if self.blank:
            self.parts.append(" ")
        self.parts.append(text)
        self.blank = False

    def line_end(self) -> None:
        """An explicit line end; an empty line is kept."""
        self.lines.append("".join(self.parts).rstrip() if self.parts else "")
        self.parts, self.blank = [], False

    def edge(self, gap: int) -> None:
        """A block begins or ends."""
        if self.parts:
            self.line_end()
        self.blank = False
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.edge(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        first = next((k for k, x in enumerate(self.lines) if x), 0)
        return self.lines[first:]


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _rows(table: Node, visible: bool) -> tuple[list[tuple[Node, bool]], list[list[tuple[Node, bool]]]]:
    """Captions, and the cells of each row of the table itself, each with whether what is around it is visible."""
    captions, rows = [], []
    todo = [(c, visible) for c in reversed(table.children)]
    while todo:
        node, seen = todo.pop()
        if isinstance(node, str) or not node.displayed():
            continue
        if node.name == "caption":
            captions.append((node, seen))
        elif node.name == "tr":
            seen = node.visible(seen)
            rows.append([(c, seen) for c in node.children if not isinstance(c, str) and c.name in ("td", "th") and c.displayed()])
        elif node.name in SECTIONS:
            todo += [(c, node.visible(seen)) for c in reversed(node.children)]
    return captions, rows


def _number(text: str | None, least: int, most: int, other: int) -> int:
    try:
        return min(most, max(least, int(text)))
    except (TypeError, ValueError):
        return other


def render(root: Node) -> str:
    """The visible text of a tree."""
    return "\n".join(_render(root, 0, True))


#: Columns are padded to this width at most, and a table gets this many blanks and four times its text at most.
WIDEST, BLANKS = 80, 4096
#: Tables in tables beyond this depth are read as blocks, not laid out.
TABLE_DEPTH = 40


def _grid(rows: list[list[tuple[Node, bool]]], depth: int) -> list[list[tuple[int, int, list[str]]]]:
    """For each row its cells as (first column, columns, lines); columns that a cell above still takes are left free."""
    grid: list[list[tuple[int, int, list[str]]]] = []
    hang: list[tuple[int, int, int]] = []  # first column, end, rows that it takes from here on; ascending
    for cells in rows:
        line, fresh, at, k = [], [], 0, 0
        for cell, seen in cells:
            while k < len(hang) and hang[k][0] <= at:
                at = max(at, hang[k][1])
                k += 1
            span, down = _number(cell.attributes.get("colspan"), 1, 1000, 1), _number(cell.attributes.get("rowspan"), 0, 65534, 1) or 65534
            line.append((at, span, _render(cell, depth + 1, cell.visible(seen))))
            if down > 1:
                fresh.append((at, at + span, down))
            at += span
        hang = sorted((a, b, n - 1) for a, b, n in hang + fresh if n > 1)
        grid.append(line)
    return grid


def _table(table: Node, depth: int, visible: bool) -> list[str]:
    """Captions and rows; columns are as wide as their widest cell that spans one, so far as the limits go."""
    captions, rows = _rows(table, visible)
    grid = _grid(rows, depth)
    full: dict[int, int] = {}
    for line in grid:
        for at, span, text in line:
            if span == 1:
                full[at] = max(full.get(at, 0), max(map(width, text), default=0))
    columns = sorted(full)
    most = BLANKS + 4 * sum(len(x) for line in grid for _, _, text in line for x in text)
    out = [x for c, seen in captions for x in _render(c, depth + 1, c.visible(seen))]
    for limit in (WIDEST, 32, 12, 4, 0):
        edges = {}  # where a column begins
        total = 0
        for c in columns:
            edges[c] = total
            total += min(full[c], limit) + 2
        lines = _lines(grid, columns, edges, most if limit else None)
        if lines is not None:
            break
    return out + lines


def _lines(grid: list[list[tuple[int, int, list[str]]]], columns: list[int], edges: dict[int, int], most: int | None) -> list[str] | None:
    """The lines of a table, each cell at its column's edge or two blanks after the one before; None if they take more blanks than ``most``. None as ``most``: two blanks between cells."""
    out, blanks = [], 0
    for line in grid:
        places = [(edges[columns[k]] if (k := bisect_left(columns, at)) < len(columns) else None, text) for at, _, text in line]
        for k in range(max((len(text) for _, _, text in line), default=0)):
            parts, size = [], 0
            for place, text in places:
                own = text[k] if k < len(text) else ""
                if not own:
                    continue
                gap = 2 if parts else 0
                if most is not None and place is not None:
                    gap = max(gap, place - size)
                parts.append(" " * gap + own)
                blanks += gap
                size += gap + width(own)
                if most is not None and blanks > most:
                    return None
            out.append("".join(parts).rstrip())
    return out


def _render(top: Node, depth: int, visible: bool) -> list[str]:
    out = _Lines()
    kept = 0
    lists: list[list] = []
    todo: list[tuple] = [("in", child, visible) for child in reversed(top.children)]
    while todo:
        step, node, seen = todo.pop()
        if step == "out":
            name = node.name
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if name in ("li", "dd", "blockquote"):
                out.edge(0)
                out.indent.pop()
                out.mark = ""
            if name == "pre":
                kept -= 1
            out.edge(2 if name in MARGIN and not (lists and name in ("ul", "ol")) else 1)
            continue
        if isinstance(node, str):
            if seen:
                out.text(node, kept > 0)
            continue
        if not node.displayed():
            continue
        name, seen = node.name, node.visible(seen)
        if name == "br":
            out.line_end()
            continue
        if name == "hr":
            out.edge(2)
            continue
        if name == "table" and depth < TABLE_DEPTH:
            out.edge(2)
            for line in _table(node, depth, seen):
                out.put(line) if line else None
                out.line_end()
            out.edge(2)
            continue
        if name in ("td", "th"):
            out.blank = bool(out.parts)
        if name == "wbr" or name == "img":
            continue
        if name in BLOCK:
            out.edge(2 if name in MARGIN and not (lists and name in ("ul", "ol")) else 1)
            if name in ("ul", "ol", "menu", "dir"):
                lists.append([name, _number(node.attributes.get("start"), -(10**9), 10**9, 1)])
            elif name == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    number = _number(node.attributes.get("value"), -(10**9), 10**9, lists[-1][1])
                    lists[-1][1] = number + 1
                    mark = f"{number}. "
                out.mark = (out.mark or out.indent[-1]) + mark
                out.indent.append(out.indent[-1] + " " * len(mark))
            elif name in ("dd", "blockquote"):
                out.indent.append(out.indent[-1] + "  ")
            elif name == "pre":
                kept += 1
                if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                    node.children[0] = node.children[0][1:]
            todo.append(("out", node, seen))
        todo += [("in", child, seen) for child in reversed(node.children)]
    return out.result()


def visible_text(page: str | None) -> str | None:
    return None if page is None else render(parse(page))


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, text, n_chars) of every page; n_chars: code points of the text, 0 where it is null."""
    rows = pages.select(key, *keep, page)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(text, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [visible_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x or "") for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.mapInArrow(frugal(run), schema)
