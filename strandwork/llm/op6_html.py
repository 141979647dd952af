"""Layout-aware text of HTML pages.

A page becomes a tree (with the end tags that HTML implies), elements that no browser would show are left out,
and the rest is laid out in lines: blocks keep blank lines between them, lists their markers and indents,
preformatted text its spaces, and the cells of a table row stand on the same lines in aligned columns.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Fixed sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object video audio canvas datalist noembed noframes param annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center dd details dialog div dir dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section select summary caption tr td th thead tbody tfoot".split())
#: Opening one of these ends an open element of those, unless one of the last stands between.
ENDS = (
    (frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split()), frozenset({"p"}), frozenset("button table td th caption template".split())),
    (frozenset({"li"}), frozenset({"li"}), frozenset("ul ol menu dir table td th".split())),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset("dl table td th".split())),
    (frozenset({"option", "optgroup"}), frozenset({"option"}), frozenset("select".split())),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset("tr table".split())),
    (frozenset({"tr"}), frozenset({"tr", "td", "th"}), frozenset("thead tbody tfoot table".split())),
    (frozenset("thead tbody tfoot".split()), frozenset("tr thead tbody tfoot td th caption colgroup".split()), frozenset({"table"})),
)
#: An end tag does not reach beyond these.
SCOPES = frozenset("table td th caption".split())
WITHIN_TABLE = SCOPES | frozenset("tr thead tbody tfoot".split())
#: Only in these a tag can close itself.
FOREIGN = ("svg", "math")
#: Elements of a drawing that are shown as text, and those whose content is shown only where it is used, or never.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_UNSHOWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
#: In tables of several columns, running text wraps at this width.
MAX_COLUMN = 60
#: The columns of a table share this width: what cannot wrap breaks at a column's part of it.
LINE = 2000
#: Deeper indents are written as this many spaces and their number, so that a line's is bounded.
MOST_INDENT = 200
#: Most Python calls that lay out one level of elements.
CALLS = 8

_opening = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_name = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(\s*+=\s*+)?)")
_bare = re.compile(r"[^\s>]*+")
_comment = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_simple = re.compile(r"[.#]?[\w-]+")
_unscreened = re.compile(r"@media\b(?![^{]*\b(?:screen|all)\b)[^{]*\b(?:print|speech)\b", re.I)
_gone = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_space = re.compile(r"[ \t\n\f\r]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of the tag whose name ends at `at`, whether it closes itself, and its end, or -1 if the page ends in it.

    Each character is looked at once: a quote runs to its next like, or to the end of the page.
    """
    found: dict[str, str] = {}
    while m := _name.match(page, at):
        at = m.end()
        if m[1]:
            return found, "/" in m[0], at
        value = ""
        if m[3]:
            if page[at : at + 1] in ("'", '"') and at < len(page):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return found, False, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _bare.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(m[2].lower(), html.unescape(value) if "&" in value else value)
    return found, False, -1


def _hiding(style: str) -> set[str]:
    """The simple selectors (tag, .class, #id) that a style sheet hides on a screen."""
    hidden: set[str] = set()
    before, open_rules = "", []
    for piece in re.split(r"([{}])", _comment.sub("", style)):
        if piece == "{":
            open_rules.append(before)
            before = ""
        elif piece == "}":
            if open_rules:
                selectors = open_rules.pop()
                if _gone.search(before) and not any(_unscreened.match(rule.strip()) for rule in open_rules):
                    hidden |= {x.strip() for x in selectors.split(",") if _simple.fullmatch(x.strip())}
            before = ""
        else:
            before = piece
    return hidden


def parse(page: str) -> tuple[Node, set[str], int]:
    """The tree of a page, the simple selectors (tag, .class, #id) that its style sheets hide, and the tree's depth.

    One pass: what a tag ends is found by the places of open elements of each kind, not by a walk over the stack.
    """
    root, hidden, start, at, deepest = Node("html"), set(), 0, 0, 1
    stack, places = [root], defaultdict(list)  # open elements, and the depths of those of each tag

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            places[node.tag].pop()
        del stack[depth:]

    while (at := page.find("<", at)) >= 0:
        m = _opening.match(page, at)
        if not m:
            if page.startswith("<!--", at):
                end = at + 5 if page.startswith("<!-->", at) else page.find("-->", at + 4) + 3
                end = len(page) if end == 2 else end
            elif page[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(page):
                end = page.find(">", at) + 1 or len(page)
            else:
                at += 1
                continue
            text(page[start:at])
            start = at = end
            continue
        text(page[start:at])
        attrs, itself, end = _attributes(page, m.end())
        if end < 0:
            start = len(page)
            break
        start = at = end
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            if places.get(tag) and (tag in WITHIN_TABLE or places[tag][-1] > last(SCOPES)):
                cut(places[tag][-1])
            continue
        for opening, ended, barrier in ENDS:
            if tag in opening and any(places.get(t) for t in ended):
                kept = last(barrier - ended)
                while (depth := last(ended)) > kept:
                    cut(depth)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            start = at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            if tag == "style":
                hidden |= _hiding(body)
            elif tag == "textarea":
                node.children.append(html.unescape(body))
        elif tag not in VOID and not (itself and (tag in FOREIGN or any(places.get(t) for t in FOREIGN))):
            places[tag].append(len(stack))
            stack.append(node)
            deepest = max(deepest, len(stack))
    text(page[start:])
    return root, hidden, deepest


def _invisible(node: Node, rules: set[str]) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input") or _gone.search(a.get("style", "")):
        return True
    if node.tag == "dialog" and "open" not in a:
        return True
    return bool(rules) and (node.tag in rules or "#" + a.get("id", "") in rules or any("." + c in rules for c in a.get("class", "").split()))


def _indent(width: int) -> str:
    return " " * width if width <= MOST_INDENT else " " * MOST_INDENT + f"[{width}] "


class _Flow:
    """Lines of a run of blocks; `gap` is the number of blank lines wanted before the next.

    Blocks inside others write to the same lines, each once: `indent` is what stands before a line, `marks` what list items
    that have no line yet put before the next one (from column `marks_at` on, `marks_len` long). A scope that is
    `fresh` has no line yet; `lead` blank lines come before its first.
    """

    def __init__(self, rules: set[str]):
        self.rules, self.lines, self.gap, self.words, self.kept, self.tables = rules, [], 0, [], [], 0
        self.indent, self.fresh, self.lead, self.marks, self.marks_at, self.marks_len = 0, True, 0, [], 0, 0

    def space(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def flush(self) -> None:
        if self.kept:
            lines = [line.rstrip() for line in "".join(self.kept).replace("\r", "").expandtabs(8).split("\n")]
            self.kept = []
            self.add(lines[: len(lines) - (not lines[-1])])
        if self.words:
            text = "".join(self.words)
            self.words = []
            for line in text.split("\x00"):
                line = _space.sub(" ", line).strip(" ")
                if line or "\x00" in text:
                    self.put([line])

    def put(self, lines: list[str]) -> None:
        first = next((i for i, line in enumerate(lines) if line), len(lines))
        if first < len(lines):
            self.add(lines[first:])

    def add(self, lines: list[str]) -> None:
        if not lines:
            return
        self.lines += [""] * (self.lead if self.fresh else self.gap)
        self.gap, self.fresh = 0, False
        if self.marks:
            before = _indent(self.marks_at) + "".join(self.marks) + " " * (self.indent - self.marks_at - self.marks_len)
            self.lines.append((before + lines[0]).rstrip())
            self.marks, lines = [], lines[1:]
        before = _indent(self.indent)
        self.lines += [before + line if line else "" for line in lines] if before else lines

    def scope(self, node: Node, width: int = 0, mark: str = "") -> None:
        """The children of a node, indented by `width`, the first line behind `mark`; no blank lines at either end."""
        self.flush()
        count, gap, fresh, lead = len(self.lines), self.gap, self.fresh, self.lead
        held, at, length = len(self.marks), self.marks_at, self.marks_len
        if not fresh:
            self.fresh, self.lead = True, gap
        self.gap = 0
        if mark:
            if not held:
                self.marks_at, self.marks_len = self.indent, 0
            pad = self.indent - self.marks_at - self.marks_len
            self.marks += [" " * pad, mark]
            self.marks_len += pad + len(mark)
        self.indent += width
        self.children(node)
        self.flush()
        self.indent -= width
        if len(self.lines) == count:  # nothing to see
            del self.marks[held:]
            self.gap, self.fresh, self.lead, self.marks_at, self.marks_len = gap, fresh, lead, at, length
        else:
            self.gap = 0

    def inner(self, node: Node, pre: bool = False) -> list[str]:
        flow = _Flow(self.rules)
        flow.children(node, pre)
        flow.flush()
        self.tables += flow.tables
        return flow.lines

    def children(self, node: Node, pre: bool = False) -> None:
        for child in node.children:
            if isinstance(child, str):
                (self.kept if pre else self.words).append(child)
            elif not _invisible(child, self.rules):
                self.element(child, pre)

    def element(self, node: Node, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            self.kept.append("\n") if pre else self.words.append("\x00")
        elif tag == "hr":
            self.space(1)
            self.put(["-" * 8])
            self.gap = 1
        elif tag == "details" and "open" not in node.attrs:
            self.children(Node("div", children=[c for c in node.children if not isinstance(c, str) and c.tag == "summary"]))
        elif tag == "svg":
            self.drawing(node)
        elif tag == "table":
            self.space(1)
            _table(node, self)
            self.gap = 1
        elif tag in ("ul", "ol", "menu", "dir"):
            self.space(1)
            self.items(node)
            self.space(1)
        elif tag in ("blockquote", "dd"):
            self.space(tag == "blockquote")
            self.scope(node, 2)
            self.space(tag == "blockquote")
        elif (tag == "pre" or tag == "textarea") and not pre:
            self.space(1)
            lines = self.inner(Node("pre", children=node.children), True)
            while lines and not lines[-1]:
                lines.pop()
            self.put(lines)
            self.gap = 1
        elif tag in BLOCKS:
            gap = int(tag in PARAGRAPHS)
            self.space(gap)
            self.children(node, pre)
            self.space(gap)
        else:
            self.children(node, pre)

    def drawing(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str) or child.tag in SVG_UNSHOWN or _invisible(child, self.rules):
                continue
            if child.tag in SVG_TEXT:
                self.words.append(" ")
                self.children(child)
                self.words.append(" ")
            else:
                self.drawing(child)

    def items(self, node: Node) -> None:
        try:
            number = int(node.attrs.get("start", "1"))
        except ValueError:
            number = 1
        for child in node.children:
            if isinstance(child, str) or _invisible(child, self.rules):
                if isinstance(child, str) and child.strip():
                    self.words.append(child)
                continue
            if child.tag != "li":
                self.element(child, False)
                continue
            self.flush()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            self.scope(child, len(mark), mark)


def _span(cell: Node, name: str) -> int:
    """The number of columns or rows of a cell, within the bounds of HTML; 0 rows are all that are left."""
    value = cell.attrs.get(name, "1").strip()
    number = int(value[:9]) if value.isascii() and value.isdigit() else 1
    return min(1000, number) or 1 if name == "colspan" else min(65534, number or 65534)


def _wrapped(lines: list[str], width: int, most: int) -> list[str]:
    """Running text in lines of at most `width` where it can break; what cannot, and preformatted and aligned lines, in pieces of `most`."""
    out: list[str] = []
    for line in lines:
        body = line.lstrip(" ")
        indent = " " * (len(line) - len(body))
        if len(line) > width and "  " not in body:
            line, *rest = body.split(" ")
            for word in rest:
                if len(indent) + len(line) + 1 + len(word) > width:
                    out.append(indent + line)
                    line = word
                else:
                    line += " " + word
            line = indent + line
        out.append(line)
    if max(map(len, out), default=0) <= most:
        return out
    return [piece for line in out for piece in ([line[k : k + most].rstrip() for k in range(0, len(line), most)] or [""])]


def _table(table: Node, flow: _Flow) -> None:
    flow.tables += 1
    rows: list[list[Node]] = []
    before, after = [], []  # texts and elements beside the rows

    def collect(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    before.extend([_space.sub(" ", child).strip()])
            elif _invisible(child, flow.rules) or child.tag in ("col", "colgroup"):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                collect(child)
            elif child.tag == "tr":
                rows.append([c if not isinstance(c, str) else Node("td", children=[c]) for c in child.children if not isinstance(c, str) and not _invisible(c, flow.rules) or isinstance(c, str) and c.strip()])
            else:
                (before if child.tag == "caption" or not rows else after).append(child)

    def beside(found: list[str | Node]) -> None:
        for x in found:
            flow.put([x]) if isinstance(x, str) else flow.scope(Node("div", children=[x]))

    collect(table)
    beside(before)
    if all(len(row) < 2 and all(_span(cell, "colspan") == 1 and "rowspan" not in cell.attrs for cell in row) for row in rows):  # one column
        for row in rows:
            for cell in row:
                flow.scope(cell)
        return beside(after)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: list[list[int]] = []  # columns that cells above still cover, in order: first, end, first row below
    for number, row in enumerate(rows):
        cells, column, over, below = [], 0, 0, []
        for cell in row:
            while over < len(taken) and taken[over][0] <= column:
                column = max(column, taken[over][1])
                over += 1
            width, until = _span(cell, "colspan"), min(len(rows), number + _span(cell, "rowspan"))
            cells.append((column, width, flow.inner(cell)))
            if until > number + 1:
                below.append([column, column + width, until])
            column += width
        before_row, taken = taken, []
        for a, z, until in sorted(before_row + below) if below else before_row:
            if until > number + 1:
                if taken and taken[-1][1:] == [a, until]:
                    taken[-1] = [taken[-1][0], z, until]
                else:
                    taken.append([a, z, until])
        grid.append(cells)
    lasts = sorted({column + width - 1 for cells in grid for column, width, _ in cells})  # the columns that have a width
    most = max(1, LINE // len(lasts))
    grid = [[(column, width, _wrapped(lines, min(MAX_COLUMN, most) * width, most)) for column, width, lines in cells] for cells in grid]
    widths = [0] * len(lasts)
    for span in (True, False):
        for cells in grid:
            for column, width, lines in cells:
                if (width == 1) == span:
                    a, z = bisect_left(lasts, column), bisect_left(lasts, column + width - 1)
                    widths[z] = max(widths[z], max(map(len, lines), default=0) - sum(widths[a:z]) - 2 * (z - a))
    edges, at = [], 0
    for width in widths:
        edges.append(at)
        at += width + 2 * bool(width)
    starts = {column: edges[bisect_left(lasts, column)] for cells in grid for column, _, _ in cells}
    out: list[str] = []
    for cells in grid:
        height = max((len(lines) for *_, lines in cells), default=0)
        for k in range(height):
            line, end = [], 0
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = max(starts[column] - end, 2 * bool(line))
                    line.append(" " * gap + lines[k])
                    end += gap + len(lines[k])
            out.append("".join(line).rstrip())
    flow.put(out)
    flow.gap = 0
    beside(after)


def render(page: str | None) -> tuple[str, int]:
    """Visible text of a page, and how many tables it has. A null page is empty; what is no HTML is one text."""
    root, rules, depth = parse((page or "").replace("\x00", ""))
    flow, limit = _Flow(rules), sys.getrecursionlimit()
    sys.setrecursionlimit(limit + CALLS * depth)
    try:
        flow.children(root)
    finally:
        sys.setrecursionlimit(limit)
    flow.flush()
    return "\n".join(flow.lines).strip("\n"), flow.tables


def _render_column(pages: pa.Array) -> pa.Array:
    done = [render(p.as_py()) for p in pages]
    return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["text", "tables"])


def extract(page: Column) -> Column:
    """struct<text, tables> of a column of HTML pages.

    Null and empty pages give an empty text. Equal pages give equal texts. Pages are read whole, at any depth of
    elements, and each line is written once with its indent. A tag that the page ends in is dropped, with an open quote in it,
    as browsers do. Spans keep the bounds of HTML: 1000 columns, and the rows that there are. Tables are always
    aligned: running text wraps at MAX_COLUMN, and what cannot wrap breaks where the columns would share more than LINE
    characters, so a row is that long, and a gap for each of its columns, at most. An indent beyond MOST_INDENT is written as
    so many spaces and its number in brackets. Time and text thus stay within a constant times the page, but for tables of
    several columns in cells of others, whose lines are laid out once more for each table around them.
    """
    return F.arrow_udf(_render_column, "text string, tables int")(page.cast("string"))
