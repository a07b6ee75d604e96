"""Visible text of web pages, laid out in blocks, lists and aligned tables.

A page is cut into tags and text, built into a tree with the tags HTML lets authors leave out, and
rendered: hidden elements say nothing, block elements begin on their own lines, list items carry
their mark and depth, the cells of a table are padded to common column widths.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.tables import numbered, spelled

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
# What a browser never paints: heads, code, fallbacks for what it can show itself, and the parts of
# drawings and formulas that only describe them.
HIDDEN = set("head title script style template noscript iframe object audio video canvas datalist "
             "noembed noframes defs desc metadata symbol annotation annotation-xml".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset "
            "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu "
            "nav ol option optgroup p pre section summary table text textarea ul xmp caption "
            "tr".split())
SPACED = set("p blockquote h1 h2 h3 h4 h5 h6 ul ol dl pre table figure".split())
# A start tag closes open elements of these names, searched for no further than the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "tr", "caption", "option", "optgroup", "text", "textarea"}
KEEPS_SPACE = {"pre", "textarea", "xmp"}
WALLS = {"td", "th", "table", "caption", "button", "body", "html"}

_BEGIN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
_INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.attributes = attributes
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        for key, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if key.lower() == name:
                return html.unescape(a or b or c)
        return None


class Open(list):
    """The elements that are open, outermost first, and how many there are of each name."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.names = Counter([root.tag])

    def push(self, node: Node) -> None:
        self[-1].children.append(node)
        self.append(node)
        self.names[node.tag] += 1

    def cut(self, at: int) -> None:
        while len(self) > at:
            self.names[self.pop().tag] -= 1


def tree(page: str) -> Node:
    """The element tree; unclosed, misnested and unknown tags are allowed."""
    root = Node("html")
    stack = Open(root)
    at = 0
    last = page.rfind(">")
    while True:
        found = _BEGIN.search(page, at)
        if found and found.end() > last + 1:
            found = None  # nothing ends after here: the rest is text
        end = found.start() if found else len(page)
        if end > at:
            _add_text(stack, html.unescape(page[at:end]))
        if not found:
            return root
        tag = found.group(2)
        if tag is None:
            close = page.find("-->" if found.group() == "<!--" else ">", found.end())
            at = len(page) if close < 0 else page.index(">", close) + 1
            continue
        tag = tag.lower()
        inside = _INSIDE.match(page, found.end()).end()
        if page[inside:inside + 1] != ">":  # an open quote: the tag ends where it can
            inside = page.find(">", found.end())
            if inside < 0:
                _add_text(stack, html.unescape(page[end:]))
                return root
        at = inside + 1
        if found.group(1):
            _close(stack, tag)
            continue
        _open(stack, tag, page[found.end():inside])
        if tag in RAW and stack[-1].tag == tag:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag in ("title", "textarea", "xmp"):
                raw = page[at:close.start() if close else len(page)]
                _add_text(stack, raw if tag == "xmp" else html.unescape(raw))
            at = close.end() if close else len(page)
            stack.cut(len(stack) - 1)


def _add_text(stack: Open, text: str) -> None:
    if stack[-1].tag == "head" and text.strip():
        stack.cut(len(stack) - 1)  # text ends the head
    if stack[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and not text.strip():
        return
    stack[-1].children.append(text)


def _open(stack: Open, tag: str, attributes: str) -> None:
    if tag == "html":
        stack[0].attributes = stack[0].attributes or attributes
        return
    if tag in ENDS_PARAGRAPH:
        _close_up_to(stack, {"p"}, WALLS)
    if tag in CLOSES:
        names, stops = CLOSES[tag]
        _close_up_to(stack, names, stops)
    if stack[-1].tag == "head" and tag not in (
            "title", "meta", "link", "base", "style", "script", "noscript", "template"):
        stack.cut(len(stack) - 1)
    if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
        stack.push(Node("tr"))
    stack.push(Node(tag, attributes))
    if tag in VOID:
        stack.cut(len(stack) - 1)


def _close_up_to(stack: Open, names: set[str], stops: set[str]) -> None:
    """Close the outermost open element of these names above the nearest stop."""
    if not any(stack.names[name] for name in names):
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in stops:
            cut = i + 1
            break
    else:
        cut = 1
    for i in range(cut, len(stack)):
        if stack[i].tag in names:
            stack.cut(i)
            return


def _close(stack: Open, tag: str) -> None:
    walls = WALLS - {tag} if tag not in ("body", "html") else set()
    for i in () if not stack.names[tag] else range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if stack[i].tag in walls and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            return
    if tag == "p":
        stack[-1].children.append(Node("p"))


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes:
        return True
    if node.tag == "input":
        return False
    names = [m[0].lower() for m in _ATTRIBUTE.findall(node.attributes)]
    if "hidden" in names or node.tag == "dialog" and "open" not in names:
        return False
    return not _NOT_SHOWN.search(node.attribute("style") or "")


def width(text: str) -> int:
    """Columns a text takes on a fixed-width screen."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1
               for c in text)


class Page:
    """Lines being written; a margin is a blank line, never doubled."""

    def __init__(self, nesting: int = 0) -> None:
        self.nesting = nesting  # tables around this one
        self.lines: list[str] = []
        self.line: list[str] = []
        self.margin = False
        self.pending_space = False
        self.prefix = ""
        self.mark = ""

    def text(self, text: str) -> None:
        parts = _SPACE.split(text)
        for i, part in enumerate(parts):
            if i and self.line:
                self.pending_space = True
            if part:
                if self.pending_space:
                    self.line.append(" ")
                self.line.append(part)
                self.pending_space = False

    def raw(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                self.line.append(part)

    def newline(self) -> None:
        """End the line, also an empty one (a <br>)."""
        self.emit("".join(self.line))

    def emit(self, text: str) -> None:
        if self.margin and self.lines:
            self.lines.append("")
        self.margin = False
        mark, self.mark = self.mark, ""
        self.lines.append((self.prefix + mark + text).rstrip())
        if mark:
            self.prefix += " " * width(mark)
        self.line, self.pending_space = [], False

    def end_line(self) -> None:
        if self.line:
            self.newline()
        self.pending_space = False

    def space(self) -> None:
        self.end_line()
        self.margin = True


def render(node: Node) -> str:
    page = Page()
    _walk(node, page)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def _walk(root: Node, page: Page) -> None:
    """Depth first, with a stack of its own: pages may nest deeper than Python's calls."""
    todo: list = [("enter", root, 0, False)]
    while todo:
        step = todo.pop()
        if step[0] == "leave":
            _leave(step[1], page, *step[2:])
            continue
        _, node, depth, pre = step
        if isinstance(node, str):
            page.raw(node) if pre else page.text(node)
            continue
        if not visible(node):
            continue
        tag = node.tag
        if tag == "br":
            page.newline()
            continue
        if tag == "hr":
            page.space()
            page.emit("----")
            page.margin = True
            continue
        if tag == "img":
            page.text(node.attribute("alt") or "")
            continue
        if tag == "table":
            page.space()
            for line in table_lines(node, page.nesting):
                page.emit(line)
            page.margin = True
            continue
        before = (page.prefix, page.mark)
        if tag in BLOCK:
            page.space() if tag in SPACED and not (depth and tag in ("ul", "ol")) else page.end_line()
        if tag == "blockquote" or tag == "dd":
            page.prefix += "  "
        if tag in ("ul", "ol") and depth:
            page.prefix += "" if page.mark else "  "
        if tag in ("td", "th", "option") and page.line:
            page.text(" ")
        todo.append(("leave", node, before, depth))
        inner = depth + (tag in ("ul", "ol", "menu"))
        number = 1
        children = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                if not visible(child):
                    continue
                value = child.attribute("value") if child.attributes else None
                if value and value.lstrip("-").isdigit():
                    number = int(value)
                mark = f"{number}. " if tag == "ol" else "* "
                number += 1
                children.append(("enter", _marked(child, mark), inner, pre))
            else:
                children.append(("enter", child, inner, pre or tag in KEEPS_SPACE))
        if tag == "li":
            mark = node.attributes if node.attributes.startswith("\0") else "* "
            page.mark = mark.lstrip("\0")
        todo.extend(reversed(children))


def _marked(item: Node, mark: str) -> Node:
    out = Node("li", "\0" + mark)
    out.children = item.children
    return out


def _leave(node: Node, page: Page, before: tuple[str, str], depth: int) -> None:
    tag = node.tag
    if tag in BLOCK:
        page.end_line()
        if tag in SPACED and not (depth and tag in ("ul", "ol")):
            page.margin = True
    if tag in BLOCK:
        page.prefix = before[0]
        if tag == "li":
            page.mark = ""


def _rows(table: Node) -> Iterator[tuple[str, Node]]:
    """Captions and rows of a table, not those of tables inside its cells."""
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if node.strip():
                yield "text", node
        elif visible(node):
            if node.tag in ("tr", "caption"):
                yield node.tag, node
            elif node.tag in ("thead", "tbody", "tfoot"):
                todo.extend(reversed(node.children))
            elif node.tag not in ("colgroup", "col"):
                yield "text", node


def _span(cell: Node) -> int:
    value = cell.attribute("colspan") if cell.attributes else None
    return min(max(int(value), 1), 1000) if value and value.isdigit() else 1


def table_lines(table: Node, nesting: int) -> list[str]:
    """Cells side by side, each column as wide as its widest cell."""
    before: list[str] = []
    grid: list[list[list[str]]] = []
    for kind, node in _rows(table):
        if kind == "text":
            text = _SPACE.sub(" ", node).strip() if isinstance(node, str) else _inner(node, nesting)
            before.extend(text.split("\n") if text else [])
        elif kind == "caption":
            before.extend(_inner(node, nesting).split("\n"))
        else:
            row: list[list[str]] = []
            for cell in node.children:
                if isinstance(cell, str):
                    if cell.strip():
                        row.append([_SPACE.sub(" ", cell).strip()])
                elif visible(cell):
                    row.append(_inner(cell, nesting).split("\n"))
                    if cell.tag in ("td", "th"):
                        row.extend([[""]] * (_span(cell) - 1))
            if any(any(c) for c in row):
                grid.append(row)
    columns = max(map(len, grid), default=0)
    widths = [max((width(line) for row in grid if len(row) > k for line in row[k]), default=0)
              for k in range(columns)]
    lines = [x for x in before if x]
    for row in grid:
        for k in range(max(map(len, row))):
            parts = [cell[k] if k < len(cell) else "" for cell in row]
            padded = [p + " " * (w - width(p)) for p, w in zip(parts, widths)]
            lines.append("  ".join(padded).rstrip())
    return lines


def _inner(cell: Node, nesting: int) -> str:
    if nesting > 50:  # flat from here on: as text, in order
        words: list[str] = []
        todo: list = [cell]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                words.append(node)
            elif visible(node):
                todo.extend(reversed(node.children))
        return _SPACE.sub(" ", " ".join(words)).strip()
    page = Page(nesting + 1)
    holder = Node("div")
    holder.children = cell.children
    _walk(holder, page)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def page_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def visible_text(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """``page_id, text, n_blocks, n_chars`` of each row of ``pages``.

    Left out is what a browser does not paint: elements named in ``HIDDEN``, closed dialogs, and what
    the ``hidden`` attribute or an inline style hides (style sheets are not read). Forms, drawings and
    formulas show their text: options, text areas and labels of drawings on lines of their own.

    A NULL or empty page gives an empty text without blocks (paragraphs between blank lines). Rows
    are rendered each by itself and whole: repeated rows repeat, a NULL id stays NULL, other columns
    are not read, an empty table gives no rows. Broken markup never fails: what is not a tag is text.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [page_text(x) for x in batch["page"]]
            yield pd.DataFrame({
                "page_id": batch["page_id"], "text": texts,
                "n_blocks": [len(re.split(r"\n\n+", t)) if t else 0 for t in texts],
                "n_chars": list(map(len, texts))})

    narrow = pages.select(spelled(page_id)[0].alias("page_id"), F.col(page).alias("page"))
    return numbered(narrow.mapInPandas(
        rows, "page_id string, text string, n_blocks long, n_chars long"), "page_id")
