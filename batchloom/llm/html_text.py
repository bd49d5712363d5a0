"""Visible text of HTML pages as it is laid out.

A tokenizer goes over a page once, forwards: where a comment, a tag or a quoted value
has no end, the page ends in it, as in a browser, and nothing is looked at twice. A tree builder
puts tags in place that HTML lets authors leave out, and rules of
visibility take out what a browser does not show. What is left is rendered: blocks
on lines of their own, with blank lines around those that have a margin; lists
with bullets or numbers; table cells in aligned columns; preformatted text as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values of HTML: elements without content, with a block's line breaks, with a margin, never shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
MARGIN = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
UNSEEN = frozenset("audio canvas datalist embed head iframe math noembed noframes noscript object script style svg template title video".split())
LISTS = frozenset("ul ol menu dir".split())
#: what may stand in a head; anything else ends it
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: an opening tag ends an open element of these kinds, up to the given border
ENDS = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}), "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}), "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "caption": ({"caption", "colgroup"}, {"table"}), "colgroup": ({"caption", "colgroup"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
_P_BORDER = frozenset("button td th caption table html body object".split())
_CELL_BORDER = frozenset("table td th caption".split())
#: deeper elements stand beside each other; their text is kept
DEPTH = 200
#: cells wider than this do not widen their column; beyond so many characters of a line cells are not aligned
COLUMN, ALIGNED = 60, 2000
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?<![\w-])display\s*:\s*none(?![\w-])", re.I)
_INVISIBLE = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)(?![\w-])", re.I)
#: elements whose content is no markup; of the latter it has character references
RAW, HALF_RAW = frozenset("script style xmp iframe noembed noframes".split()), frozenset("title textarea".split())
_NAME = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
_ATTRIBUTE = re.compile(r"[\t\n\f\r /]*+(?:(?P<end>>)|(?P<name>=?[^\t\n\f\r />=]*+)[\t\n\f\r ]*+(?P<is>=[\t\n\f\r ]*+(?:(?P<quote>[\"'])|(?P<value>[^\t\n\f\r >\"'][^\t\n\f\r >]*+)?))?)")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW | HALF_RAW}
_ZEROS = re.compile(r"&#([xX]?)0{2,}(?=[0-9a-fA-F])")
_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _plain(text: str) -> str:
    """Text with its character references resolved, whatever numbers they have."""
    if "&" not in text:
        return text
    return unescape(_LARGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from ``at`` on, the first of a name counts, and where the tag ends; -1 if it does not."""
    found: dict[str, str] = {}
    while at < len(html):
        m = _ATTRIBUTE.match(html, at)
        if m["end"]:
            return found, m.end()
        value, at = m["value"] or "", m.end()
        if m["quote"]:
            end = html.find(m["quote"], at)
            if end < 0:
                return found, -1
            value, at = html[at:end], end + 1
        if m["name"]:
            found.setdefault(m["name"].lower(), _plain(value))
        elif at == m.start():
            at += 1
    return found, -1


def _feed(html: str, builder: _Builder) -> None:
    """Hands the page's text and tags to the builder, in one pass."""
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        # a < that opens nothing is text
        while 0 <= begin < size - 1 and not (html[begin + 1].isascii() and (html[begin + 1].isalpha() or html[begin + 1] in "/!?")):
            begin = html.find("<", begin + 1)
        if begin < 0 or begin == size - 1:
            return builder.text(_plain(html[at:]))
        if begin > at:
            builder.text(_plain(html[at:begin]))
        after = html[begin + 1]
        if after in "!?":
            if html.startswith("<!--", begin):
                short = 5 if html.startswith(">", begin + 4) else 6 if html.startswith("->", begin + 4) else 0
                end = _COMMENT_END.search(html, begin + 4) if not short else None
                at = begin + short if short else end.end() if end else size
            else:
                at = html.find(">", begin) + 1 or size
        elif after == "/":
            name = _NAME.match(html, begin + 2)
            _, end = _attributes(html, name.end()) if name else ({}, html.find(">", begin) + 1 or -1)
            if end < 0:
                return
            if name:
                builder.end_tag(name[0].lower())
            at = end
        else:
            name = _NAME.match(html, begin + 1)
            attributes, at = _attributes(html, name.end())
            if at < 0:
                return
            tag = name[0].lower()
            builder.start_tag(tag, attributes)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                inside = html[at:end.start() if end else size]
                builder.inside(inside if tag in RAW else _plain(inside))
                at = end.start() if end else size
            elif tag == "plaintext":
                return builder.text(html[at:])


class _Builder:
    """Builds the tree; every tag finds its place whatever is missing or crossed."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack = [self.root]

    def _end(self, tags, border) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                del self.stack[at:]
                return
            if self.stack[at].tag in border:
                return

    def _end_head(self) -> None:
        if self.stack[-1].tag == "head":
            self.stack.pop()

    def start_tag(self, tag: str, attributes: dict[str, str]) -> None:
        if tag not in IN_HEAD:
            if self.stack[-1].tag == "noscript" and self.stack[-2].tag == "head":
                self.stack.pop()
            self._end_head()
        if tag in BLOCK and tag not in ("option", "optgroup"):
            self._end({"p"}, _P_BORDER)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr", {}))
        node = Node(tag, attributes)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        if len(self.stack) < DEPTH:
            self.stack.append(node)

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br", {}))
        elif tag not in VOID:
            border = () if tag in ("table", "tr", "td", "th", "body", "html") or tag in LISTS else _CELL_BORDER
            self._end({tag}, border)

    def inside(self, text: str) -> None:
        """Text of an element that holds no markup."""
        self.stack[-1].children.append(text)

    def text(self, text: str) -> None:
        if text.strip(" \t\n\r\f"):
            self._end_head()
        self.stack[-1].children.append(text)


def parse(html: str) -> Node:
    builder = _Builder()
    _feed(html, builder)
    return builder.root


class _Flow:
    """Lines under way: an inline run, the lines done, and blank lines that are due."""

    def __init__(self):
        self.lines, self.run, self.blank = [], [], 0

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text and not (text == " " and (not self.run or self.run[-1].endswith(" "))):
            self.run.append(text.lstrip(" ") if not self.run or self.run[-1].endswith(" ") else text)

    def close(self) -> None:
        line, self.run = "".join(self.run).strip(" "), []
        if line:
            self.add([line])

    def line_break(self) -> None:
        if self.run:
            self.close()
        elif self.lines and not self.blank:
            self.blank = 1

    def margin(self, lines: int) -> None:
        self.close()
        self.blank = max(self.blank, lines)

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
            self.lines += lines


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element has a box at all, and whether text in it is visible."""
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "input" and node.attrs.get("type") == "hidden"):
        return False, False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False, False
    style = node.attrs.get("style")
    if style:
        if _HIDDEN.search(style):
            return False, False
        found = _INVISIBLE.search(style)
        visible = found[1].lower() == "visible" if found else visible
    return True, visible


def _walk(node: Node, flow: _Flow, visible: bool, inner_list: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if visible:
                flow.text(child)
            continue
        box, seen = _shown(child, visible)
        if not box:
            continue
        tag = child.tag
        if tag == "br":
            flow.line_break()
        elif tag == "input":
            if seen and child.attrs.get("type") in ("submit", "button", "reset") and child.attrs.get("value"):
                flow.text(f" {child.attrs['value']} ")
        elif tag in BLOCK:
            gap = int(tag in MARGIN and not (inner_list and tag in LISTS))
            flow.margin(gap)
            if tag == "table":
                flow.add(_table(child, seen))
            elif tag in LISTS:
                _list(child, flow, seen)
            elif tag == "li":
                flow.add(_marked("- ", _lines(child, seen, True)))
            elif tag == "pre":
                flow.add(_preformatted(child, seen))
            elif tag in ("dd", "blockquote"):
                flow.add(_marked("  ", _lines(child, seen), "  "))
            elif tag == "details" and "open" not in child.attrs:  # closed: its summary alone
                _walk(_holding(*[c for c in child.children if not isinstance(c, str) and c.tag == "summary"][:1]), flow, seen)
            else:
                _walk(child, flow, seen)
            flow.margin(gap)
        elif tag in ("td", "th", "tr"):  # cells outside of a table
            flow.text(" ")
            _walk(child, flow, seen)
            flow.text(" ")
        else:
            _walk(child, flow, seen, inner_list)


def _holding(*children: Node | str) -> Node:
    holder = Node("div", {})
    holder.children = list(children)
    return holder


def _lines(node: Node, visible: bool, inner_list: bool = False) -> list[str]:
    flow = _Flow()
    _walk(node, flow, visible, inner_list)
    flow.close()
    return flow.lines


def _marked(mark: str, lines: list[str], rest: str | None = None) -> list[str]:
    rest = " " * len(mark) if rest is None else rest
    return [((mark if i == 0 else rest) + line).rstrip() for i, line in enumerate(lines)]


def _number(text: str | None, default: int) -> int:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"[+-]?[0-9]{1,9}", text) else default


def _list(node: Node, flow: _Flow, visible: bool) -> None:
    items = [c for c in node.children if not isinstance(c, str) and c.tag == "li"]
    step = -1 if "reversed" in node.attrs else 1
    number = _number(node.attrs.get("start"), len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            flow.add(_marked("  ", _lines(_holding(child), visible, True), "  "))
            continue
        number = _number(child.attrs.get("value"), number)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += step
        box, seen = _shown(child, visible)
        if box:
            flow.add(_marked(mark, _lines(child, seen, True)))


def _raw(node: Node, visible: bool) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            if visible:
                yield child
        elif child.tag == "br":
            yield "\n"
        else:
            box, seen = _shown(child, visible)
            if box:
                yield from _raw(child, seen)


def _preformatted(node: Node, visible: bool) -> list[str]:
    lines = [line.rstrip() for line in "".join(_raw(node, visible)).expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _rows(node: Node, visible: bool) -> Iterator[tuple[str, Node, bool]]:
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield "other", _holding(child), visible
            continue
        box, seen = _shown(child, visible)
        if not box or child.tag in ("col", "colgroup"):
            continue
        if child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, seen)
        elif child.tag == "tr":
            yield "row", child, seen
        else:
            yield "other", _holding(child), visible


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans by their columns, neighbours that end together as one."""
    out: list[tuple[int, int, int]] = []
    for begin, end, below in sorted(spans):
        if out and out[-1][1] >= begin and out[-1][2] == below:
            out[-1] = (out[-1][0], max(end, out[-1][1]), below)
        else:
            out.append((begin, end, below))
    return out


def _table(node: Node, visible: bool) -> list[str]:
    before, grid = [], []
    spans: list[tuple[int, int, int]] = []  # columns from, to, and the first row below, of cells that reach down
    for kind, child, seen in _rows(node, visible):
        if kind == "other":  # captions and what has no cell stand before the rows
            before += _lines(child, seen)
            continue
        row, column, number = {}, 0, len(grid)
        spans = _merged([x for x in spans if x[2] > number])
        taken, more = iter(spans), []
        ahead = next(taken, None)
        for cell in child.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    before += _lines(_holding(cell), seen)
                continue
            box, shown = _shown(cell, seen)
            if not box:
                continue
            while ahead and ahead[0] <= column:
                column, ahead = max(column, ahead[1]), next(taken, None)
            wide = min(1000, max(1, _number(cell.attrs.get("colspan"), 1)))
            tall = _number(cell.attrs.get("rowspan"), 1)
            row[column] = (wide, _lines(cell, shown))
            if tall > 1:
                more.append((column, column + wide, number + tall))
            column += wide
        spans += more
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for column, (wide, lines) in row.items():
            size = max(map(len, lines), default=0)
            if wide == 1 and size <= COLUMN:
                widths[column] = max(widths.get(column, 0), size)
    used = sorted(widths)
    left, at = {}, 0
    for column in used:
        left[column] = min(at, ALIGNED)
        at += widths[column] + 2
    out = list(before)
    for row in grid:
        for k in range(max((len(lines) for _, lines in row.values()), default=0)):
            line = ""
            for column in sorted(row):
                lines = row[column][1]
                if k < len(lines):
                    start = left.get(column, 0)
                    line = line.ljust(start) if len(line) + 2 <= start or not line else line + "  "
                    line += lines[k]
            out.append(line.rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page; empty for null and for pages without any."""
    return "\n".join(_lines(parse(html), True)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: page_id, text, n_chars, n_lines.

    Null and empty pages, and those without visible text, have an empty text of no
    lines. Pages of any length are rendered whole, in time that grows with their
    length. Repeated rows and rows without page_id are rows like others; other
    columns of ``pages`` are not looked at; an empty table gives an empty one.
    """
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    kind = narrow.schema["page_id"].dataType.simpleString()
    text = narrow.mapInArrow(run, f"page_id {kind}, text string")
    lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
