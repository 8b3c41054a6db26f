"""Layout-aware rendering of HTML pages as plain text.

A tree builder with implied tags (a paragraph ends where a block begins, a list
item where the next one begins, and so on) and visibility rules (no scripts,
styles, head, templates, fallback content, ``hidden`` or ``display:none``
elements, closed details) gives a tree of what a reader sees. Rendering keeps
block spacing, list markers and indents, preformatted text, and tables as
columns of equal width. All visible text comes out; nothing is judged as boilerplate.

Defined results for edge cases: null html gives null text; empty pages, and
pages without visible text, give empty text; broken markup is read as a browser
would, to its end; nesting of any depth is walked without recursion; repeated
rows give repeated results; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.llm.common import map_rows

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist meta link".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr address form fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main li dt dd details summary figcaption center dir menu caption tr legend search option".split()
)
#: Opening the tag on the left ends an open element on the right, up to the barrier.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
    "tr": ("tr td th caption colgroup", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", ("table",)), "tfoot": ("tbody thead tfoot tr td th caption", ("table",)),
    "thead": ("tbody thead tfoot tr td th caption", ("table",)), "body": ("head", ("html",)),
}
_TABLE_PARTS = ("td", "th", "caption")


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hidden = tag in UNSEEN or "hidden" in attributes or attributes.get("type", "").lower() == "hidden" or bool(_HIDING.search(attributes.get("style", "")))


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def build_tree(page: str) -> Node:
    """The page as a tree of elements and text."""
    root = Node("html", {})
    stack = [root]
    is_open: Counter[str] = Counter()  # open elements by tag, so that deep pages are not searched in vain

    def end(tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        """Close the innermost open element of these tags and all within, unless a barrier comes first."""
        if not any(is_open[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                is_open.subtract(n.tag for n in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in barriers:
                return

    at, lower = 0, None
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not is_open["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag != "br":
                end((tag,), _TABLE_PARTS if tag not in ("table", "tr", "tbody", "thead", "tfoot", *_TABLE_PARTS, "body", "html") else ())
            else:
                stack[-1].children.append(Node("br", {}))
            continue
        if tag in CLOSES:
            tags, barriers = CLOSES[tag]
            for _ in range(3):  # a cell, its row and its group may all end
                end(tuple(tags.split()), barriers)
        if tag in BLOCK:
            end(("p",), ("table", *_TABLE_PARTS, "button"))
        if tag in ("html", "body") and (is_open[tag] or tag == "html"):
            continue
        node = Node(tag, _attributes(m[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            if len(lower) != len(page):  # lower case of a few letters is longer
                lower = re.sub("[A-Z]", lambda x: x[0].lower(), page)
            stop = lower.find(f"</{tag}", at)
            stop = len(page) if stop < 0 else stop
            node.children.append(html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            close = page.find(">", stop)
            at = len(page) if close < 0 else close + 1
        elif tag not in VOID:
            stack.append(node)
            is_open[tag] += 1
    return root


class _Flow:
    """Text under way in the page or in one table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0  # empty lines due before the next line
        self.lists: list[list] = []  # [ordered, next number]
        self.marker = ""

    def text(self, s: str) -> None:
        self.inline.append(s)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if text:
            self.line(text)

    def line(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        indent = "  " * max(0, len(self.lists) - 1)
        if self.marker:
            self.lines.append(indent + self.marker + text)
            self.marker = ""
        else:
            self.lines.append(indent + ("  " if self.lists else "") + text)


def _number(node: Node, name: str, most: int) -> int:
    """A span: 1 where it is missing or no number; 0 means all that is left."""
    raw = node.attributes.get(name, "1")
    return min(int(raw) or most, most) if raw.isdecimal() and len(raw) < 6 else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, columns, rows) at their places; what else a cell spans is empty."""
    out, taken = [], {}  # column: rows that a cell above still covers
    for cells in rows:
        line, still = [], {}
        waiting = iter(cells)
        cell = next(waiting, None)
        while cell is not None or any(column >= len(line) for column in taken):
            column = len(line)
            if column in taken:
                line.append("")
                if taken[column] > 1:
                    still[column] = taken[column] - 1
                continue
            if cell is None:
                line.append("")
                continue
            text, columns, down = cell
            for k in range(columns):
                if k and len(line) in taken:  # a cell from above ends this one's span
                    break
                if down > 1:
                    still[len(line)] = down - 1
                line.append("" if k else text)
            cell = next(waiting, None)
        taken = still
        out.append(line)
    return out


def _table(cells: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of cells as lines whose columns have equal width; a row is as high as its highest cell."""
    rows = [[c.split("\n") for c in r] for r in _grid(cells) if any(r)]
    width = [max((len(x) for r in rows if k < len(r) - 1 for x in r[k]), default=0) for k in range(max(map(len, rows), default=0))]
    out = []
    for r in rows:
        for at in range(max(map(len, r))):
            parts = [c[at] if at < len(c) else "" for c in r]
            if at:  # below a row's first line only what there is
                while parts and not parts[-1]:
                    parts.pop()
            out.append(" | ".join([x.ljust(width[k]) if k < len(parts) - 1 else x for k, x in enumerate(parts)]).rstrip())
    return out


def _cell(lines: list[str]) -> str:
    """A cell's lines, without empty ones at its ends and without an indent that all of them have."""
    lines = [x.rstrip() for x in lines]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    indent = min((len(x) - len(x.lstrip()) for x in lines if x), default=0)
    return "\n".join(x[indent:] for x in lines)


def render(page: str) -> str:
    """The visible text of a page, laid out in lines."""
    flows, tables, preformatted = [_Flow()], [], 0
    todo: list = [(build_tree(page), False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if preformatted:
                *whole, last = node.replace("\r\n", "\n").split("\n")
                for part in whole:
                    raw = "".join(flow.inline) + part
                    flow.inline = []
                    flow.line(raw.rstrip()) if raw.strip() or flow.lines else None
                flow.inline.append(last)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden:
                continue
            if tag == "br":
                flow.flush()
                continue
            if tag in BLOCK and tag != "tr":
                flow.flush()
                if tag in SPACED and not flow.lists and not flow.marker:
                    flow.gap = 1
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                flow.lists.append([tag == "ol", int(start) if start.isdecimal() and len(start) < 10 else 1])
            elif tag == "li":
                if flow.lists and flow.lists[-1][0]:
                    flow.marker = f"{flow.lists[-1][1]}. "
                    flow.lists[-1][1] += 1
                else:
                    flow.marker = "- "
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(_Flow())
            elif tag == "pre":
                preformatted += 1
            elif tag == "hr":
                flow.gap = 1
            elif tag == "input" and node.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                flow.text(node.attributes.get("value", ""))
            todo.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            todo.extend((c, False) for c in reversed(children))
            continue
        if tag == "pre":
            preformatted -= 1
            raw = "".join(flow.inline).rstrip()
            flow.inline = []
            if raw:
                flow.line(raw)
            flow.gap = 1
        elif tag in ("td", "th") and tables:
            flow.flush()
            flows.pop()
            text = _cell(flow.lines)
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((text, _number(node, "colspan", 1000) if node.attributes.get("colspan") != "0" else 1, _number(node, "rowspan", 65534)))
        elif tag == "table":
            flow.flush()
            for line in _table(tables.pop()):
                if line:
                    flow.line(line)
                else:
                    flow.gap = 1
            flow.gap = 1
        elif tag in BLOCK and tag != "tr":
            flow.flush()
            if tag in ("ul", "ol", "menu", "dir") and flow.lists:
                flow.lists.pop()
            if tag == "li":
                flow.marker = ""
            if tag in SPACED and not flow.lists:
                flow.gap = 1
    flows[0].flush()
    return "\n".join(flows[0].lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_lines) of every page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else render(x) for x in batch.column(1).to_pylist()]
        lines = [len(t.split("\n")) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return map_rows(rows, run, "page_id long, text string, n_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
