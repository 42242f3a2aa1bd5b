"""Layout-aware text of HTML pages: a tree builder and a renderer for all visible text.

The builder adds implied tags (an open paragraph, list item, option, row or cell ends where the next one
starts; cells get a row and a table), ignores end tags that match nothing, and closes what a matching
one leaves open. A head ends before text and before tags that cannot stand in it. Nesting has no limit: the renderer
keeps a stack of its own. Visibility rules drop what a browser does not show: head, scripts, styles, templates, comments,
``hidden``, ``display:none`` and ``visibility:hidden`` (but what is ``visible`` again inside), closed details
but for their summary. Texts of drawings and formulas are kept, without what these do not show.

Blocks get lines of their own, paragraphs, headings, lists and tables a blank line around them. List items
are numbered or dashed and indented by level. Cells of a table are padded to columns, over spans of rows and
columns. White space collapses but in ``pre``. A page without html (null or empty) has an empty text. Pages are
rendered each by itself, so repeated rows and repeated ids give the same text again, and there is no order to break
ties in.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilscan.llm.common import byte_slices, small_batches

# Fixed sets of element names.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
INVISIBLE = {"head", "script", "style", "template", "title", "meta", "link", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video", "canvas", "datalist"}
#: What may stand in a head; anything else, and text, ends it.
IN_HEAD = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}
#: What drawings and formulas hold but do not show, by the name of the outer element.
UNSHOWN = {
    "svg": {"desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker", "lineargradient", "radialgradient", "filter"},
    "math": {"annotation", "annotation-xml"},
}
#: Inside of these HTML goes on within a drawing or formula; elsewhere in it, a tag of ``BREAKOUT`` ends it.
HTML_AGAIN = {"foreignobject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "hr", "fieldset"}
BLOCK = SPACED | {
    "html", "body", "div", "section", "article", "aside", "nav", "header", "footer", "main", "address", "form", "details", "summary",
    "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "figcaption", "legend", "center", "hgroup", "menu", "dir", "option", "optgroup", "search",
}
#: What a start tag ends, if it is open and nothing of the second set is open inside it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup"}
#: An end tag or a paragraph's implied end does not reach out of these.
SCOPES = {"table", "td", "th", "caption", "template"}
BREAKOUT = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike",
    "sub", "sup", "table", "tt", "u", "ul", "var",
}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=]++)(?:\s*+=\s*+("[^"]*"?|'[^']*'?|[^\s>]*+))?)?""")
HIDDEN_STYLE = re.compile(r"(?<![\w-])(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.IGNORECASE)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.IGNORECASE)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "shown", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: Visibility, which a child may turn on again, unlike ``hidden``.
        self.shown = parent is None or parent.shown
        if "style" in attrs and (said := VISIBILITY.findall(attrs["style"])):
            self.shown = said[-1].lower() == "visible"
        #: The drawing or formula ("svg", "math") that children belong to.
        self.foreign = tag if tag in UNSHOWN else parent.foreign if parent and tag not in HTML_AGAIN else ""

    def hidden(self) -> bool:
        return (
            self.tag in INVISIBLE
            or "hidden" in self.attrs
            or bool(HIDDEN_STYLE.search(self.attrs.get("style", "")))
            or (self.tag == "dialog" and "open" not in self.attrs)
            or "\0unshown" in self.attrs
        )


class Builder:
    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # where elements of each name are open

    def text(self, text: str) -> None:
        if self.open[-1].tag == "head" and not SPACES.fullmatch(text):
            self.end_head()
        self.open[-1].children.append(text)

    def end_head(self) -> None:
        self.end({"head"}, set())
        self.push("body", {})

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.open[-1]
        if tag in UNSHOWN.get(parent.foreign, ()):
            attrs = {**attrs, "\0unshown": ""}
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def end(self, tags: set[str], within: set[str]) -> None:
        """Close the innermost open one of ``tags`` unless one of ``within`` is open inside it."""
        last = self.last(tags)
        if last and (last == len(self.open) - 1 or self.last(within) <= last):
            for node in self.open[last:]:
                self.at[node.tag].pop()
            del self.open[last:]

    def last(self, tags: set[str]) -> int:
        """Place of the innermost open one of ``tags``, 0 if none is open."""
        top = len(self.open) - 1
        for i in range(top, max(0, top - 8), -1):
            if self.open[i].tag in tags:
                return i
        return max([self.at[t][-1] for t in tags if self.at.get(t)], default=0) if top > 8 else 0

    def foreign_child(self) -> bool:
        """Whether the innermost element belongs to a drawing or formula, where ``/>`` ends it."""
        return self.open[-1].tag in UNSHOWN or (len(self.open) > 1 and bool(self.open[-2].foreign))

    def start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body") and self.at.get(tag):
            return
        if tag in BREAKOUT:
            while self.open[-1].foreign:
                self.end({self.open[-1].tag}, set())
        if tag == "head" and (self.at.get("head") or self.at.get("body")):
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            if tag in ("html", "body", "frameset"):
                self.end({"head"}, set())
            else:
                self.end_head()
        if tag in ENDS_PARAGRAPH or tag in ("li", "dt", "dd"):
            self.end({"p"}, SCOPES | {"li", "ul", "ol", "dl", "button"} if tag in ("li", "dt", "dd") else SCOPES | {"button"})
        if tag == "a":
            self.end({"a"}, SCOPES | BLOCK)
        if tag in ENDS:
            self.end(*ENDS[tag])
        if tag in ("tr", "thead", "tbody", "tfoot"):
            self.end({"td", "th"}, {"table"})
            if tag != "tr":
                self.end({"tr"}, {"table"})
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            if self.at.get("table"):
                self.push("tr", {})
        self.push(tag, attrs)

    def end_tag(self, tag: str) -> None:
        if tag in ("table", "body", "html"):
            self.end({tag}, set())
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption"):
            self.end({tag}, {"table"})
        else:  # inline elements do not end blocks inside them
            self.end({tag}, SCOPES - {tag} if tag in BLOCK or tag in ("select", "button") else SCOPES | BLOCK)


def attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place after the tag's end."""
    attrs: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(text, at)
        if m.end() == at or m.end() >= len(text):
            at = m.end()
            if m[1] is None or at >= len(text):
                return attrs, min(len(text), at + 1)
        at = m.end()
        if m[1] is None:
            if text[at] == ">":
                return attrs, at + 1
            at += 1  # a sign that fits nowhere
            continue
        value = m[2] or ""
        attrs.setdefault(m[1].lower(), html.unescape(value[1:].rstrip(value[0]) if value[:1] in ("'", '"') else value))


def parse(page: str) -> Node:
    build, at, n = Builder(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            build.text(html.unescape(page[at:lt]))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4 if not page.startswith("<!-->", lt) else lt + 2)
            at = n if end < 0 else end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?") or (page.startswith("</", lt) and not NAME.match(page, lt + 2)):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := NAME.match(page, lt + 2 if page.startswith("</", lt) else lt + 1):
            attrs, at = attributes(page, m.end())
            tag = m[0].lower()
            if page[lt + 1] == "/":
                build.start_tag("br", {}) if tag == "br" else build.end_tag(tag)
                continue
            build.start_tag(tag, attrs)
            if build.open[-1].tag == tag and page.endswith("/>", lt, at) and build.foreign_child():
                build.end({tag}, set())
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                end = close.start() if close else n
                inner = page[at:end]
                build.text(html.unescape(inner) if tag in ("textarea", "title") else inner)
                at = end
                build.end({tag}, set())
                if close:
                    _, at = attributes(page, close.end())
        else:
            build.text("<")
            at = lt + 1
    return build.root


class Flow:
    """Lines of text; asks for blank lines between blocks are merged."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = False  # a space is due before the next text
        self.gap = 0

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.write(first)
            for line in more:
                self.line(keep=True)
                self.write(line)
            return
        words = SPACES.split(text)
        for i, word in enumerate(words):
            self.space |= i > 0
            if word:
                self.write((" " if self.space and self.current else "") + word)
                self.space = False

    def write(self, text: str) -> None:
        if text:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap if self.lines[-1] else 0)
            self.gap = 0
            self.current.append(text)

    def line(self, keep: bool = False) -> None:
        """End the line; without ``keep`` an empty one is no line."""
        if self.current or keep:
            self.lines.append("".join(self.current).rstrip())
            self.current = []
        self.space = False

    def block(self, gap: bool) -> None:
        self.line()
        self.gap = max(self.gap, int(gap))

    def add(self, lines: list[str], gap: bool) -> None:
        """Whole lines as a block."""
        self.block(gap)
        if lines:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.lines += lines
        self.block(gap)

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def number(value: str | None, otherwise: int, most: int = 1_000) -> int:
    m = re.match(r"\s*(\d{1,9})", value or "")
    return min(int(m[1]), most) if m and int(m[1]) else otherwise


#: A step of the renderer: it yields the steps that it needs and is sent their results.
Step = Generator["Step", list[str] | None, list[str] | None]


def run(step: Step) -> list[str] | None:
    """The result of a step. The steps under way are a list, so nesting may be as deep as it likes."""
    steps, result = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(result))
            result = None
        except StopIteration as done:
            steps.pop()
            result = done.value
    return result


def flowed(node: Node, pre: bool = False) -> Step:
    flow = Flow()
    yield inside(node, flow, pre)
    return flow.done()


def inside(node: Node, flow: Flow, pre: bool) -> Step:
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if not closed and node.shown:
                flow.text(child, pre)
        elif not child.hidden() and not (closed and child.tag != "summary"):
            yield render(child, flow, pre)


def render(node: Node, flow: Flow, pre: bool) -> Step:
    tag = node.tag
    if tag == "br":
        flow.line(keep=node.shown)
    elif tag == "hr":
        flow.block(True)
    elif tag == "input":
        if node.shown and node.attrs.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "password", "file", "image"):
            flow.text(node.attrs.get("value", ""), False)
    elif tag == "table":
        flow.add((yield table_lines(node)), True)
    elif tag in ("ul", "ol", "menu", "dir"):
        flow.add((yield list_lines(node)), True)
    elif tag == "dd":
        flow.add(["  " + line if line else line for line in (yield flowed(node, pre))], False)
    elif tag == "blockquote":
        flow.add(["  " + line if line else line for line in (yield flowed(node, pre))], True)
    elif tag in BLOCK or tag == "text":  # a text of a drawing
        flow.block(tag in SPACED)
        yield inside(node, flow, pre or tag == "pre")
        flow.block(tag in SPACED)
    else:
        yield inside(node, flow, pre or tag in ("textarea", "xmp"))


def list_lines(node: Node) -> Step:
    lines: list[str] = []
    at = number(node.attrs.get("start"), 1, 10**9)
    loose = Node("div", {}, node)  # what stands outside of items
    for child in [*node.children, Node("li", {})]:
        if not isinstance(child, Node) or child.tag != "li":
            loose.children.append(child)
            continue
        lines += ["  " + line for line in (yield flowed(loose))]
        loose = Node("div", {}, node)
        own = [] if child.hidden() else [line for line in (yield flowed(child)) if line]
        if not own:
            at += not (child.shown or child.hidden() or child.tag != "li" or node.tag != "ol")
            continue
        at = number(child.attrs.get("value"), at, 10**9)
        mark = f"{at}. " if node.tag == "ol" else "- "
        at += 1
        lines += [mark + own[0], *(" " * len(mark) + line for line in own[1:])]
    return lines


def table_lines(node: Node) -> Step:
    """Rows with cells padded to columns; what stands outside of cells comes first."""
    outside, rows = Node("div", {}), []  # texts outside of cells that are not visible are left out below

    walks = [(node, iter(node.children))]
    while walks:
        part, children = walks[-1]
        if (child := next(children, None)) is None:
            walks.pop()
        elif isinstance(child, str):
            outside.children += [child] * part.shown
        elif child.hidden() or child.tag in ("colgroup", "col"):
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            walks.append((child, iter(child.children)))
        elif child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden()])
            outside.children += [c for c in child.children if (child.shown if isinstance(c, str) else c.tag not in ("td", "th"))]
        else:
            outside.children.append(child)
    # Cells by row and column; a cell that spans rows keeps its columns in the rows below.
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows that it is still taken for
    widths: dict[int, int] = {}
    for row in rows:
        cells, column, next_taken = [], 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row:
            while column in taken:
                column += 1
            across, lines = number(cell.attrs.get("colspan"), 1), (yield flowed(cell))
            if (down := number(cell.attrs.get("rowspan"), 1, 65_534)) > 1:
                next_taken |= {column + i: down - 1 for i in range(across)}
            if across == 1:
                widths[column] = max(widths.get(column, 0), *(len(line) for line in lines), 0)
            cells.append((column, across, lines))
            column += across
        placed.append(cells)
        taken = next_taken
    starts, at = {}, 0
    for column in range(max([c + a for cells in placed for c, a, _ in cells], default=0)):
        starts[column] = at
        at += widths[column] + 3 if widths.get(column) else 0
    out = yield flowed(outside)
    for cells in placed:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if i < len(lines):
                    if line:
                        line = line.ljust(starts[column] - 3) + " | " if i == 0 else line.ljust(starts[column])
                    else:
                        line = " " * starts[column]
                    line += lines[i]
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(run(flowed(parse(page)))).replace("\xa0", " ")


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page in ``to`` (an input column of that name gives way).

    Where that is the html's own name, the html moves to ``<name>_source``, with as many ``_`` after it as no other column has.
    """
    small_batches(pages.sparkSession)
    kept, source = pages.drop(to), html_col
    if to.lower() == html_col.lower():
        source += "_source"
        while source.lower() in (c.lower() for c in pages.columns):
            source += "_"
        kept = pages.withColumnRenamed(html_col, source)
    at = kept.columns.index(source)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.StringType(), False)])

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, at):
                texts = [visible_text(p) for p in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)
