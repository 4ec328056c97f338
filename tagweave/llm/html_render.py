"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text rendering of what is visible.

Tags are read in one pass; the tree builder closes paragraphs, list items, table cells and the like
where the next tag implies their end, supplies table rows, and ignores end tags that match nothing.
Elements that are never shown (scripts, styles, templates, metadata), hidden by attribute, by display in an inline
style or by a closed <details> are dropped; text that visibility hides is, unless an element within is visible again, and what stands in for media or frames. Of an <svg> its texts are
read, of a <select> the options that it shows, of an <input> the value; placeholders and passwords are not. Blocks stand on lines of their own, paragraphs and headings
apart by a blank line; list items get markers and indents, preformatted text keeps its spaces, and the
cells of a table's columns, in the places that spans leave them, are padded to equal widths. Lists are indented for DEEPEST
levels and go on at that indent, or the spaces alone would grow with the square of the page.

Null or empty pages give an empty text and title. A quote opens a value only after an equals sign, so a
stray one ends nothing and opens nothing; a tag that never ends drops the rest, as browsers do.
Nesting may be of any depth; what a tag ends is found by its place, not by a walk, so time is in proportion to the page, but for tables within tables, whose lines each table around
them lays out again, and for cells that many rows hold. Each page is read whole; pages are independent, so nothing is shuffled.
Repeated rows are rendered alike. An empty table gives an empty result. Columns other than the id, url
and html are ignored.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import prepare

_NAME = re.compile(r"[A-Za-z][^ \t\n\r\f/>]*+")
_GAP = r"[ \t\n\r\f]*+"
_KEY = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+"
_PLAIN = r"""[^ \t\n\r\f>"'][^ \t\n\r\f>]*+"""
#: Quotes open a value only after the equals sign of a name; elsewhere they are characters like any other.
_REST = re.compile(rf"""(?:[ \t\n\r\f/]++|{_KEY}(?:{_GAP}={_GAP}(?:"[^"]*+"|'[^']*+'|{_PLAIN}|(?=>))|(?!{_GAP}=)))*+>""")
_ATTRIBUTE = re.compile(rf"""({_KEY})(?:{_GAP}={_GAP}(?:"([^"]*+)"|'([^']*+)'|({_PLAIN}))?)?""")
#: An unquoted value to the end: its last stroke closes nothing.
_VALUE_LAST = re.compile(r"""=[ \t\n\r\f]*+[^ \t\n\r\f>"']++$""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
#: Columns and rows that a cell spans at most, by the HTML standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

#: Levels of lists and quotations that are indented; deeper ones stay at that indent.
DEEPEST = 24

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript annotation annotation-xml title meta link base iframe noembed noframes object audio video canvas datalist area param source track".split())
#: Input types whose value is not shown as text.
MUTE = frozenset("hidden password checkbox radio range color file image".split())
#: In <svg>, what is not drawn in place; in <svg> and <math>, HTML elements that end them, and elements that hold HTML.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker lineargradient radialgradient filter desc metadata".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure hr fieldset".split())
BLOCKS = APART | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup legend li main nav search section summary caption".split())
#: A start tag ends the open elements named here, up to the boundary named after them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_CLOSES_P = BLOCKS - {"html", "body", "caption", "li", "dd", "dt"} | {"li", "dd", "dt"}
_SCOPE = frozenset("table td th caption html object template".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """An attribute's value; empty if it has none, None if it isn't there."""
        for k, *values in _ATTRIBUTE.findall(self.attributes):
            if k.lower() == name:
                return html.unescape("".join(values))
        return None


class Builder:
    """Open elements from the root on."""

    def __init__(self):
        self.root = Node("#root")
        self.open = [self.root]
        self.foreign = [0]  # for each open element, the place of the <svg> or <math> that its children are in; 0 in HTML
        self.places: dict[str, list[int]] = {}  # of open elements, by tag

    def _last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _drop(self, i: int) -> None:
        """End the open elements from i on."""
        for node in self.open[i:]:
            self.places[node.tag].pop()
        del self.open[i:], self.foreign[i:]

    def text(self, data: str) -> None:
        if data:
            data = html.unescape(data) if "&" in data else data
            if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
                self._drop(len(self.open) - 1)
            self.open[-1].children.append(data)

    def _close(self, inner: set[str], until: frozenset[str] | set[str]) -> None:
        """End the open elements of inner that are within until, and all in them."""
        bound = self._last(*until)
        while (at := self._last(*inner)) > bound:
            self._drop(at)

    def start(self, tag: str, attributes: str) -> bool:
        """Whether the element is open now or void by its name, so that what follows is read by its rules."""
        if at := self.foreign[-1]:
            if tag in BREAKS_OUT:
                self._drop(at)
            elif attributes.endswith("/") and not _VALUE_LAST.search(attributes):
                self.open[-1].children.append(Node(tag, attributes))
                return False
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in _CLOSES_P:
            self._close({"p"}, _SCOPE)
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.start("tr", "")
        if tag not in UNSEEN and tag not in ("head", "html") and self.open[-1].tag == "head":
            self._drop(len(self.open) - 1)
        node = Node(tag, attributes)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.foreign.append(len(self.open) if tag in ("svg", "math") else 0 if tag in HOLDS_HTML else self.foreign[-1])
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)
        return True

    def end(self, tag: str) -> None:
        if tag == "p" and not self._last("p"):
            self.start("p", "")
        if tag == "br":
            self.start("br", "")
            return
        at = self._last(tag)
        if at > (0 if tag in ("table", "html", "body") else self._last("table")):
            self._drop(at)


def parse(page: str) -> Node:
    builder, at, n = Builder(), 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            builder.text(page[at:])
            break
        if page.startswith("<!--", less):
            builder.text(page[at:less])
            stop = page.find("-->", less + 4)
            at = n if stop < 0 else stop + 3
            continue
        mark = page[less + 1 : less + 2]
        if mark in ("!", "?"):
            builder.text(page[at:less])
            stop = page.find(">", less)
            at = n if stop < 0 else stop + 1
            continue
        ends = mark == "/"
        name = _NAME.match(page, less + 1 + ends)
        if not name:  # a lone sign is text
            builder.text(page[at : less + 1])
            at = less + 1
            continue
        builder.text(page[at:less])
        rest = _REST.match(page, name.end())
        if not rest:
            break
        at, tag = rest.end(), name[0].lower()
        if ends:
            builder.end(tag)
            continue
        attributes = page[name.end() : at - 1]
        if builder.start(tag, attributes) and tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            data = page[at : stop.start() if stop else n]
            if tag in ("title", "textarea"):
                builder.text(data)
            elif data:
                builder.open[-1].children.append(data)
            at = stop.start() if stop else n
    return builder.root


def styled(node: Node, what: str) -> str | None:
    """The value of display or visibility in an element's own style: the last one, or the last that is important."""
    if "style" not in node.attributes.lower():
        return None
    found = [(bool(important), i, value.lower()) for i, (name, value, important) in enumerate(_DECLARED.findall(node.get("style") or "")) if name.lower() == what]
    return max(found)[2] if found else None


def hidden(node: Node) -> bool:
    """Whether an element is left out with all that is in it."""
    if node.tag in UNSEEN:
        return True
    if node.attributes:
        if "hidden" in node.attributes.lower() and (node.get("hidden") is not None or (node.tag == "input" and (node.get("type") or "").lower() == "hidden")):
            return True
        if styled(node, "display") == "none":
            return True
    return node.tag == "dialog" and node.get("open") is None


def veiled(node: Node, outer: bool) -> bool:
    """Whether an element's own text is not seen: as visibility says, or else as around it."""
    own = styled(node, "visibility") if node.attributes else None
    return outer if own in (None, "inherit", "unset") else own in ("hidden", "collapse")


def drawn(svg: Node) -> list:
    """The texts of an <svg> in order, apart by spaces, and the HTML that it holds."""
    out, stack = [], svg.children[::-1]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or hidden(node) or node.tag in UNDRAWN:
            continue
        if node.tag in ("text", "foreignobject"):
            out += [" ", node, " "]
        else:
            stack += node.children[::-1]
    return out


def shown(select: Node) -> list:
    """The options of a <select> that are seen: all of a list box, the chosen or else first one of a closed menu."""
    options, stack = [], [(c, False) for c in select.children[::-1]]
    while stack:
        node, off = stack.pop()
        if isinstance(node, str) or hidden(node):
            continue
        off = off or node.get("disabled") is not None
        if node.tag in ("option", "optgroup"):
            options.append((node, off))
        if node.tag != "option":
            stack += [(c, off) for c in node.children[::-1]]
    size = select.get("size") or ""
    if select.get("multiple") is None and not (re.fullmatch("[0-9]{1,9}", size) and int(size) > 1):
        options = [x for x in options if x[0].tag == "option"]
        chosen = [x for x in options if x[0].get("selected") is not None][-1:]
        options = chosen or [x for x in options if not x[1]][:1] or options[:1]
    out = []
    for node, _ in options:
        label = node.get("label")
        out += [" ", *([label] if label else node.children if node.tag == "option" else []), " "]
    return out


class Flow:
    """Lines of text under way. gap: line breaks (2: a blank line) due before the next word."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.pre = 0, False, 0
        self.indents: list[str] = []
        self.marker: str | None = None

    def break_line(self, gap: int = 1) -> None:
        if self.line or self.lines:
            self.gap = max(self.gap, gap)
        self.space = False

    def _begin(self) -> None:
        if self.gap:
            if self.line:
                self.lines.append("".join(self.line).rstrip())
                self.line = []
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.line:
            indent = "".join(self.indents[:DEEPEST])
            if self.marker is not None:
                indent = "".join(self.indents[: min(DEEPEST, len(self.indents) - 1)]) + self.marker
                self.marker = None
            if indent:
                self.line.append(indent)
            self.space = False

    def write(self, text: str) -> None:
        if self.pre:
            for i, part in enumerate(text.split("\n")):
                if i:
                    self.new_line()
                if part:
                    self._begin()
                    self.line.append(part)
            return
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line and not self.gap)
            return
        lead = words[0] == " "
        fresh = bool(self.gap) or not self.line
        self._begin()
        if (lead or self.space) and not fresh:
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def new_line(self) -> None:
        """A line break by itself, so that two make an empty line."""
        if self.gap:
            self._begin()
        self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.break_line()
            self._begin()
            self.line.append(line)
            self.gap = 1

    def done(self) -> list[str]:
        out = [*self.lines, "".join(self.line).rstrip()] if self.line else self.lines
        full = [i for i, x in enumerate(out) if x]
        return out[full[0] : full[-1] + 1] if full else []


def span_of(node: Node, name: str, most: int) -> int:
    """Rows or columns that a cell spans; 0 rows are all that follow."""
    value = re.match(r"[ \t\n\r\f]*([0-9]+)", node.get(name) or "")
    n = min(int(value[1][:9]), most) if value else 1
    return n or (most if name == "rowspan" else 1)


class Grid:
    """A table's cells, by the column that each begins in. held: for each column, the row up to which a cell from above holds it."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.caption: list[str] = []
        self.held: dict[int, int] = {}
        self.next = 0

    def begin_row(self) -> None:
        self.rows.append([])
        self.next = 0
        self.held = {c: r for c, r in self.held.items() if r > len(self.rows) - 1}

    def put(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.begin_row()
        while self.next in self.held:
            self.next += 1
        columns, rows = span_of(node, "colspan", MOST_COLUMNS), span_of(node, "rowspan", MOST_ROWS)
        self.rows[-1].append((self.next, columns, lines))
        if rows > 1:
            self.held |= dict.fromkeys(range(self.next, self.next + columns), len(self.rows) - 1 + rows)
        self.next += columns

    def lines(self) -> list[str]:
        """Cells side by side, columns apart by two spaces and padded to their widest line. A column in which nothing begins has no width."""
        number = {c: i for i, c in enumerate(sorted({c for row in self.rows for c, _, _ in row}))}
        begins = list(number)
        widths = [0] * len(begins)
        wide = []
        for row in self.rows:
            for c, columns, cell in row:
                last = bisect.bisect_left(begins, c + columns) - 1
                width = max(map(len, cell), default=0)
                if last == number[c]:
                    widths[last] = max(widths[last], width)
                else:
                    wide.append((number[c], last, width))
        for i, last, width in wide:
            widths[last] = max(widths[last], width - sum(widths[i:last]) - 2 * (last - i))
        at = [0, *itertools.accumulate(w + 2 for w in widths)]
        out = list(self.caption)
        for row in self.rows:
            for k in range(max((len(cell) for _, _, cell in row), default=0)):
                line = ""
                for c, _, cell in row:
                    if k < len(cell) and cell[k]:
                        line = line.ljust(at[number[c]]) + cell[k]
                out.append(line.rstrip())
        return out


def render(root: Node) -> str:
    """The visible text of a tree. Walks with a stack of its own, so depth is no limit."""
    flows, grids, counters, veils = [Flow()], [], [], [False]
    stack: list = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not veils[-1]:
                flow.write(node)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node):
                continue
            veil = veiled(node, veils[-1])
            if tag == "br":
                flow.new_line() if flow.line or flow.lines else None
                continue
            if tag == "hr":
                flow.break_line(2)
                flow.block(["---"] * (not veil))
                flow.break_line(2)
                continue
            if tag == "input":
                if not veil and (node.get("type") or "text").lower() not in MUTE and node.get("value"):
                    flow.write(node.get("value"))
                continue
            if tag in BLOCKS:
                flow.break_line(2 if tag in APART and not (tag in ("ul", "ol", "menu") and counters) else 1)
            if tag == "table":
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].begin_row()
            elif tag in ("td", "th", "caption") and grids:
                flows.append(Flow())
            elif tag in ("ul", "menu", "dir"):
                counters.append(None)
            elif tag == "ol":
                start = node.get("start") or "1"
                counters.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
            elif tag == "li":
                marker = "- "
                if counters and counters[-1] is not None:
                    marker, counters[-1] = f"{counters[-1]}. ", counters[-1] + 1
                flow.indents.append(" " * len(marker))
                flow.marker = None if veil else marker
            elif tag in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif tag == "pre":
                flow.pre += 1
            veils.append(veil)
            stack.append((node, True))
            children = node.children
            if tag == "details" and node.get("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif tag == "svg":
                children = drawn(node)
            elif tag == "select":
                children = shown(node)
            stack.extend((c, False) for c in reversed(children))
            continue
        veils.pop()
        if tag in ("td", "th", "caption") and grids and len(flows) > 1:
            lines = flows.pop().done()
            if tag == "caption":
                grids[-1].caption = lines
            else:
                grids[-1].put(node, lines)
            continue
        if tag == "table" and grids:
            flows[-1].block(grids.pop().lines())
        elif tag in ("ul", "ol", "menu", "dir"):
            counters.pop()
        elif tag in ("li", "dd", "blockquote"):
            flow.indents.pop()
            flow.marker = None
        elif tag == "pre":
            flow.pre -= 1
        if tag in BLOCKS:
            flow.break_line(2 if tag in APART and not (tag in ("ul", "ol", "menu") and counters) else 1)
    return "\n".join(flows[0].done())


def title_of(root: Node) -> str:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "title":
            return _SPACES.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        if node.tag in ("#root", "html", "head"):
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, title and text of each page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles, texts = [], []
            for page in b.column(2):
                tree = parse(page.as_py() or "")
                titles.append(title_of(tree))
                texts.append(render(tree))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "title", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, title string, text string")
