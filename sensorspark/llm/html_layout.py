"""Visible text of web pages, laid out as a reader sees it.

A tree is built from the tags, with the ones that authors leave out implied (a paragraph ends where a
block begins, a list item at the next one, a cell at the next cell or row, the head at the first
visible element).  Scripts, styles, the head, closed dialogs, what a closed ``details`` folds away, what
stands in for media, elements hidden by attribute or style, and the parts of drawings and formulas that
are never drawn (``UNDRAWN``) are left out; all other text is kept.  ``display`` hides a whole element;
``visibility`` is inherited, so that an element inside may be shown again.  Blocks start on new lines,
paragraphs, headings, lists and tables are set apart by a blank line, list items carry their bullet or
number and are indented by depth, tables are laid out in aligned columns, and preformatted text keeps its
blanks.

A cell is wrapped at ``CELL_WIDTH`` characters unless its column is the last one; a longer word stays
whole and pushes the rest of its line on.  No column starts beyond ``TABLE_WIDTH`` and no line is indented
by more than ``LEVELS`` lists, so that a line holds a bounded number of blanks a table level, however wide
or deep a page is.

Nothing recurses on the page's depth except tables inside tables, which are laid out as plain blocks
beyond ``MAX_TABLES`` levels.  Work is linear in the page but for padding.

Defined results: a null, empty or tagless page gives its text with blanks collapsed (empty for null);
unclosed comments, scripts and tags run to where a browser would end them or to the end; rows repeat
as in the input; any ``page_id`` is allowed, null too; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TABLES = 20
CELL_WIDTH, TABLE_WIDTH = 60, 240
LEVELS = 20
# Fixed values of the markup language: the largest numbers of columns and rows of a cell.
MAX_COLUMNS, MAX_ROWS = 1000, 65_534

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title noscript template iframe noembed noframes object datalist audio video canvas meter"
    " progress rp".split()
)
# Inside svg and math: what is never drawn, where markup of the page begins again, and what ends the drawing.
UNDRAWN = frozenset(
    "title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter"
    " annotation annotation-xml".split()
)
FOREIGN = frozenset(("svg", "math"))
# Stand at places of their own, hence apart from the text around.
PLACED = frozenset(("text", "foreignobject", "mtd"))
PAGE_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_DRAWING = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta"
    " nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HEAD = frozenset("base link meta script style title noscript template head html".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table ul"
    " caption thead tbody tfoot tr td th legend".split()
)
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
LISTS = frozenset(("ul", "ol", "menu", "dir"))
# What the start of an element ends, and what an open element shields from that.
IMPLIED = {
    "li": (frozenset(("li",)), LISTS | {"table"}),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "table"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select", "table"))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tr": (frozenset(("td", "th", "tr", "caption")), frozenset(("table",))),
    **{
        t: (frozenset(("td", "th", "tr", "thead", "tbody", "tfoot", "caption")), frozenset(("table",)))
        for t in ("thead", "tbody", "tfoot")
    },
}
SHIELDS = frozenset(("table", "td", "th", "caption", "button", "object", "template"))

TOKEN = re.compile(
    r"<!--(?P<note>.*?)(?:-->|\Z)|<[!?][^>]*>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)",
    re.DOTALL,
)
# The next attribute of a tag, up to an opening quote, or the tag's end.
ATTRIBUTE = re.compile(
    r"(?P<skip>[\s/]*+)(?:(?P<close>>)|(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(?P<quote>[\"'])|(?P<value>[^\s>]*+)))?+)"
)
# What is no declaration in a style: comments and strings, then arguments.
ASIDE = re.compile(r"/\*.*?(?:\*/|\Z)|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)", re.DOTALL)
ARGUMENTS = re.compile(r"\([^)]*+(?:\)|\Z)")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs or {}, [], foreign


def attributes(html: str, at: int, gone: set[str]) -> tuple[dict[str, str], bool, int]:
    """The values by name of the start tag whose name ends at ``at`` (the first of a name counts), whether a slash
    ends the tag, and its end.

    A quoted value is read whole, however long.  ``gone`` keeps the quotes that do not come again, and ``>``
    once none comes outside quotes: such a tag ends at the next ``>``, which every tag has, so that no part
    of a page is searched in vain more than once.
    """
    found: dict[str, str] = {}
    start = at
    while ">" not in gone and (part := ATTRIBUTE.match(html, at)):
        at = part.end()
        if part["close"]:
            return found, part["skip"].endswith("/"), at
        name, value, quote = part["name"].lower(), part["value"] or "", part["quote"]
        if quote:
            end = html.find(quote, at) if quote not in gone else -1
            if end < 0:
                gone.add(quote)
                end = html.find(">", at)
                if end < 0:
                    break
                return {name: html[at:end]} | found, False, end + 1
            value, at = html[at:end], end + 1
        found.setdefault(name, value)
    gone.add(">")
    end = html.index(">", start) + 1
    return *attributes(html[start:end], 0, set())[:2], end


def number(attrs: dict[str, str], name: str) -> int | None:
    found = re.match(r"\s*(-?[0-9]{1,9})", unescape(attrs.get(name, "")))
    return int(found[1]) if found else None


def declared(style: str) -> dict[str, str]:
    """The values of ``display`` and ``visibility`` that win."""
    won: dict[str, tuple[bool, str]] = {}
    for declaration in ARGUMENTS.sub(" ", ASIDE.sub(" ", unescape(style))).lower().split(";"):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        name, important = name.strip(), bool(mark)
        if name in ("display", "visibility") and (important or not won.get(name, (False,))[0]):
            won[name] = (important, value.strip())
    return {name: value for name, (_, value) in won.items()}


class Builder:
    """The tree of a page."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def _cut(self, at: int) -> None:
        for node in self.stack[at:]:
            self.open[node.tag] -= 1
        del self.stack[at:]

    def _end(self, tags: frozenset, shields: frozenset) -> None:
        """Ends the outermost open element of ``tags`` that no shield covers."""
        if not any(self.open.get(t) for t in tags):
            return
        lowest = None
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                lowest = k
            elif tag in shields:
                break
        if lowest is not None:
            self._cut(lowest)

    def _leave_head(self) -> None:
        if self.open.get("head"):
            self._end(frozenset(("head",)), frozenset())

    def text(self, text: str) -> None:
        if text:
            if self.open.get("head") and self.stack[-1].tag == "head" and not text.isspace():
                self._leave_head()
            self.stack[-1].children.append(text)

    def drawing(self) -> bool:
        """Whether the next element belongs to a drawing or formula."""
        return self.stack[-1].foreign and self.stack[-1].tag not in PAGE_AGAIN

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if tag == "html":
            return
        if tag in ENDS_DRAWING:
            keep = len(self.stack)
            while self.stack[keep - 1].foreign and self.stack[keep - 1].tag not in PAGE_AGAIN:
                keep -= 1
            self._cut(keep)
        if self.drawing() or tag in FOREIGN:
            self._leave_head()
            node = Node(tag, attrs, True)
            self.stack[-1].children.append(node)
            if not closed:
                self.stack.append(node)
                self.open[tag] = self.open.get(tag, 0) + 1
            return
        if tag not in HEAD:
            self._leave_head()
        if tag == "body":
            return
        if tag in ENDS_PARAGRAPH:
            self._end(frozenset(("p",)), SHIELDS)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif self.open.get(tag):
            shields = frozenset() if tag in ("table", "body", "html") else frozenset(("table",))
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._cut(k)
                    return
                if self.stack[k].tag in shields:
                    return


def parse(html: str) -> Node:
    builder, at, last = Builder(), 0, html.rfind(">") + 1
    gone: set[str] = set()
    while True:
        found = TOKEN.search(html, at, last) if at < last else None
        if found is None and at < len(html) and (note := html.find("<!--", max(at, last))) >= 0:
            # A comment that nothing ends hides the rest.
            builder.text(unescape(html[at:note]))
            return builder.root
        if found is None:
            builder.text(unescape(html[at:]))
            return builder.root
        builder.text(unescape(html[at : found.start()]))
        if builder.drawing() and html.startswith("<![CDATA[", found.start()):
            end = html.find("]]>", found.start())
            builder.text(html[found.start() + 9 : end if end >= 0 else len(html)])
            at = end + 3 if end >= 0 else len(html)
            continue
        at = found.end()
        if found["note"] is not None and not found[0].endswith("-->"):
            return builder.root
        if found["end"]:
            builder.end(found["end"].lower())
        elif found["start"]:
            tag = found["start"].lower()
            attrs, closed, at = attributes(html, at, gone)
            drawing = builder.drawing()
            builder.start(tag, attrs, closed)
            # In a drawing only scripts and styles are raw, and a slash ends them.
            if tag in RAW and not (drawing and (closed or tag not in ("script", "style"))):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                inner = html[at : close.start() if close else len(html)]
                if tag in ("textarea", "xmp"):
                    builder.text(unescape(inner) if tag == "textarea" else inner)
                builder.end(tag)
                at = close.end() if close else len(html)


class Writer:
    """Lines of text with pending breaks and the prefixes of open list items."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.prefixes: list[list] = []

    def _prefix(self) -> str:
        out = ""
        for level in self.prefixes[:LEVELS]:
            out += level[1] if level[2] else level[0]
            level[2] = True
        # Deeper levels show their markers only; those still to be shown are the last ones.
        fresh = len(self.prefixes)
        while fresh > LEVELS and not self.prefixes[fresh - 1][2]:
            fresh -= 1
        for level in self.prefixes[max(fresh, LEVELS) :]:
            out += level[0].lstrip()
            level[2] = True
        return out

    def put(self, line: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self._prefix() + line).rstrip())

    def flush(self) -> None:
        line = BLANKS.sub(" ", "".join(self.parts)).strip(" ").replace("\xa0", " ")
        self.parts.clear()
        if line:
            self.put(line)

    def breaks(self, size: int) -> None:
        self.flush()
        self.gap = max(self.gap, size)

    def kept(self, text: str) -> None:
        """Preformatted text: its own lines and blanks."""
        first, *more = text.replace("\r\n", "\n").expandtabs().split("\n")
        self.parts.append(first)
        for line in more:
            self.put("".join(self.parts))
            self.parts[:] = [line]


def shown(node: Node, seen: bool) -> bool | None:
    """Whether an element's own text is seen, given that of its parent; None if it has no box at all."""
    if node.tag in HIDDEN or node.foreign and node.tag in UNDRAWN:
        return None
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return None
    won = declared(node.attrs["style"]) if "style" in node.attrs else {}
    if node.foreign:
        won = {k: node.attrs[k].strip().lower() for k in ("display", "visibility") if k in node.attrs} | won
    display = won.get("display")
    closed = "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs
    if display == "none" or closed and not display:
        return None
    return {"visible": True, "initial": True, "hidden": False, "collapse": False}.get(won.get("visibility", ""), seen)


def unfolded(node: Node) -> list:
    """An element's children; of a closed ``details`` its first summary only."""
    if node.tag != "details" or "open" in node.attrs:
        return node.children
    return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]


def _write(root: Node, tables: int, seen: bool = True) -> list[str]:
    out = Writer()
    # (node, its children, next child, list counter, whether text is seen); a counter is None outside ordered lists.
    stack: list[list] = [[root, root.children, 0, None, seen]]
    pre = 0
    while stack:
        frame = stack[-1]
        node, children, k, _, seen = frame
        if k == len(children):
            stack.pop()
            if node is not root:
                pre -= _leave(out, node)
            continue
        frame[2] += 1
        child = children[k]
        if isinstance(child, str):
            if pre and seen:
                out.kept(child)
            elif not pre:
                out.parts.append(child if seen else " ")
            continue
        own = shown(child, seen)
        if own is None:
            continue
        if child.tag == "table" and tables < MAX_TABLES:
            out.breaks(2)
            for line in table_lines(child, tables + 1, own):
                out.put(line)
            out.breaks(2)
            continue
        if child.tag == "br":
            if out.parts:
                out.flush()
            else:
                out.gap = max(out.gap, 2 if out.lines else 0)
            continue
        pre += _enter(out, child, frame, own)
        counter = None
        if child.tag == "ol":
            start = number(child.attrs, "start")
            counter = 1 if start is None else start
        stack.append([child, unfolded(child), 0, counter, own])
    out.flush()
    return out.lines


def _enter(out: Writer, node: Node, parent: list, seen: bool) -> int:
    if node.tag in BLOCK:
        nested = node.tag in LISTS and out.prefixes
        out.breaks(2 if node.tag in APART and not nested else 1)
    if node.tag == "li":
        marker = "- "
        if parent[3] is not None:
            value = number(node.attrs, "value")
            parent[3] = parent[3] if value is None else value
            marker = f"{parent[3]}. "
            parent[3] += 1
        out.prefixes.append([marker, " " * len(marker), not seen])
    elif node.tag in ("dd", "blockquote"):
        out.prefixes.append(["    ", "    ", False])
    elif node.tag in ("td", "th") or node.foreign and node.tag in PLACED:
        out.parts.append(" ")
    return node.tag == "pre"


def _leave(out: Writer, node: Node) -> int:
    if node.tag == "pre":
        # A line break before the end tag is no line of its own.
        last = "".join(out.parts).rstrip()
        out.parts.clear()
        if last:
            out.put(last)
    if node.tag in BLOCK:
        out.breaks(1)
    if node.tag in ("li", "dd", "blockquote"):
        out.prefixes.pop()
    elif node.foreign and node.tag in PLACED:
        out.parts.append(" ")
    if node.tag in BLOCK:
        out.breaks(2 if node.tag in APART and not (node.tag in LISTS and out.prefixes) else 1)
    return node.tag == "pre"


def table_lines(table: Node, tables: int, seen: bool = True) -> list[str]:
    """Caption, rows in aligned columns; what stands between the cells comes before the rows."""
    loose, caption, groups = Node("div"), [], [[]]
    stack = [(iter(table.children), seen)]
    while stack:
        children, seen = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            continue
        if isinstance(child, str):
            if seen:
                loose.children.append(child)
            continue
        own = shown(child, seen)
        if own is None:
            continue
        if child.tag == "caption":
            caption += _write(child, tables, own)
        elif child.tag in ("thead", "tbody", "tfoot"):
            groups.append([])
            stack.append((iter(child.children), own))
        elif child.tag == "tr":
            groups[-1].append([])
            stack.append((iter(child.children), own))
        elif child.tag in ("td", "th"):
            if not groups[-1]:
                groups[-1].append([])
            wide = min(max(number(child.attrs, "colspan") or 1, 1), MAX_COLUMNS)
            deep = number(child.attrs, "rowspan")
            deep = 1 if deep is None or deep < 0 else min(deep, MAX_ROWS)
            groups[-1][-1].append((_write(child, tables, own), wide, deep))
        elif child.tag not in ("colgroup", "col"):
            # Shown or not by its own place in the tree.
            loose.children.append(child if seen else Node("span", {"style": "visibility:hidden"}))
            if not seen:
                loose.children[-1].children.append(child)
    return caption + _write(loose, tables) + aligned(groups)


def wrapped(line: str) -> list[str]:
    """A line in pieces of at most ``CELL_WIDTH`` characters, longer words whole."""
    out, at, end = [], 0, len(line)
    while end - at > CELL_WIDTH:
        lead = at
        while line[lead] == " ":
            lead += 1
        cut = line.rfind(" ", lead, at + CELL_WIDTH + 1)
        if cut < 0:
            cut = line.find(" ", max(lead, at + CELL_WIDTH))
        if cut < 0:
            break
        out.append(line[at:cut].rstrip())
        at = cut + 1
        while at < end and line[at] == " ":
            at += 1
    return [*out, line[at:]] if at < end or not out else out


def aligned(groups: list[list[list[tuple[list[str], int, int]]]]) -> list[str]:
    """Groups of rows of cells (lines, columns, rows) as lines whose columns start at the same place.

    A cell of zero rows reaches to the end of its group, and no cell reaches beyond it.
    """
    placed = []
    for rows in groups:
        # Columns taken by a cell of a row above: the row that is free again, and the column after the cell.
        taken: dict[int, tuple[int, int]] = {}
        for r, cells in enumerate(rows):
            column, own = 0, []
            for lines, wide, deep in cells:
                while column in taken and taken[column][0] > r:
                    column = taken[column][1]
                own.append((column, wide, lines))
                if deep != 1:
                    free = r + deep if deep else len(rows)
                    for c in range(column, column + wide):
                        taken[c] = (free, column + wide)
                column += wide
            placed.append(own)
    last = max((column + wide for own in placed for column, wide, _ in own), default=0)
    placed = [
        [
            (column, wide, lines if column + wide == last else [x for line in lines for x in wrapped(line)])
            for column, wide, lines in own
        ]
        for own in placed
    ]
    widths: dict[int, int] = {}
    for own in placed:
        for column, wide, lines in own:
            if wide == 1:
                longest = min(max(map(len, lines), default=0), CELL_WIDTH)
                widths[column] = max(widths.get(column, 0), longest)
    for own in placed:
        for column, wide, lines in own:
            if wide > 1:
                held = sum(widths.get(c, 0) for c in range(column, column + wide)) + 2 * (wide - 1)
                lacking = min(max(map(len, lines), default=0), CELL_WIDTH) - held
                if lacking > 0:
                    widths[column + wide - 1] = widths.get(column + wide - 1, 0) + lacking
    used = sorted({c for own in placed for column, wide, _ in own for c in range(column, column + wide)})
    starts, at = {}, 0
    for c in used:
        starts[c] = min(at, TABLE_WIDTH)
        at += widths.get(c, 0) + 2
    out = []
    for own in placed:
        for k in range(max((len(lines) for _, _, lines in own), default=0)):
            parts, size = [], 0
            for column, _, lines in own:
                if k < len(lines) and lines[k]:
                    pad = max(starts[column] - size, 2 if size else 0)
                    parts += [" " * pad, lines[k]]
                    size += pad + len(lines[k])
            out.append("".join(parts).rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(_write(parse(html), 0)) if html else ""


def _render_all(pages: pd.Series) -> pd.Series:
    return pd.Series([render(x) for x in pages], dtype=object)


def rendered(html: Column) -> Column:
    return F.pandas_udf(_render_all, "string")(html)


def extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text) for every page."""
    return pages.select(key, rendered(F.col("html")).alias("text"))
