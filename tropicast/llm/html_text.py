"""Layout-aware rendering of web pages as text.

A page is read tag by tag into an open-element stack with implied ends (a paragraph ends where
a block begins, a list item at the next item, a cell at the next cell or row, everything open at the end of
its parent). Elements that are never shown, and those hidden by an attribute named hidden or by display or visibility in their inline
style, give nothing (aria-hidden hides from screen readers only); drawings give their text elements, formulas all but their
annotations, a drop-down list the option it shows and any other list all options; everything
else gives its text: blocks on lines of their own, paragraphs and headings set off by an empty line, list
items behind a dash or a number and indented by depth, preformatted text as it is, and
the cells of a table in aligned columns.

The renderer is a small helper; Spark deals out the pages, and no page needs another one.

Defined results: a NULL page has the text NULL, an empty one the empty text; text outside any tag is shown; an
unclosed tag or comment at the end of a page is text left out; unknown tags are inline; rows that repeat are rendered each; an
empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title meta link template noscript noembed noframes iframe datalist object audio "
                   "video canvas annotation annotation-xml".split())
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())  # in svg
# Tags that end an open svg or math element
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol "
                     "p pre ruby s small span strong strike sub sup table tt u ul var".split())
BLOCKS = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul search "
                   "caption thead tbody tfoot tr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
# A start tag of the key ends the open elements named, up to one of the limits
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("optgroup", "option"), ("select",)),
    "body": (("head",), ()),
}
P_LIMITS = frozenset("td th caption table button object html".split())
P_ENDERS = BLOCKS - frozenset("body html caption thead tbody tfoot tr legend".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INTEGER = re.compile(r"\s*([-+]?\d+)")
MAX_SPAN = 1000  # the standard's own limit


def _parsed(attributes: str) -> dict[str, str]:
    """Values by lower-case name; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _integer(value: str | None) -> int | None:
    found = _INTEGER.match(value or "")
    return int(found[1]) if found else None


def _hidden(attributes: dict[str, str]) -> bool:
    if not attributes:
        return False
    style: dict[str, str] = {}
    for part in re.sub(r"/\*.*?\*/", "", attributes.get("style", ""), flags=re.S).split(";"):
        name, _, value = part.partition(":")
        style[name.strip().lower()] = value.lower().replace("!important", "").strip()
    if style.get("visibility") in ("hidden", "collapse"):
        return True
    # a display of its own outweighs the attribute
    return style["display"] == "none" if style.get("display") else "hidden" in attributes


class _Flow:
    """Lines of one box: inline text is gathered and collapsed, blocks begin new lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.mark = ""

    def flush(self, indent: str = "") -> None:
        if self.inline:
            text = "".join(self.inline)
            self.inline = []
            rows = [" ".join(x.split()) for x in text.split("\n")] if "\n" in text else [" ".join(text.split())]
            while rows and not rows[-1]:
                rows.pop()
            if rows:
                self.put(rows, indent)

    def put(self, rows: list[str], indent: str = "") -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead, self.mark = self.mark, ""
        for i, row in enumerate(rows):
            space = indent + (lead if i == 0 else " " * len(lead))
            self.lines.append((space + row).rstrip() if row else "")


class _Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []
        self.captions: list[str] = []

    def lines(self) -> list[str]:
        """Cells in columns as wide as their widest line; a cell over several columns takes them all."""
        width: dict[int, int] = {}
        for row in self.rows:
            at = 0
            for cell, span in row:
                if span == 1:
                    width[at] = max(width.get(at, 0), max(map(len, cell), default=0))
                at += span
        out = list(self.captions)
        for row in self.rows:
            height = max((len(c) for c, _ in row), default=0)
            for i in range(height):
                line, at, end = "", 0, 0
                for cell, span in row:
                    line = line.ljust(end)
                    line += cell[i] if i < len(cell) else ""
                    end = max(end, 0) + sum(width.get(at + s, 0) + 2 for s in range(min(span, MAX_SPAN)))
                    at += span
                    line = line if len(line) < end else line + "  "
                out.append(line.rstrip())
        return out


class _Renderer:
    def __init__(self):
        self.stack: list[tuple[str, bool]] = []  # name, whether it is shown
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []  # kind, next number
        self.pre = 0
        self.foreign = 0  # open svg and math elements
        self.selects: list[tuple[bool, list[list]]] = []  # whether all options show; selected, disabled, label, text of each

    @property
    def shown(self) -> bool:
        return self.stack[-1][1] if self.stack else True

    def indent(self) -> str:
        return "  " * max(0, len(self.lists) - 1)

    def text(self, raw: str) -> None:
        if not self.shown:
            return
        flow = self.flows[-1]
        value = html.unescape(raw) if "&" in raw else raw
        if self.selects:
            if self.inside("option", "select") == "option" and self.selects[-1][1]:
                self.selects[-1][1][-1][3] += value
            return
        if self.foreign and self.inside("svg", "text", "foreignobject") == "svg":
            return
        if self.pre:
            flow.flush(self.indent())
            rows = value.expandtabs(8).split("\n")
            flow.put(rows)
        elif value.isspace():
            if flow.inline:
                flow.inline.append(" ")
        else:
            flow.inline.append(" ".join(value.split("\n")) if "\n" in value else value)

    def inside(self, *names: str) -> str | None:
        """The innermost open element of ``names``."""
        return next((n for n, _ in reversed(self.stack) if n in names), None)

    def start(self, name: str, written: str) -> None:
        attributes = _parsed(written) if written else {}
        within = self.inside("svg", "math", "foreignobject") if self.foreign else None
        if within in ("svg", "math") and name in BREAKOUT:
            self.end_open((within,), ())
            within = None
        if name in ENDS:
            ended, limits = ENDS[name]
            self.end_open(ended, limits)
        if name in P_ENDERS:
            self.end_open(("p",), P_LIMITS)
        shown = self.shown and name not in UNSEEN and not _hidden(attributes) and not (within == "svg" and name in UNDRAWN)
        flow = self.flows[-1]
        if name == "br":
            if shown:
                flow.inline.append("\n")
            return
        if name in VOID:
            if name == "hr" and shown:
                flow.flush(self.indent())
                flow.gap = True
            return
        if (within in ("svg", "math") or name in ("svg", "math")) and written.endswith("/"):
            return
        self.stack.append((name, shown))
        self.foreign += name in ("svg", "math")
        if not shown:
            return
        if name == "select":
            self.selects.append(("multiple" in attributes or (_integer(attributes.get("size")) or 1) > 1, []))
        elif name == "option" and self.selects:
            self.selects[-1][1].append(["selected" in attributes, "disabled" in attributes, attributes.get("label", ""), ""])
        elif name == "textarea" or name == "text" and within == "svg":
            flow.flush(self.indent())
            self.pre += name == "textarea"
        elif name in ("mtr", "mtd") and within == "math":
            flow.inline.append("\n" if name == "mtr" else " ")
        if name in BLOCKS:
            flow.flush(self.indent())
            flow.gap |= name in SPACED and not (name in ("ul", "ol") and self.lists)
        if name in ("ul", "ol", "menu"):
            begin = _integer(attributes.get("start"))
            self.lists.append([name, 1 if begin is None else begin])
        elif name == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            if kind[0] == "ol":
                value = _integer(attributes.get("value"))
                kind[1] = kind[1] if value is None else value
                flow.mark = f"{kind[1]}. "
                kind[1] += 1
            else:
                flow.mark = "- "
        elif name == "dd":
            flow.mark = "  "
        elif name == "pre":
            self.pre += 1
        elif name == "table":
            self.tables.append(_Table())
        elif name == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif name in ("td", "th", "caption") and self.tables:
            span = _integer(attributes.get("colspan"))
            self.flows.append(_Flow())
            self.stack[-1] = (name, True)
            self.spans = getattr(self, "spans", [])
            self.spans.append(min(MAX_SPAN, max(1, span or 1)))

    def end_open(self, names: tuple, limits) -> None:
        """End the innermost open element of ``names``, with all inside it, if no limit stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                self.close_to(i)
                if len(names) > 1:
                    self.end_open(names, limits)
                return
            if self.stack[i][0] in limits:
                return

    def end(self, name: str) -> None:
        if name == "p" and all(n != "p" for n, _ in self.stack):
            self.flows[-1].flush(self.indent())
            return
        limits = ("td", "th", "caption", "table") if name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "body", "html") else ()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.close_to(i)
                return
            if self.stack[i][0] in limits or self.stack[i][0] == "table" and name != "table" and name not in ("body", "html"):
                if name in ("tr", "tbody", "thead", "tfoot", "td", "th", "caption") and self.stack[i][0] != "table":
                    continue
                return

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, shown = self.stack.pop()
            self.foreign -= name in ("svg", "math")
            if not shown:
                continue
            flow = self.flows[-1]
            if name == "select":
                every, options = self.selects.pop()
                if not every:
                    options = ([o for o in options if o[0]] or [o for o in options if not o[1]][:1])[-1:]
                flow.inline.append("\n".join(" ".join((o[2] or o[3]).split()) for o in options))
            elif name == "textarea" or name == "text" and self.inside("svg", "foreignobject") == "svg":
                flow.flush(self.indent())
                self.pre -= name == "textarea"
            if name in ("td", "th", "caption") and self.tables and len(self.flows) > 1:
                flow.flush()
                self.flows.pop()
                span = self.spans.pop()
                table = self.tables[-1]
                while flow.lines and not flow.lines[-1]:
                    flow.lines.pop()
                if name == "caption":
                    table.captions += flow.lines
                else:
                    if not table.rows:
                        table.rows.append([])
                    table.rows[-1].append((flow.lines, span))
                continue
            if name in BLOCKS:
                flow.flush(self.indent())
            if name == "pre":
                self.pre -= 1
            if name in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
            if name == "li":
                flow.mark = ""
            if name == "table" and self.tables:
                lines = self.tables.pop().lines()
                if lines:
                    flow.put(lines, self.indent())
            flow.gap |= name in SPACED and not (name in ("ul", "ol") and self.lists)


def render(page: str) -> str:
    """Visible text of one page."""
    out, at, size = _Renderer(), 0, len(page)
    match = _TOKEN.search
    while at < size:
        found = match(page, at)
        if found is None:
            rest = page[at:]
            broken = re.search(r"<[/a-zA-Z][^>]*\Z", rest)
            out.text(rest[:broken.start()] if broken else rest)
            break
        if found.start() > at:
            out.text(page[at:found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            out.end(name)
            continue
        out.start(name, found[3].strip())
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else size
            # the line end after the tag is not part of a text field
            out.text(re.sub(r"\A\r?\n", "", page[at:stop]) if name == "textarea" else page[at:stop])
            if not close:
                break
            at = stop
    out.close_to(0)
    flow = out.flows[0]
    flow.flush()
    return "\n".join(flow.lines).strip("\n")


def _rendered(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([render(p) if isinstance(p, str) else None for p in batch], dtype=object)


def extract(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """Add the visible text of every page."""
    return pages.withColumn(text_column, F.pandas_udf(_rendered, "string")(F.col(html_column)))


def op8_html(pages: DataFrame) -> DataFrame:
    """Visible text of every page."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text")
