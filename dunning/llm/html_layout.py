"""Visible text of HTML pages, laid out as a reader sees it.

A tokenizer feeds a tree builder that keeps the open elements, ends those whose end
tags may be left out (p, li, dt, dd, option, table parts), adds the table parts that may
be left out, and drops end tags that match nothing. As elements open and close, a
layout writes lines: paragraphs, headings, lists, tables and the like are set off by
a blank line, other blocks start a new line, list items get a bullet or their number (``start``,
``reversed`` and ``value`` are followed) and an indent, ``pre`` keeps its spaces, and the cells of a table are aligned
in columns: spanned columns and rows keep their place, and a line too wide for a column goes on below.
Elements that are not shown are left out: scripts, styles, templates, titles,
comments, ``hidden``, ``display:none``, ``visibility:hidden`` (but not what is ``visible`` inside), titles and descriptions
in drawings, the options of a closed list but the one chosen, inputs that show no text (password, checkbox, ...), audio, video,
canvas and objects' inner text, and the body of closed ``details``. Nothing else is: navigation and advertisements are
text too, and so is what only a style sheet or a script would hide, as these are not followed.

No step recurses, so any depth of nesting is read. Nulls and edges: null stays null;
an empty page or one that shows nothing gives an empty text; broken markup never fails (a
``<`` that starts no tag is text; an unclosed comment, script or tag takes the rest, as in browsers).
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dunning.llm.common import add_columns

# Element names with the same role.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template title xmp textarea".split())
NOT_SHOWN = frozenset("datalist iframe noembed noframes noscript object script style template title audio canvas video".split())
#: In drawings and formulas, what is not their text.
ASIDE = frozenset("annotation annotation-xml defs desc metadata symbol clippath mask marker pattern".split())
#: Set off by a blank line.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul xmp".split())
#: Start a new line.
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary textarea".split())
#: Their start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body html option optgroup caption legend textarea".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = CELLS | ROW_GROUPS | {"tr", "caption", "colgroup", "table"}
KEEPS_SPACE = frozenset(("pre", "listing", "textarea", "xmp"))
#: What an end tag may be left out before: element, and where the search for it stops.
IMPLIED_END = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (("option", "optgroup"), frozenset(("select",))),
}

#: Widest line of a cell that others follow in its row (wider ones go on below), and the space between columns.
WIDEST, GUTTER = 160, "  "
MAX_SPAN, MAX_ROWS = 100, 65534
#: Columns in which spans are followed; further right a cell takes one column of its own row.
MAX_COLUMNS = 1000

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"hidden|style|type|span|start|value|open|reversed|selected|multiple|size", re.I)
#: What counts the items of reversed lists: comments and raw text to pass over, and the tags of lists and items.
ITEMS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea)\b.*?(?:</\1|\Z)|<(/?)(ol|ul|menu|dir|li)(?=[\s/>])", re.I | re.S)
#: Types of inputs that show no value as text.
NO_TEXT = frozenset("hidden password checkbox radio file image color range".split())
CONCEALED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible|initial)\b", re.I)
WHOLE = re.compile(r"-?[0-9]{1,9}")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Layout:
    """Lines of one flow: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indents: list[str] = []
        self.marker = ""
        self.gap = False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            *whole, rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for part in whole:
                self.inline.append(part)
                self.end_line(keep=True)
            if rest:
                self.inline.append(rest)
            return
        text = SPACES.sub(" ", text)
        if text[:1] == " " and (not self.inline or self.inline[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.inline.append(text)

    def end_line(self, keep: bool = False) -> None:
        line = "".join(self.inline).replace("\xa0", " ")
        line = line.rstrip() if keep else line.strip(" ")
        self.inline = []
        if not line and not keep:
            return
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.indents)
        if self.marker:
            indent, self.marker = indent[: -len(self.marker)] + self.marker, ""
        self.lines.append((indent + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def result(self) -> list[str]:
        self.end_line()
        shown = [i for i, line in enumerate(self.lines) if line]
        return self.lines[shown[0] : shown[-1] + 1] if shown else []


def wrapped(lines: list[str]) -> list[str]:
    """Lines of at most ``WIDEST`` characters, cut at spaces where there are any."""
    out = []
    for line in lines:
        while len(line) > WIDEST:
            cut = line.rfind(" ", len(line) - len(line.lstrip(" ")), WIDEST + 1)
            out.append(line[: cut if cut > 0 else WIDEST])
            line = line[cut + 1 if cut > 0 else WIDEST :]
        out.append(line)
    return out


class Table:
    def __init__(self):
        self.rows: list[list[list[str]]] = []
        #: Columns that cells of rows above reach down to, and for how many more rows.
        self.hanging: dict[int, int] = {}

    def row(self) -> None:
        if self.rows:
            self.hanging = {c: n - (c >= len(self.rows[-1])) for c, n in self.hanging.items() if n > (c >= len(self.rows[-1]))}
        self.rows.append([])

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        row = self.rows[-1]
        while self.hanging.get(len(row), 0) > 0:
            self.hanging[len(row)] -= 1
            row.append([])
        for k in range(columns if len(row) + columns <= MAX_COLUMNS else 1):
            if rows > 1 and len(row) < MAX_COLUMNS:
                self.hanging[len(row)] = rows - 1
            row.append([] if k else lines)

    def lines(self) -> list[str]:
        rows = [[*map(wrapped, row[:-1]), *row[-1:]] for row in self.rows]
        widths: list[int] = []
        for row in rows:
            widths += [0] * (len(row) - len(widths))
            for i, cell in enumerate(row[:-1]):
                if cell:
                    widths[i] = max(widths[i], *map(len, cell))
        for row in rows:  # a last cell widens its column up to the same bound
            if row:
                widths[len(row) - 1] = max(widths[len(row) - 1], *(len(x) for x in row[-1] if len(x) <= WIDEST), 0)
        out = []
        for row in rows:
            for k in range(max(map(len, row), default=0)):
                parts = [cell[k] if k < len(cell) else "" for cell in row]
                out.append(GUTTER.join(p.ljust(w) for p, w in zip(parts, widths, strict=False) if w or p).rstrip())
        return out


class Page:
    """Tree builder: open elements as (name, whether it conceals, what to undo at its end, whether text was unseen before it).

    ``items``: for the place of a reversed list's tag, its items."""

    def __init__(self, items: dict[int, int]):
        self.flows = [Layout()]
        self.open: list[tuple[str, bool, object, bool]] = []
        self.count: Counter[str] = Counter()
        self.concealed = self.kept = 0
        self.unseen = False
        self.items, self.place = items, 0
        self.tables: list[Table] = []
        self.lists: list[list] = []
        self.choices: list[tuple[list, bool]] = []

    @property
    def flow(self) -> Layout:
        return self.flows[-1]

    def text(self, text: str) -> None:
        if text and not self.concealed and not self.unseen and not self._closed():
            self.flow.text(unescape(text) if "&" in text else text, self.kept > 0)

    def _closed(self) -> bool:
        """Directly in the body of closed details."""
        return bool(self.open) and self.open[-1][0] == "details" and self.open[-1][2] == "closed"

    def find(self, names: tuple[str, ...], stop: frozenset[str]) -> int | None:
        """Place of the nearest open element of these names, not beyond ``stop``."""
        if not any(self.count[n] for n in names):
            return None
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in names:
                return i
            if name in stop:
                return None
        return None

    def end_down_to(self, place: int | None) -> None:
        while place is not None and len(self.open) > place:
            self._end()

    def start(self, name: str, attributes: str) -> None:
        told = {}
        if attributes and TELLING.search(attributes):
            for m in ATTRIBUTE.finditer(attributes):
                told.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if name in ENDS_P and self.count["p"]:
            self.end_down_to(self.find(("p",), CELLS | {"table", "caption", "button"}))
        if name in IMPLIED_END:
            names, stop = IMPLIED_END[name]
            self.end_down_to(self.find(names, stop | CELLS | {"table"}))
        if name in TABLE_PARTS and name != "table":
            if not self.tables:
                return  # a table's part outside any table is dropped, its text is not
            self._table_part(name)
        drawn = self.count["svg"] or self.count["math"]
        concealing = name in NOT_SHOWN or drawn and name in ASIDE or "hidden" in told or CONCEALED.search(told.get("style", "")) is not None
        if name in VOID:
            seen = VISIBILITY.search(told.get("style", ""))
            if not self.concealed and not concealing and not (seen[1].lower() in ("hidden", "collapse") if seen else self.unseen):
                self._void(name, told)
            return
        self._open(name, told, bool(concealing))
        if drawn and attributes.rstrip().endswith("/"):
            self._end()  # an empty element of a drawing or formula

    def _table_part(self, name: str) -> None:
        inside = frozenset(("table",))
        if name in CELLS:
            self.end_down_to(self.find(("td", "th"), inside | {"tr"}))
            if self.find(("tr",), inside) is None:
                self._open("tr", {}, False)
        elif name == "tr":
            self.end_down_to(self.find(("tr",), inside))
        else:
            self.end_down_to(self.find(("caption", "colgroup", "tr", *ROW_GROUPS), inside))
            self.end_down_to(self.find(tuple(ROW_GROUPS), inside))
            self.tables[-1].hanging = {}  # no cell reaches into the next group of rows

    def _void(self, name: str, told: dict[str, str]) -> None:
        if name == "br":
            if self.flow.inline:
                self.flow.end_line()
        elif name == "hr":
            self.flow.block(True)
        elif name == "wbr":
            pass
        elif name == "input" and told.get("type", "text").lower() not in NO_TEXT:
            self.text(told.get("value", ""))

    def _open(self, name: str, told: dict[str, str], concealing: bool) -> None:
        undo, unseen = None, self.unseen
        if seen := VISIBILITY.search(told.get("style", "")):
            self.unseen = seen[1].lower() in ("hidden", "collapse")
        if name != "summary" and self._closed():
            concealing = True
        if concealing:
            self.concealed += 1
        elif not self.concealed:
            flow = self.flow
            if name in CELLS:
                self.flows.append(Layout())
                columns, rows = (int(s) if WHOLE.fullmatch(s := told.get(a, "")) else 1 for a in ("colspan", "rowspan"))
                undo = max(1, min(MAX_SPAN, columns)), min(MAX_ROWS, rows) if rows > 0 else MAX_ROWS if rows == 0 else 1
            elif name == "tr":
                if self.tables:
                    self.tables[-1].row()
            elif name == "table":
                flow.block(True)
                self.tables.append(Table())
                undo = len(self.flows)
            elif name in LISTS:
                flow.block(not self.lists)
                first = int(s) if WHOLE.fullmatch(s := told.get("start", "")) else self.items.get(self.place, 1)
                self.lists.append([name == "ol", first, -1 if "reversed" in told else 1])
                undo = True
            elif name == "li":
                flow.end_line()
                mark = "- "
                if self.lists and self.lists[-1][0]:
                    if WHOLE.fullmatch(s := told.get("value", "")):
                        self.lists[-1][1] = int(s)
                    mark = f"{self.lists[-1][1]}. "
                    self.lists[-1][1] += self.lists[-1][2]
                flow.indents.append(" " * len(mark))
                flow.marker, undo = mark, flow
            elif name == "select":
                self.choices.append(([], "multiple" in told or told.get("size", "1").strip() not in ("", "0", "1")))
                self.flows.append(Layout())
                undo = True
            elif name == "option" and self.choices:
                self.flows.append(Layout())
                undo = ("selected" in told,)
            elif name == "text" and self.count["svg"]:
                flow.block(False)
            elif name in ("dd", "blockquote"):
                flow.block(name in SPACED)
                flow.indents.append("    " if name == "dd" else "> ")
                undo = flow
            elif name in BLOCK:
                flow.block(name in SPACED)
            if name == "details":
                undo = "open" if "open" in told else "closed"
            if name in KEEPS_SPACE:
                self.kept += 1
                undo = "kept"
        self.open.append((name, concealing, undo, unseen))
        self.count[name] += 1

    def _end(self) -> None:
        name, concealing, undo, self.unseen = self.open.pop()
        self.count[name] -= 1
        if concealing:
            self.concealed -= 1
            return
        if self.concealed:
            return
        flow = self.flow
        if name in CELLS and undo is not None:
            cell = self.flows.pop().result()
            if self.tables and self.tables[-1].rows:
                self.tables[-1].cell(cell, *undo)
        elif name == "option" and undo:
            self.choices[-1][0].append((undo[0], " ".join(self.flows.pop().result())))
        elif name == "select" and undo:
            options, listed = self.choices.pop()
            loose = self.flows.pop().result()
            shown = options if listed else [x for x in options if x[0]][-1:] or options[:1]
            for line in [*loose, *(x for _, x in shown)]:
                if listed:
                    self.flow.end_line()
                self.flow.text(line, False)
        elif name == "text" and self.count["svg"]:
            flow.block(False)
        elif name == "table" and undo is not None:
            flow.end_line()
            lines = self.tables.pop().lines()
            for line in lines:
                flow.inline = [line]
                flow.end_line(keep=True)
            flow.gap = True
        elif name in LISTS and undo:
            flow.end_line()
            self.lists.pop()
            flow.gap = not self.lists
        elif isinstance(undo, Layout):
            undo.end_line()
            if undo.indents:
                undo.indents.pop()
            undo.marker = ""
            undo.gap = undo.gap or name in SPACED
        elif undo == "kept":
            if flow.inline:
                flow.end_line(keep=True)
            self.kept -= 1
            flow.gap = flow.gap or name in SPACED
        elif name in BLOCK:
            flow.block(name in SPACED)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif not self.count[name]:
            if name == "p":
                self.start("p", "")
                self._end()
        else:
            stop = frozenset(("table",)) if name in TABLE_PARTS else CELLS | {"table"}
            self.end_down_to(self.find((name,), stop - {name}))

    def result(self) -> str:
        self.end_down_to(0)
        return "\n".join(self.flow.result())


def reversed_items(html: str) -> dict[int, int]:
    """The number of items of every reversed list, by the place of its tag."""
    found: dict[int, int] = {}
    lists: list[int] = []
    for m in ITEMS.finditer(html) if re.search("reversed", html, re.I) else ():
        if m[3] is None:
            continue
        if m[3].lower() == "li":
            if lists and not m[2]:
                found[lists[-1]] += 1
        elif not m[2]:
            lists.append(m.start())
            found[m.start()] = 0
        elif lists:
            lists.pop()
    return {at: n for at, n in found.items() if re.match(r"<ol\b[^>]*\breversed\b", html[at : at + 1000], re.I)}


def visible_text(html: str | None) -> str | None:
    """What a page shows, line by line."""
    if html is None:
        return None
    page, at, n = Page(reversed_items(html)), 0, len(html)
    last = html.rfind(">")
    while at < n:
        less = html.find("<", at)
        if less < 0 or less > last:
            page.text(html[at:] if less < 0 else html[at:less])
            if less >= 0 and not re.match(r"</?[a-zA-Z!?]", html[less : less + 3]):
                page.text(html[less:])
            break
        page.text(html[at:less])
        if html.startswith("<!--", less):
            stop = html.find("-->", less + 2)
            at = n if stop < 0 else stop + 3
            continue
        m = TAG.match(html, less) or LOOSE_TAG.match(html, less)
        if m is None:
            if html[less + 1 : less + 2] in ("!", "?", "/"):
                stop = html.find(">", less)
                at = n if stop < 0 else stop + 1
            else:
                page.text("<")
                at = less + 1
            continue
        name, at, page.place = m[2].lower(), m.end(), less
        if m[1]:
            page.end(name)
            continue
        page.start(name, m[3])
        if name in KEEPS_SPACE and html.startswith(("\n", "\r\n"), at):
            at = html.index("\n", at) + 1  # a line end right after the tag is not shown
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            body = html[at : stop.start() if stop else n]
            if name not in NOT_SHOWN:
                page.text(body)
            at = n if stop is None else stop.start()
    return page.result()


def _kernel():
    return lambda pages: [pa.array([visible_text(p) for p in pages.to_pylist()], pa.string())]


def with_visible_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` and its pages' visible text."""
    return add_columns(df, html, [T.StructField(out, T.StringType())], _kernel)
