"""Visible text of web pages by a light layout: a tree builder with implied tags, visibility rules and block spacing.

A scanner turns a page into tags and texts. The builder opens and closes elements as browsers do where tags are left
out (paragraphs, list items, table cells), keeps a stack, and knows for each element whether it is shown. Beside the
stack it keeps the places of the open elements of each name, so a tag costs the same at any depth. The renderer
collapses white space, starts blocks on lines of their own with blank lines around paragraphs, marks list items, and pads
table cells so that the columns of a table line up, cells that span several columns or rows included.

Hidden are: elements that never show, `hidden`, `aria-hidden`, `display: none` (with all that is inside), `visibility: hidden`
(until an element inside is visible again), closed `<details>` but for their summary, and what rules of `<style>` with a
single selector of a tag, a class, an id or a tag with one of these set so, if they hold on any screen (rules for print or for
screens of some size don't count). Of a `<select>` the chosen option shows.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, table

#: Names of elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object svg math audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form header html legend li main menu nav section summary tr caption thead tbody tfoot".split())
#: An opening tag ends these open elements, up to the elements that bound the search.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
CLOSES_P = BLOCK - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "legend", "summary"}
SCOPES = frozenset("table td th caption button".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>\"']*)", re.S)
_TAG_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"<!--|<style(?=[\s/>])", re.I)
_SHEET = re.compile(r"\"(?:[^\"\\\n]|\\.)*(?:\"|\n|\Z)|'(?:[^'\\\n]|\\.)*(?:'|\n|\Z)|[{};]", re.S)
_MEDIA = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+print)", re.I)
_MEDIA_OF = re.compile(r"\bmedia\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: At-rules whose rules count as those around them do; rules inside others say nothing of elements.
_GROUPS = ("@supports", "@layer")
_SELECTOR = re.compile(r"([A-Za-z][A-Za-z0-9-]*)?(?:([.#])([A-Za-z0-9_-]+))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
#: Cells of a row reach so many columns at most, as in browsers.
MOST_SPAN = 1000
#: A table whose aligned lines would be so many times longer than its text isn't aligned: cells that span many rows push others ever farther.
MOST_PADDING = 50
#: Lists are indented so many levels deep at most.
MOST_INDENT = 20


def declared(style: str) -> tuple[bool | None, bool | None]:
    """What declarations say of display (shown or not) and visibility; None where they say nothing."""
    d, v = _DISPLAY.search(style), _VISIBILITY.search(style)
    return (None if not d else d[1].lower() != "none"), (None if not v else v[1].lower() == "visible")


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on any screen; a query about the size or kind of the screen doesn't."""
    return not media.strip() or any(_MEDIA.fullmatch(q.strip()) for q in media.split(","))


def sheets(source: str):
    """The style sheets for any screen, in order; those in comments don't count."""
    at = 0
    while m := _STYLE.search(source, at):
        if m[0] == "<!--":
            at = source.find("-->", m.end())
        else:
            at = source.find(">", m.end())
            if at >= 0:
                end = re.compile("</style", re.I).search(source, at)
                end = end.start() if end else len(source)
                media = _MEDIA_OF.search(source, m.end(), at)
                if on_screen(media[1].strip("\"'") if media else ""):
                    yield source[at + 1 : end]
                at = end
        if at < 0:
            return


def sheet_rules(sheet: str):
    """Selectors and declarations of the rules of a sheet that hold on any screen, in one pass over its braces."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)
    start, around = 0, []  # of each open brace: what stands before it, where its body begins, whether its rules count
    for m in _SHEET.finditer(sheet):
        if m[0] == "{":
            head = sheet[start : m.start()].strip()
            name = head.split("(")[0].split()[0].lower() if head else ""
            counts = (not around or (around[-1][2] and around[-1][0][:1] == "@")) and (name[:1] != "@" or name in _GROUPS or (name == "@media" and on_screen(head[6:])))
            around.append((head, m.end(), counts))
            start = m.end()
        elif m[0] == "}":
            if around:
                head, body, counts = around.pop()
                if counts and head[:1] != "@":
                    yield head, sheet[body : m.start()]
            start = m.end()
        elif m[0] == ";" and (not around or around[-1][0][:1] == "@"):
            start = m.end()


def style_rules(source: str) -> dict[tuple[str, str, str], tuple[bool | None, bool | None]]:
    """(tag, mark, name) of the rules of all style elements that say something of display or visibility; later ones count."""
    found: dict = {}
    for sheet in sheets(source):
        for selectors, body in sheet_rules(sheet):
            display, visible = declared(body)
            if display is None and visible is None:
                continue
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if m and m[0]:
                    key = ((m[1] or "").lower(), m[2] or "", m[3] or "")
                    before = found.get(key, (None, None))
                    found[key] = tuple(new if new is not None else old for new, old in zip((display, visible), before))
    return found


def number_of(raw: str | None, name: str) -> int | None:
    """A whole number that an attribute gives."""
    for m in _ATTRIBUTE.finditer(raw or ""):
        value = (m[2] or "").strip("\"'").strip()
        if m[1].lower() == name and re.fullmatch(r"-?[0-9]{1,9}", value):
            return int(value)
    return None


class Page:
    """Open elements, and the lines so far; a table collects rows of cells until it ends."""

    def __init__(self, rules: dict | None = None):
        self.stack: list[tuple[str, bool, bool]] = []  # name, displayed, visible
        self.at: dict[str, list[int]] = {}  # places in the stack of each name
        self.rules = rules or {}
        self.out: list[str] = []  # finished lines of the innermost flow
        self.line: list[str] = []
        self.gap = 0  # blank lines wanted before the next text
        self.flows: list[tuple] = []  # outer flows while a cell or an option is open
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.lists: list[list] = []
        self.marker = ""
        self.spans: list[tuple[int, int]] = []
        self.selects: list[list] = []  # chosen text, whether by mark

    @property
    def shown(self) -> bool:
        return not self.stack or (self.stack[-1][1] and self.stack[-1][2])

    def text(self, raw: str) -> None:
        if not self.shown or (self.stack and self.stack[-1][0] == "select") or self.closed_details():
            return
        x = html.unescape(raw) if "&" in raw else raw
        if self.at.get("pre"):
            first, *rest = x.split("\n")
            self.put(first)
            for part in rest:
                self.out.append("".join(self.line).rstrip())
                self.line = []
                self.put(part)
            return
        x = _SPACE.sub(" ", x)
        if x == " " and not self.line:
            return
        self.put(x[1:] if x[:1] == " " and (not self.line or self.line[-1][-1] == " ") else x)

    def closed_details(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] == "details-closed"

    def put(self, x: str) -> None:
        if not x:
            return
        if not self.line:
            if self.gap and self.out:
                self.out += [""] * self.gap
            self.gap = 0
            lead = "  " * min(max(0, len(self.lists) - 1), MOST_INDENT) + self.marker if self.lists else ""
            if lead:
                self.line.append(lead)
            self.marker = ""
        self.line.append(x)

    def end_line(self, gap: int = 0) -> None:
        line = "".join(self.line).rstrip()
        if line:
            self.out.append(line)
        self.line = []
        self.gap = max(self.gap, gap)

    def state(self, name: str, raw: str) -> tuple[bool, bool]:
        """Whether a new element is displayed and whether it is visible."""
        displayed, visible = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (True, True)
        if not displayed or name in HIDDEN or (self.closed_details() and name != "summary"):
            return False, visible
        display = None
        if self.rules:
            display, seen = self.rules.get((name, "", ""), (None, None))
            visible = visible if seen is None else seen
        if raw and raw.strip("/ "):
            have = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)}
            if self.rules:
                marks = [(".", c) for c in have.get("class", "").split()] + [("#", have.get("id", ""))] * ("id" in have)
                for tag, mark, own in [(t, *m) for m in marks for t in ("", name)]:
                    d, seen = self.rules.get((tag, mark, own), (None, None))
                    display = display if d is None else d
                    visible = visible if seen is None else seen
            if have.get("style"):
                d, seen = declared(have["style"])
                display = display if d is None else d
                visible = visible if seen is None else seen
            elif "hidden" in have and display is None:
                display = False
            if have.get("aria-hidden", "").lower() == "true" or (name == "input" and have.get("type", "").lower() == "hidden") or ("hidden" in have and display is not True):
                return False, visible
        return display is not False, visible

    def push(self, name: str, displayed: bool, visible: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, displayed, visible))

    def open(self, name: str, raw: str) -> None:
        if name in ENDS:
            self.close_up_to(*ENDS[name])
        if name in CLOSES_P:
            self.close_up_to(("p",), SCOPES)
        if name in ("td", "th") and self.tables and self.last("tr") < self.last("table"):
            self.open("tr", "")
        displayed, visible = self.state(name, raw)
        shown = displayed and visible
        if name in VOID:
            if shown and name == "br":
                if "".join(self.line).strip():
                    self.end_line()
                else:
                    self.gap = max(self.gap, 1)
            elif shown and name == "hr":
                self.end_line(1)
            return
        closed = name == "details" and displayed and not re.search(r"(?:^|\s)open(?:[\s=/]|$)", raw or "", re.I)
        self.push("details-closed" if closed else name, displayed, visible)
        if not displayed:
            return
        if name == "table":
            self.end_line(1)
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in ("td", "th") and self.tables:
            spans = dict.fromkeys(("colspan", "rowspan"), 1)
            for m in _ATTRIBUTE.finditer(raw or ""):
                value = (m[2] or "").strip("\"'")
                if m[1].lower() in spans and value.isascii() and value.isdigit() and len(value) < 6:
                    spans[m[1].lower()] = min(max(1, int(value)), MOST_SPAN)
            self.spans.append((spans["colspan"], spans["rowspan"]))
            self.enter()
        elif name == "select":
            self.selects.append(["", False])
        elif name == "option" and self.selects:
            self.selects[-1].append(bool(re.search(r"(?:^|\s)selected(?:[\s=/]|$)", raw or "", re.I)))
            self.enter()
        elif name in BLOCK:
            self.end_line(1 if name in PARAGRAPH and not (name in ("ul", "ol") and self.lists) else 0)
        if name in ("ul", "ol", "menu"):
            first = number_of(raw, "start") if name == "ol" else None
            self.lists.append([name, 0 if first is None else first - 1])
        elif name == "li" and self.lists:
            own = number_of(raw, "value")
            self.lists[-1][1] = self.lists[-1][1] + 1 if own is None else own
            self.marker = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "

    def enter(self) -> None:
        """A flow of its own."""
        self.flows.append((self.out, self.line, self.gap, self.lists, self.marker))
        self.out, self.line, self.gap, self.lists, self.marker = [], [], 0, [], ""

    def leave(self) -> str:
        """The text of the flow that ends, on one line."""
        self.end_line()
        cell = " ".join(x.strip() for x in self.out if x.strip())
        self.out, self.line, self.gap, self.lists, self.marker = self.flows.pop()
        return cell

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, -1 if none is."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close_up_to(self, names, bounds) -> None:
        """End the outermost open element among names that no bound encloses more closely."""
        bound, found = self.last(*bounds), len(self.stack)
        for n in names:
            places = self.at.get(n)
            if places and places[-1] > bound:
                found = min(found, places[bisect.bisect_right(places, bound)])
        self.cut(found)

    def close(self, name: str) -> None:
        if name == "br":
            self.open("br", "")
            return
        if name == "details":
            name = "details" if self.last("details") > self.last("details-closed") else "details-closed"
        place = self.last(name)
        # an end tag does not reach out of its cell
        if place >= 0 and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or place >= self.last("td", "th", "table")):
            self.cut(place)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def pop(self) -> None:
        name, displayed, _ = self.stack.pop()
        self.at[name].pop()
        if not displayed:
            return
        name = "details" if name == "details-closed" else name
        if name in ("td", "th") and self.spans and self.flows:
            cell = self.leave()
            if self.tables:
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append((cell, *self.spans.pop()))
        elif name == "option" and self.selects and len(self.selects[-1]) == 3 and self.flows:
            text, (now, marked, own) = self.leave(), self.selects[-1]
            self.selects[-1] = [text, own or marked] if own or not (now or marked) else [now, marked]
        elif name == "select" and self.selects:
            self.put(self.selects.pop()[0])
        elif name == "table" and self.tables:
            rows = [r for r in self.tables.pop() if r]
            self.end_line(1)
            for x in aligned(rows):
                self.put(x)
                self.end_line()
            self.gap = 1
        elif name in BLOCK and name not in ("tr", "tbody", "thead", "tfoot"):
            self.end_line(1 if name in PARAGRAPH and not (name in ("ul", "ol") and len(self.lists) > 1) else 0)
        if name in ("ul", "ol", "menu") and self.lists:
            self.lists.pop()


def placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """First column, end column and text of each cell: cells take the columns that cells of rows above leave free."""
    out, taken = [], []  # taken: (first, end, rows left), in order
    for row in rows:
        own, fresh, at, k = [], [], 0, 0
        for text, wide, high in row:
            while k < len(taken) and taken[k][0] < at + 1:  # a cell from above that begins here or before
                at, k = max(at, taken[k][1]), k + 1
            own.append((at, at + wide, text))
            fresh += [(at, at + wide, high)] * (high > 1)
            at += wide
            while k < len(taken) and taken[k][0] < at:  # overlapped ones end, as in browsers
                k += 1
        taken = sorted((a, z, left - 1) for a, z, left in [*taken, *fresh] if left > 1)
        out.append(own)
    return out


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table, each column as wide as its widest cell of one column, two spaces apart; only columns in which a cell begins count."""
    cells = placed(rows)
    begins = sorted({a for row in cells for a, _, _ in row})
    number = {a: i for i, a in enumerate(begins)}
    cells = [[(number[a], bisect.bisect_left(begins, z), text) for a, z, text in row] for row in cells]
    widths = [0] * len(begins)
    for row in cells:
        for a, z, text in row:
            if z - a == 1:
                widths[a] = max(widths[a], len(text))
    for row in cells:  # what spans several columns widens the last of them
        for a, z, text in row:
            if z - a > 1:
                widths[z - 1] += max(0, len(text) - sum(widths[a:z]) - 2 * (z - a - 1))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + 2)
    lines = []
    if sum(starts[row[-1][0]] for row in cells if row) > MOST_PADDING * (1000 + sum(len(text) for row in cells for *_, text in row)):
        return ["  ".join(text for *_, text in row if text) for row in cells]
    for row in cells:
        parts, at = [], 0
        for a, _, text in row:
            if text:
                parts += [" " * (starts[a] - at), text]
                at = starts[a] + len(text)
        lines.append("".join(parts))
    return lines


class TagEnds:
    """Where tags end: at the first `>` outside of quotes.

    A quote that is never closed ends no tag; such a tag ends at its first `>` or with the page. Quotes from which a search
    has come to such an end are remembered, so a page is searched once.
    """

    def __init__(self, source: str):
        self.source, self.hopeless = source, set()
        self.last = {q: source.rfind(q) for q in "\"'"}

    def find(self, at: int) -> int:
        met, start = [], at
        while m := _TAG_STOP.search(self.source, at):
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            if m.start() in self.hopeless or m.start() == self.last[m[0]]:
                break
            at = self.source.find(m[0], m.end()) + 1
        if not m:
            return len(self.source)
        self.hopeless.update(met)
        end = self.source.find(">", start)
        return len(self.source) if end < 0 else end


def visible_text(source: str | None) -> str:
    """All visible text of a page; a null or empty page has none."""
    source = source or ""
    page, at, ends = Page(style_rules(source)), 0, TagEnds(source)
    lower = None
    while at < len(source):
        lt = source.find("<", at)
        m = None
        while lt >= 0:
            m = _TAG.match(source, lt)
            if m:
                break
            lt = source.find("<", lt + 1)
        if not m:
            page.text(source[at:])
            break
        if lt > at:
            page.text(source[at:lt])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        end = ends.find(at)
        raw, at = source[at:end], end + 1
        if m[1]:
            page.close(name)
            continue
        if name == "textarea":
            page.text(" ")
        page.open(name, raw)
        if name in RAW and page.stack and page.stack[-1][0] == name:
            lower = source.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(source) else source.find(f"</{name}", at)
            end = len(source) if end < 0 else end
            if name == "textarea":
                page.text(source[at:end])
            page.close(name)
            if name == "textarea":
                page.text(" ")
            close = source.find(">", end)
            at = len(source) if close < 0 else close + 1
    while page.stack:
        page.pop()
    page.end_line()
    return "\n".join(page.out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of pages but the source, and `text`, the visible text (empty for null and empty pages). Rows stay as they are.

    A column of pages named text is replaced; other columns may have any names. Repeated rows are each rendered, an empty
    table gives none. Malformed pages give what can be read; unclosed elements end with the page.
    """
    kept = [c for c in pages.columns if c not in (column, "text")]
    source = pages.select(*kept, column)

    def render(batches):
        for batch in batches:
            for part in chunks(batch, column):
                texts = [visible_text(x) for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    from pyspark.sql import types as T

    return source.mapInArrow(render, T.StructType([*(f for f in source.schema.fields if f.name != column), T.StructField("text", T.StringType())]))


def query_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
