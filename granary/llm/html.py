"""HTML to text by layout: a tree with implied tags, rules of visibility, and text as blocks, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown.
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist annotation annotation-xml".split())
#: Elements of an svg that hold what is not drawn, and those that hold text.
UNDRAWN, DRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split()), frozenset("text foreignobject".split())
#: The screen for which media queries are judged, in CSS pixels.
SCREEN = {"width": 1280.0, "height": 800.0}
#: Elements that begin and end a line; those of SPACED have an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside main nav header footer address form li dt dd tr td th thead tbody tfoot caption center details summary figcaption legend option optgroup".split())
#: A start tag closes open elements of these names, up to one of the names after the bar.
IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody thead tfoot tr td th caption", "table"), "tfoot": ("tbody thead tfoot tr td th caption", "table"), "option": ("option", "select datalist"), "optgroup": ("option optgroup", "select"),
}
CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in IMPLIED.items()}
#: What an end tag does not reach over.
SCOPE = frozenset("table td th".split())
PARTS = frozenset("tr td th thead tbody tfoot caption".split())
#: What may stand in a head. Any other tag, and text, ends it.
OF_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
#: Inputs that show their value as a label.
BUTTONS = frozenset("submit reset button".split())
#: Elements whose content is text up to their end tag; in the first ones & stands for itself. A page is read as by one whose browser runs scripts, so noscript is one.
RAW, ESCAPED = frozenset("script style xmp iframe noembed noframes noscript".split()), frozenset("title textarea".split())
#: Levels of lists and quotations that indent a line; deeper ones keep their marks only.
INDENTS = 32
_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_SHORT_COMMENT, _COMMENT_END = re.compile("<!---?>"), re.compile("--!?>")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_SHOWN = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)[^;]*?(!\s*important)?\s*(?:;|$)", re.I)
_RANGE = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([0-9.]+)(px|em|rem)\s*\)")
_SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)$", re.I)
GAP = "  "


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from a place on, the first of a name, and where the tag ends; -1 if it does not."""
    found: dict[str, str] = {}
    if html.startswith(">", at):
        return found, at + 1
    while True:
        m = _ATTRIBUTE.match(html, at)
        at, name = m.end(), m[1].lower()
        if at >= len(html):
            return found, -1
        value = ""
        if m[2]:
            quote = html[at]
            if quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, -1
                value, at = html[at + 1 : end], end + 1
            else:
                value = _BARE.match(html, at)[0]
                at += len(value)
        if name:
            found.setdefault(name, unescape(value))
        if at < len(html) and html[at] == ">":
            return found, at + 1


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("data", text, None), ("start", tag, attributes), ("slash", tag, None) after a start tag that ends in one, and ("end", tag, None) in order. Each place is read a bounded number of times; whatever does not end goes on to the end of the page."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt == n - 1:
            yield "data", unescape(html[at:]), None
            return
        if lt > at:
            yield "data", unescape(html[at:lt]), None
        c = html[lt + 1]
        end_tag = c == "/"
        first = html[lt + 2 : lt + 3] if end_tag else c
        if first.isascii() and first.isalpha():
            name = _NAME.match(html, lt + 1 + end_tag)
            tag = name[0].lower()
            attrs, at = attributes(html, name.end())
            if at < 0:
                return
            yield ("end", tag, None) if end_tag else ("start", tag, attrs)
            if not end_tag and html[at - 2] == "/":
                yield "slash", tag, None
            if not end_tag and (tag in RAW or tag in ESCAPED):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                text = html[at : end.start()] if end else html[at:]
                if text:
                    yield "data", unescape(text) if tag in ESCAPED else text, None
                at = end.start() if end else n
        elif html.startswith("<!--", lt):
            end = _SHORT_COMMENT.match(html, lt) or _COMMENT_END.search(html, lt + 4)
            if not end:
                return
            at = end.end()
        elif c in "!?" or end_tag:
            end = html.find(">", lt + 2)
            if end < 0:
                return
            at = end + 1
        else:
            yield "data", "<", None
            at = lt + 1


class Tree:
    """Builds the tree. Never fails: what doesn't fit is placed where the open elements allow it.

    The places of open elements are kept by name, so no tag searches them: the time is linear however deep they nest.
    """

    def __init__(self, html: str) -> None:
        self.root = Node("html", {})
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.styles: list[str] = []
        self._push(self.root)
        for kind, value, attrs in tokens(html):
            if kind == "start":
                self._start(value, attrs)
            elif kind == "end":
                self._end(value)
            elif kind == "slash":  # means nothing but within svg and math
                if self.open[-1].tag == value and value not in VOID and (self.places.get("svg") or self.places.get("math")):
                    self._cut(len(self.open) - 1)
            elif self.open[-1].tag == "style":
                self.styles.append(value)
            else:
                if self.open[-1].tag == "head" and value.strip():
                    self._close(_HEAD, _NONE)
                self.open[-1].children.append(value)

    def _push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _cut(self, at: int) -> None:
        while len(self.open) > max(at, 1):
            self.places[self.open.pop().tag].pop()

    def _last(self, names: frozenset[str]) -> int:
        """The place of the innermost open element of some names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _close(self, names: frozenset[str], stop: frozenset[str]) -> None:
        at = self._last(names)
        if at and at > self._last(stop):
            # all of these names above the stop go, as with a cell and its row
            while at > 1 and self.open[at - 1].tag in names:
                at -= 1
            self._cut(at)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        places, block = self.places, tag in BLOCK
        if tag == "html" or (tag == "body" and places.get("body")):
            for k, v in attrs.items():
                self.open[places["body"][-1] if tag == "body" else 0].attrs.setdefault(k, v)
            return
        if tag not in OF_HEAD and places.get("head") and not (places.get("template") and places["template"][-1] > places["head"][-1]):
            self._close(_HEAD, _NONE)
        if tag in PARTS and not places.get("table"):
            return  # parts of a table mean nothing outside one
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if block and places.get("p") and tag not in ("option", "optgroup"):
            self._close(_P, _P_STOP)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._push(node)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._start("br", {})
            return
        own = self.places.get(tag)
        at = own[-1] if own else 0
        if at and (tag in _TABLE or at > self._last(SCOPE)):
            self._cut(at)
        elif tag == "p":
            self._start("p", {})
            self._cut(len(self.open) - 1)


_NONE, _HEAD, _P = frozenset(), frozenset(["head"]), frozenset(["p"])
_P_STOP, _TABLE = SCOPE | frozenset(["button"]), frozenset("table tr tbody thead tfoot td th".split())


def on_screen(query: str) -> bool:
    """Whether a media query holds on a screen of the size SCREEN. Features other than widths, heights and landscape do not hold."""
    for one in query.lower().split(","):
        m = re.match(r"\s*(not\s+|only\s+)?([a-z]+)?", one)
        negated, kind = (m[1] or "").strip() == "not", m[2]
        holds = kind in (None, "all", "screen")
        for feature in re.findall(r"\([^()]*\)", one):
            if r := _RANGE.fullmatch(feature):
                size = float(r[3]) * (1 if r[4] == "px" else 16)
                holds &= SCREEN[r[2]] >= size if r[1] == "min" else SCREEN[r[2]] <= size
            else:
                holds &= re.sub(r"\s", "", feature) == "(orientation:landscape)"
        if holds != negated:
            return True
    return False


def uncommented(css: str) -> str:
    """Without comments; one that does not end reaches to the end."""
    found, at = [], 0
    while (start := css.find("/*", at)) >= 0:
        found.append(css[at:start])
        end = css.find("*/", start + 2)
        if end < 0:
            return "".join(found)
        at = end + 2
    return "".join(found) + css[at:]


def style_rules(styles: list[str]) -> list[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in their order; those of nested at-rules included."""
    css = uncommented("\n".join(styles)).replace("<!--", "").replace("-->", "")
    found, open_, head = [], [], ""  # open_: (selectors or at-rule, whether what is in it holds, declarations)
    for part in re.split(r"([{};])", css):
        if part == "{":
            name = head.strip()
            at = name.lower()
            holds = not open_ or (open_[-1][1] and open_[-1][0].startswith("@"))
            if at.startswith("@"):
                holds = holds and (on_screen(name[6:]) if at.startswith("@media") else at.startswith(("@supports", "@layer")))
            open_.append((name, holds, []))
            head = ""
        elif part == "}":
            if open_:
                name, holds, body = open_.pop()
                body.append(head)
                if not name.startswith("@") and holds:
                    found.append((name, ";".join(body)))
            head = ""
        elif part == ";":
            if open_:
                open_[-1][2].append(head)
            head = ""
        else:
            head += part
    return found


class Rules:
    """What the simple selectors of a page's own style sheets say of display and visibility; other selectors are not judged.

    Of rules with the same selector and property only the strongest is kept, a rule stands under the rarest of its ids and
    classes, else its tag, and nodes of the same tag, classes and id are judged once.
    """

    def __init__(self, styles: list[str]) -> None:
        strongest: dict[tuple, tuple] = {}
        for place, (selectors, body) in enumerate(style_rules(styles)):
            said = _SHOWN.findall(body)
            for one in selectors.split(",") if said else ():
                if (m := _SIMPLE.match(one.strip())) and one.strip():
                    parts = re.findall(r"([.#])([\w-]+)", m[2])
                    classes, ids = frozenset(v for k, v in parts if k == "."), tuple(v for k, v in parts if k == "#")
                    tag = (m[1] or "").lower()
                    for k, (name, value, important) in enumerate(said):
                        rank = (bool(important), False, len(ids), len(classes), bool(tag), place, k)
                        rule = (tag, classes, ids, name.lower())
                        strongest[rule] = max(strongest.get(rule, ((),)), (rank, value.lower()))
        names = [[f"#{i}" for i in ids] + [f".{c}" for c in sorted(classes)] or [tag] for tag, classes, ids, _ in strongest]
        uses = Counter(n for own in names for n in own)
        self.by_key: dict[str, list[tuple]] = {}
        for own, (rule, best) in zip(names, strongest.items(), strict=True):
            self.by_key.setdefault(min(own, key=lambda n: uses[n]), []).append((*rule, best))
        self.judged: dict[tuple, dict[str, tuple]] = {}

    def _said(self, tag: str, of_class: str, own_id: str | None) -> dict[str, tuple]:
        if (found := self.judged.get((tag, of_class, own_id))) is not None:
            return found
        best: dict[str, tuple] = {}
        classes = frozenset(of_class.split())
        for key in (tag, *[f".{c}" for c in classes], f"#{own_id or ''}"):
            for of_tag, needed, ids, name, said in self.by_key.get(key, ()):
                if (not of_tag or of_tag == tag) and needed <= classes and all(i == own_id for i in ids):
                    best[name] = max(best.get(name, ((),)), said)
        self.judged[tag, of_class, own_id] = best
        return best

    def shown(self, node: Node, seen: bool) -> tuple[bool, bool]:
        """(whether the node has a place, whether its own text is seen), where seen is its parent's. Of the declarations for a property the strongest holds: important ones, then its own style, then by selector and order."""
        a = node.attrs
        if node.tag in HIDDEN or (node.tag == "input" and (a.get("type", "").lower() not in BUTTONS or not a.get("value"))):
            return False, False
        if not a and not self.by_key:
            return node.tag != "dialog", seen
        best = dict(self._said(node.tag, a.get("class", ""), a.get("id"))) if self.by_key else {}
        for k, (name, value, important) in enumerate(_SHOWN.findall(a["style"]) if "style" in a else ()):
            rank = (bool(important), True, 0, 0, False, 0, k)
            best[name.lower()] = max(best.get(name.lower(), ((),)), (rank, value.lower()))
        display, visibility = best.get("display"), best.get("visibility")
        if display[-1] == "none" if display else "hidden" in a or (node.tag == "dialog" and "open" not in a):
            return False, False
        if visibility and visibility[-1] != "inherit":
            seen = visibility[-1] not in ("hidden", "collapse")
        return True, seen


def _within(node: Node, tags: frozenset[str], rules: Rules, seen: bool) -> list[tuple[Node, bool]]:
    """The nodes of some tags under a node that have a place, outermost only, and whether their parents are seen."""
    found, stack = [], [(c, seen) for c in reversed(node.children)]
    while stack:
        x, seen = stack.pop()
        if isinstance(x, str) or x.tag in UNDRAWN:
            continue
        placed, own = rules.shown(x, seen)
        if placed and x.tag in tags:
            found.append((x, seen))
        elif placed:
            stack.extend((c, own) for c in reversed(x.children))
    return found


def inside(node: Node, rules: Rules, seen: bool) -> list[tuple[Node | str, bool]]:
    """What is shown of a node, and whether it is seen unless it says so itself: of an svg its texts; of a list of options the chosen one, or all where several lines are shown; of closed details the summary."""
    if node.tag == "svg":
        return [x for t in _within(node, DRAWN, rules, seen) for x in (t, (" ", seen))]
    if node.tag == "select":
        options = _within(node, frozenset(["option"]), rules, seen)
        size = node.attrs.get("size", "")
        if "multiple" in node.attrs or (size.isdecimal() and int(size) > 1):
            return options
        chosen = [x for x in options if "selected" in x[0].attrs][-1:] or [x for x in options if "disabled" not in x[0].attrs][:1]
        return [(c, s) for x, s in chosen for c in ([x.attrs["label"]] if x.attrs.get("label") else x.children)]
    if node.tag == "input":
        return [(node.attrs["value"], seen)]
    if node.tag == "details" and "open" not in node.attrs:
        return [(c, seen) for c in node.children if not isinstance(c, str) and c.tag == "summary"][:1]
    return [(c, seen) for c in node.children]


_OWN = frozenset("svg select details input".split())


class Lines:
    """Text of one flow: words are joined over inline elements, blocks make lines, spaced blocks an empty line.

    Items of lists and quotations are levels: a level's first line has its mark, the others are indented.
    """

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False  # white space is due before the next text
        self.blank = False  # an empty line is due before the next line
        self.levels: list[tuple[str, str, bool]] = []  # mark, indent, whether an empty line is due before the level
        self.fresh = 0  # innermost levels that have no line yet

    def enter(self, mark: str) -> None:
        self.levels.append((mark, " " * len(mark), self.blank))
        self.fresh += 1
        self.blank = False

    def leave(self) -> None:
        _, _, due = self.levels.pop()
        self.blank = due if self.fresh else False
        self.fresh = max(0, self.fresh - 1)

    def text(self, data: str) -> None:
        plain = _SPACE.sub(" ", data)
        if plain == " ":
            self.gap = bool(self.parts)
            return
        if plain.startswith(" "):
            self.gap, plain = bool(self.parts), plain[1:]
        if self.gap:
            self.parts.append(" ")
        self.gap = plain.endswith(" ")
        self.parts.append(plain[:-1] if self.gap else plain)

    def end(self, spaced: bool = False) -> None:
        if self.parts:
            self.line("".join(self.parts))
        self.parts, self.gap = [], False
        self.blank |= spaced

    def line(self, text: str) -> None:
        if self.fresh:
            if not text:
                return
            self.blank = self.levels[-self.fresh][2]
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        if text and self.levels:
            old = len(self.levels) - self.fresh
            marks = [x[0] for x in self.levels[old:]]
            text = ("".join(x[1] for x in self.levels[: min(old, INDENTS)]) + "".join(marks) + text).rstrip()
            self.fresh = 0
        self.lines.append(text)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Grid:
    """The columns of a table that no cell from above fills, as intervals; a cell that spans rows takes its free ones until its last row."""

    def __init__(self) -> None:
        self.starts, self.ends = [0], [1 << 60]
        self.until: list[tuple[int, int, int]] = []  # the row at which an interval is free again

    def first(self, at: int) -> int:
        return max(at, self.starts[bisect_right(self.ends, at)])

    def take(self, at: int, end: int, until: int | None) -> None:
        i = bisect_right(self.ends, at)
        while self.starts[i] < end:
            a, b = max(at, self.starts[i]), min(end, self.ends[i])
            left = [(x, y) for x, y in ((self.starts[i], a), (b, self.ends[i])) if x < y]
            self.starts[i : i + 1], self.ends[i : i + 1] = [x for x, _ in left], [y for _, y in left]
            if until is not None:
                heappush(self.until, (until, a, b))
            i = bisect_right(self.ends, b)

    def begin(self, row: int) -> None:
        while self.until and self.until[0][0] <= row:
            _, a, b = heappop(self.until)
            i = bisect_left(self.starts, b)
            j = i
            if i < len(self.starts) and self.starts[i] == b:
                b, j = self.ends[i], i + 1
            if i and self.ends[i - 1] == a:
                a, i = self.starts[i - 1], i - 1
            self.starts[i:j], self.ends[i:j] = [a], [b]


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned; 0 rows: to the end) as lines.

    Cells stand on the table's grid: a cell that spans rows keeps its columns free below it. A column is as wide as its
    widest cell that spans no other; columns in which no cell begins have no width.
    """
    placed: list[list[tuple[int, list[str], int]]] = []
    grid = Grid()
    for k, row in enumerate(rows):
        at, here, spans = 0, [], []
        grid.begin(k)
        for lines, columns, down in row:
            at = grid.first(at)
            here.append((at, lines, columns))
            if down != 1:
                spans.append((at, at + columns, k + down if down else None))
            at += columns
        placed.append(here)
        for span in spans:
            grid.take(*span)
    starts = sorted({at for row in placed for at, _, _ in row})
    widths = dict.fromkeys(starts, 0)
    for row in placed:
        for at, lines, columns in row:
            if bisect_left(starts, at + columns) - bisect_left(starts, at) == 1:
                widths[at] = max(widths[at], *(_width(x) for x in lines), 0)
    offsets, total = {}, 0
    for c in starts:
        offsets[c] = total
        total += widths[c] + len(GAP)
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            text, used = "", 0
            for at, lines, _ in row:
                cell = lines[k] if k < len(lines) else ""
                if cell:
                    room = max(offsets[at] - used, len(GAP) if used else 0)
                    text += " " * room + cell
                    used += room + _width(cell)
            out.append(text.rstrip())
    return out


def _number(value: str | None, least: int, most: int, other: int) -> int:
    return min(most, max(least, int(value))) if value and re.fullmatch("[0-9]{1,9}", value.strip()) else other


def render(html: str | None) -> str:
    """The visible text of a page.

    Null and empty pages give an empty text. Hidden are: elements that show no text of their own (scripts, styles,
    titles), the attribute hidden, what is not the summary of closed details, closed dialogs, and what display: none or
    visibility: hidden hides by a style attribute or by simple selectors (tag, class, id) of the page's own style
    sheets, as far as they hold on a screen; visibility is inherited, so what is visible within what is hidden is
    shown. Formulas, the texts of svg, the chosen option of a list and the labels of buttons are shown, what is typed into
    other inputs and what stands in for scripts that don't run (noscript) is not. Text, or a tag that can't stand in
    a head, ends it. Blocks end lines; paragraphs,
    headings, lists, tables and the like have an empty line around them; items of lists are marked and indented; cells
    of a table are padded to the columns of its grid; pre keeps its white space. No input fails. Neither the tree nor the
    walk recurse or search what is open, so time grows with the page's length, but for nodes of many different lists of
    classes that many selectors of several classes share.
    """
    if not html:
        return ""
    tree = Tree(html)
    rules = Rules(tree.styles)
    flows, tables, lists, pre = [Lines()], [], [], 0
    stack: list[tuple[object, bool, bool]] = [(tree.root, True, True)]
    while stack:
        node, seen, enter = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not seen:
                continue
            if pre:
                head, *more = node.split("\n")
                flow.parts.append(head)
                for x in more:
                    flow.line("".join(flow.parts).rstrip())
                    flow.parts = [x]
            else:
                flow.text(node)
            continue
        tag = node.tag
        if enter:
            placed, seen = rules.shown(node, seen)
            if not placed:
                continue
            if tag == "br":
                if flow.parts:
                    flow.end()
                elif flow.lines and flow.lines[-1]:
                    flow.line("")
                continue
            if tag in BLOCK:
                flow.end(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "hr":
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                flow.enter(f"{lists[-1][1]}. " if lists and lists[-1][0] else "- ")
                if lists:
                    lists[-1][1] += 1
            elif tag in ("dd", "blockquote"):
                flow.enter("  ")
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th", "caption") and tables:
                flows.append(Lines())
            elif tag == "pre":
                pre += 1
            stack.append((node, seen, False))
            if tag in _OWN:
                stack.extend([(c, s, True) for c, s in reversed(inside(node, rules, seen))])
            else:
                stack.extend([(c, seen, True) for c in reversed(node.children)])
            continue
        if tag in BLOCK:
            flow.end()
        if tag in ("li", "dd", "blockquote"):
            flow.leave()
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("td", "th") and tables:
            flows.pop()
            if not tables[-1]:
                tables[-1].append([])
            rows = _number(node.attrs.get("rowspan"), 0, 65534, 1)
            tables[-1][-1].append(([x for x in flow.lines if x] or [""], _number(node.attrs.get("colspan"), 1, 1000, 1), rows))
        elif tag == "caption" and tables:
            flows.pop()
            for x in flow.lines:
                if x:
                    flows[-1].line(x)
        elif tag == "table":
            for x in table_lines(tables.pop()):
                if x:
                    flow.line(x)
        elif tag == "pre":
            pre -= 1
        if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
            flows[-1].blank = True
    flows[0].end()
    return "\n".join(flows[0].lines).strip("\n")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(h.as_py()) for h in batch.column(1)], pa.string())], ["_id", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, and the text that render gives of the whole page, of any length.

    Null pages have an empty text. Ids may be null or repeat, and rows that repeat each get their own; other columns are
    not read, so their names do not matter; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    out = small_batches(pages).select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).mapInArrow(_batches, f"_id {kind}, text string")
    return out.withColumnRenamed("_id", id_col)
