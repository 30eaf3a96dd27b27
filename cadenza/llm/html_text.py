"""Visible text of HTML pages, laid out.

A tree is built from the tags, with the ends that HTML implies (a new list item
ends the one before, a block ends an open paragraph, and so on). What a browser
would not show is left out: elements without visible content, hidden ones, and
those that a style makes invisible, be it their own or one of a style sheet's
rules for tags, classes and ids, for elements inside such elements too (`.a .b`,
`.a > .b`; at-rules, siblings, attributes and states are not followed).
Visibility is inherited and can be regained; no display can't.

The tree is then rendered: white space collapses outside of pre, blocks start on
lines of their own with a blank line where paragraphs have one, list items get
bullets or numbers and are indented, and the cells of a table are padded so that
columns line up, below cells that span rows too.

Layout has fixed bounds, as a screen has, which keep text and time linear in the
page: lists indent to column INDENT; a cell of more than WIDE columns does not
widen its column, and none is pushed beyond column FAR; a table has COLUMNS
columns, behind which cells follow each other; tables that lie in more than DEEP
others with columns are set cell below cell. There is no recursion.

One row in, one row out, in the tasks that read the pages; no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not shown.
UNSEEN = frozenset("head script style template noscript title iframe object svg math canvas audio video datalist select".split())
#: What a head can hold; anything else ends it.
IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript noframes template".split())
#: What stands between a table and its rows.
GROUPS = frozenset("thead tbody tfoot colgroup".split())
#: Blocks with a blank line around them, and blocks without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd tr td th thead tbody tfoot caption form figcaption details summary center dialog hgroup menu legend search".split())
#: An opening tag -> open elements that it ends, if nothing of the second set is in between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: A block ends an open paragraph unless one of these is in between.
_HOLDS_P = frozenset("button table td th li dd blockquote div section article body".split())
_SCOPE = frozenset(["table", "td", "th", "html", "body"])
#: See above.
INDENT, WIDE, FAR, COLUMNS, DEEP = 40, 80, 160, 1000, 6
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARATION = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_COMBINATOR = re.compile(r"(\s*>\s*|\s+)")
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children", "look")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: (displayed, visibility) of the node by itself.
        self.look: tuple[bool, str | None] = (True, None)


#: {property: (weight, value)}
Values = dict[str, tuple[tuple, str]]


def _stronger(best: Values, values: Values) -> None:
    for name, found in values.items():
        if name not in best or found[0] > best[name][0]:
            best[name] = found


class Styles:
    """The display and visibility rules of a page's style sheets.

    A selector is a chain of compounds, each of which needs some names (tag,
    classes, id) of one element. Chains that begin alike share their beginnings,
    and rules with the same chain are one. A compound is looked up by the rarest
    name that it needs; which beginnings hold for the elements around is counted
    on the way down, so no element looks back at all those around it."""

    def __init__(self, sheets: list[str]):
        #: (beginning before, whether that is the parent's, needs) -> its number, values, whether chains go on
        links: dict[tuple[int, bool, frozenset[str]], tuple[int, Values, list]] = {}
        count = 0
        for sheet in sheets:
            for selector, body in _rules(re.sub(r"/\*.*?(\*/|$)", " ", sheet, flags=re.S)):
                found = _DECLARATION.findall(body)
                for one in selector.split(",") if found else ():
                    parts = _COMBINATOR.split(one.strip())
                    matches = [_SELECTOR.fullmatch(p) for p in parts[0::2]]
                    if not all(m and m[0] for m in matches):
                        continue
                    count += 1
                    needs = [frozenset([m[1].lower()] if m[1] and m[1] != "*" else []) | frozenset(re.findall(r"[.#][\w-]+", m[2])) for m in matches]
                    names = [n for need in needs for n in need]
                    weight = (sum(n[0] == "#" for n in names), sum(n[0] == "." for n in names), sum(n[0] not in "#." for n in names), count)
                    values = {name.lower(): ((bool(important), *weight), value.lower()) for name, value, important in found}
                    before = -1
                    for k, need in enumerate(needs):
                        before, best, further = links.setdefault((before, k > 0 and ">" in parts[2 * k - 1], need), (len(links), {}, []))
                        further += [True] if k < len(needs) - 1 and not further else []
                    _stronger(best, values)
        often = Counter(n for _, _, need in links for n in need)
        self.rules: dict[str, list] = {}
        for (before, child, need), (number, values, further) in links.items():
            self.rules.setdefault(min(need, key=lambda n: (often[n], n), default="*"), []).append((need, before, child, number, values, bool(further)))

    def resolve(self, root: Node) -> None:
        """Sets the look of all nodes."""
        around: Counter[int] = Counter()
        held: set[int] = set()
        waiting = [(iter([root]), held)]
        while waiting:
            rest, parent = waiting[-1]
            node = next(rest, None)
            if node is None:
                waiting.pop()
                around.subtract(parent)
            elif not isinstance(node, str):
                held = self.enter(node, parent, around)
                around.update(held)
                waiting.append((iter(node.children), held))

    def enter(self, node: Node, parent: set[int], around: Counter[int]) -> set[int]:
        """Sets the node's look; returns the beginnings of chains that it ends."""
        a, best, begun = node.attrs, {}, set()
        if "hidden" in a or (node.tag == "dialog" and "open" not in a):
            best["display"] = ((), "none")
        if self.rules:
            names = {node.tag, *(f".{c}" for c in (a.get("class") or "").split()), *([f"#{a['id']}"] if a.get("id") else ())}
            for key in (*names, "*"):
                for needs, before, child, number, values, further in self.rules.get(key, ()):
                    if needs <= names and (before < 0 or (before in parent if child else around[before] > 0)):
                        _stronger(best, values)
                        if further:
                            begun.add(number)
        if style := a.get("style"):
            for name, value, important in _DECLARATION.findall(style):
                _stronger(best, {name.lower(): ((bool(important), 1 << 30), value.lower())})
        if best:
            node.look = best.get("display", ((), ""))[1] != "none", best["visibility"][1] if "visibility" in best else None
        return begun


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selector, declarations) of the rules outside of at-rules."""
    at = 0
    while (open_ := sheet.find("{", at)) >= 0:
        head = sheet[at:open_].rsplit(";", 1)[-1].strip()
        close = sheet.find("}", open_)
        if close < 0:
            close = len(sheet)
        if head.startswith("@"):
            depth, close = 1, open_ + 1
            for m in re.finditer("[{}]", sheet[close:]):
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    close += m.start()
                    break
            else:
                close = len(sheet)
        else:
            yield head, sheet[open_ + 1 : close]
        at = close + 1


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        #: tag -> places of the open elements with it.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.sheets: list[str] = []

    def _last(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _end(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Ends the innermost of these elements, unless one of stop is in it."""
        at = self._last(tags)
        if at >= 0 and at >= self._last(stop):
            self._close(at)

    def _close(self, i: int) -> None:
        for node in self.open[i:]:
            self.places[node.tag].pop()
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag in BLOCKS:
            self._end(frozenset(["p"]), _HOLDS_P)
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close(len(self.open) - 1)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        node = Node(tag, dict(reversed(attrs)))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "math", "iframe"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in ("html", "body"):
            self._end(frozenset([tag]), frozenset() if tag in ("table", *_SCOPE) else _SCOPE)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        if self.open[-1].tag == "style":
            self.sheets.append(data)
        self.open[-1].children.append(data)


class Lines:
    """Finished lines, the line being written, the blank line that is due, and
    the marks of items that have no line yet."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False
        #: Where lines start, and the marks before the next one; where those start.
        self.indent = self.mark_at = 0
        self.marks: list[str] = []
        #: No line yet in the innermost part (an item, a cell).
        self.fresh = True

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.now.append(first)
            for line in rest:
                self.done_line(True)
                self.now.append(line)
        elif data := _SPACE.sub(" ", data):
            self.now.append(data)

    def done_line(self, keep: bool = False) -> None:
        line = "".join(self.now)
        if not keep:
            line = re.sub(" {2,}", " ", line).strip(" ")
        self.now = []
        if line or keep:
            self.add([line.rstrip()])

    def add(self, lines: list[str]) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        for line in lines:
            self.fresh = False
            if line and self.marks:
                self.done.append(" " * self.mark_at + "".join(self.marks) + line)
                self.marks = []
            else:
                self.done.append(" " * self.indent + line if line else "")

    def edge(self, spaced: bool) -> None:
        self.done_line()
        self.blank |= spaced and not self.fresh

    def begin(self, mark: str = "") -> tuple[int, int, bool, bool]:
        """A part of its own, behind a mark: no blank line leads or trails."""
        self.done_line()
        state = self.indent, len(self.marks), self.fresh, self.blank
        if mark:
            if not self.marks:
                self.mark_at = self.indent
            self.marks.append(mark)
            self.indent = min(self.indent + len(mark), INDENT)
        self.fresh = True
        return state

    def end(self, state: tuple[int, int, bool, bool]) -> None:
        self.done_line()
        self.indent, marks, fresh, blank = state
        empty, self.blank = self.fresh, False
        if empty:
            self.blank = blank
            del self.marks[marks:]
        else:
            while len(self.done) > 1 and not self.done[-1]:
                self.done.pop()
        self.fresh = fresh and empty


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})(?![0-9])", value or "")
    return int(m[1]) if m else default


class Cell:
    """Lines of a table cell that starts at column `at` and spans `span`."""

    __slots__ = ("at", "span", "lines")

    def __init__(self, at: int, span: int, lines: list[str]):
        self.at, self.span, self.lines = at, span, lines


def _laid_out(rows: list[list[Cell]]) -> list[str]:
    """The lines of a table, columns two spaces apart and aligned."""
    starts = sorted({c.at for row in rows for c in row})
    rank = {at: k for k, at in enumerate(starts)}
    width = [0] * len(starts)
    wide = lambda c: max((len(x) for x in c.lines if len(x) <= WIDE), default=0)
    for row in rows:
        for c in row:
            if c.span == 1:
                width[rank[c.at]] = max(width[rank[c.at]], wide(c))
    # A cell that spans columns takes the room of those that start inside it.
    for row in rows:
        for c in row:
            if c.span > 1:
                k, n = rank[c.at], bisect_left(starts, c.at + c.span) - 1
                room = sum(width[k : n + 1]) + 2 * (n - k)
                width[n] += max(0, wide(c) - room)
    offset, total = [], 0
    for at, w in zip(starts, width, strict=True):
        offset.append(min(2 * at + total, FAR))
        total += w
    out = []
    for row in rows:
        # The few cells that go on are kept apart, so that a long one costs its own lines.
        live, i = row, 0
        while live := [c for c in live if len(c.lines) > i]:
            line, end = [], 0
            for c in live:
                gap = max(offset[rank[c.at]] - end, 2 if line else 0)
                line.append(" " * gap + c.lines[i])
                end += gap + len(c.lines[i])
            out.append("".join(line).rstrip())
            i += 1
    return out


class Renderer:
    """Lines of a tree. The methods are generators that yield what is to be
    rendered next and are resumed with its lines, so nothing recurses."""

    def __init__(self):
        #: Tables with columns around.
        self.depth = 0

    def run(self, work: Generator) -> list[str]:
        stack, value = [work], None
        while stack:
            try:
                stack.append(stack[-1].send(value))
                value = None
            except StopIteration as done:
                stack.pop()
                value = done.value
        return value

    def shown(self, node: Node, visible: bool) -> bool | None:
        """Whether text in the node is visible; None if it has no display."""
        if node.tag in UNSEEN:
            return None
        displayed, visibility = node.look
        if not displayed:
            return None
        return visible if visibility in (None, "inherit") else visibility not in ("hidden", "collapse")

    def lines(self, nodes: list[Node | str], pre: bool, visible: bool) -> Generator:
        out = Lines()
        for c in nodes:
            if isinstance(c, str):
                if visible:
                    out.text(c, pre)
            else:
                yield self.node(c, out, pre, visible)
        out.done_line()
        while out.done and not out.done[-1]:
            out.done.pop()
        return out.done

    def node(self, node: Node, out: Lines, pre: bool, visible: bool) -> Generator:
        visible_ = self.shown(node, visible)
        if visible_ is None:
            return
        tag = node.tag
        if tag == "br":
            out.done_line(True) if pre or "".join(out.now).strip() == "" else out.done_line()
            return
        if tag == "hr":
            out.edge(True)
            return
        block = tag in BLOCKS
        if block:
            out.edge(tag in SPACED)
        if tag in ("ul", "ol", "menu"):
            yield self.list(node, out, pre, visible_)
        elif tag == "table":
            yield self.table(node, out, pre, visible_)
        else:
            inside = pre or tag in ("pre", "textarea")
            for c in node.children:
                if isinstance(c, str):
                    if visible_:
                        out.text(c, inside)
                else:
                    yield self.node(c, out, inside, visible_)
            if tag == "pre":
                while out.now and not "".join(out.now).strip():
                    out.now = []
                if out.now:
                    out.done_line(True)
            if tag == "td" or tag == "th":
                out.now.append(" ")
        if block:
            out.edge(tag in SPACED)

    def inside(self, nodes: list[Node | str], out: Lines, pre: bool, visible: bool, mark: str = "") -> Generator:
        """The nodes as a part of its own among the lines."""
        state = out.begin(mark)
        for c in nodes:
            if isinstance(c, str):
                if visible:
                    out.text(c, pre)
            else:
                yield self.node(c, out, pre, visible)
        out.end(state)

    def list(self, node: Node, out: Lines, pre: bool, visible: bool) -> Generator:
        step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
        items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
        number = _number(node.attrs.get("start"), items if step < 0 else 1)
        for c in node.children:
            if isinstance(c, str):
                if visible:
                    out.text(c, pre)
            elif c.tag == "li" and (seen := self.shown(c, visible)) is not None:
                number = _number(c.attrs.get("value"), number)
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += step
                yield self.inside(c.children, out, pre, seen, mark)
            else:
                yield self.node(c, out, pre, visible)
        out.edge(False)

    def table(self, node: Node, out: Lines, pre: bool, visible: bool) -> Generator:
        """What HTML does not allow in a table stands before it."""
        strays: list[tuple[Node | str, bool]] = []
        # (row, visibility, group): rows of one group, beyond which no cell spans.
        found: list[tuple[Node, bool, int]] = []
        group = 0
        waiting = [(node, visible, iter(node.children))]
        while waiting:
            parent, seen, rest = waiting[-1]
            c = next(rest, None)
            if c is None:
                waiting.pop()
                group += 1
            elif isinstance(c, str):
                if seen and (parent is node or c.strip()):
                    strays.append((c, seen))
            elif c.tag in GROUPS or c.tag == "tr":
                if (inner := self.shown(c, seen)) is not None:
                    if c.tag == "tr":
                        found.append((c, inner, group))
                    else:
                        group += 1
                        waiting.append((c, inner, iter(c.children)))
            elif c.tag == "caption":
                yield self.node(c, out, pre, seen)
            else:
                strays.append((c, seen))
        # (first column, column behind, last row, group) of cells that reach
        # into later rows; they don't overlap.
        taken: list[tuple[int, int, int, int]] = []
        placed: list[list[tuple[Node, bool, int, int]]] = []
        plain = True
        for r, (tr, seen, group) in enumerate(found):
            row: list[tuple[Node, bool, int, int]] = []
            taken = sorted(t for t in taken if t[2] >= r and t[3] == group)
            at = k = 0
            for c in tr.children:
                if isinstance(c, str) or c.tag not in ("td", "th"):
                    if not isinstance(c, str) or (seen and c.strip()):
                        strays.append((c, seen))
                    continue
                inner = self.shown(c, seen)
                if inner is None:
                    continue
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                at = min(at, COLUMNS)
                span = min(max(_number(c.attrs.get("colspan"), 1), 1), COLUMNS - at or 1)
                down = _number(c.attrs.get("rowspan"), 1)
                if down != 1 and at < COLUMNS:
                    plain = False
                    taken.insert(k, (at, at + span, r + min(down, 65_534) - 1 if down > 0 else len(found), group))
                    k += 1
                row.append((c, inner, at, span))
                at += span
            plain &= len(row) <= 1
            placed.append(row)
        for c, seen in strays:
            if isinstance(c, str):
                out.text(c, pre)
            else:
                yield self.node(c, out, pre, seen)
        out.edge(False)
        if plain or self.depth >= DEEP:
            for row in placed:
                for c, inner, _, _ in row:
                    yield self.inside(c.children, out, False, inner)
            return
        self.depth += 1
        rows: list[list[Cell]] = []
        for row in placed:
            rows.append([])
            for c, inner, at, span in row:
                lines = yield self.lines(c.children, False, inner)
                rows[-1].append(Cell(at, span, lines))
        self.depth -= 1
        out.add(_laid_out(rows))

def page_text(html: str | None) -> str:
    """The visible text of a page; empty for null."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    Styles(builder.sheets).resolve(builder.root)
    renderer = Renderer()
    text = "\n".join(renderer.run(renderer.lines(builder.root.children, False, True)))
    # The tree can be too deep for Python to free it by recursion.
    waiting = [builder.root]
    while waiting:
        node = waiting.pop()
        waiting += [c for c in node.children if not isinstance(c, str)]
        node.children = []
    return text


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_chars, n_lines) for each row of pages: the rendered
    visible text, its code points, and its lines that are not blank. A null
    page has the empty text. Ids may be null or repeat; other columns are not
    read. Deep, wide and long pages are read whole. colspan counts to COLUMNS and
    rowspan to 65,534, as HTML has it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(h) for h in batch.column(1).to_pylist()]
            counts = [sum(1 for line in t.split("\n") if line.strip()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], names=["id", "text", "n_chars", "n_lines"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(render, f"id {kind}, text string, n_chars bigint, n_lines bigint").withColumnRenamed("id", id_col)
