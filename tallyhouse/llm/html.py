"""HTML extraction by layout-aware rendering (operator 6).

One scan from left to right cuts a page into tags and text; a tree builder opens and closes elements, with end tags implied where HTML
lets authors leave them out; what is hidden is taken out; then the tree is rendered as a reader would see it: white space collapsed
outside `pre`, blocks on lines of their own with blank lines where a browser leaves a margin, lists with marks and indents, tables
with cells aligned in columns, spans of rows and columns included. Visibility follows attributes, inline styles and the page's style
sheets (rules whose selector is a tag, a class, an id, or a tag with one of these; others are passed over); a closed `details` shows its
summary alone.

Defined results: null and empty pages give an empty text; broken markup (unclosed or stray tags, unfinished comments and attributes)
gives the text that can still be seen; very long pages, pages of many open elements, tables with many spans and tables in tables are
rendered whole, in time that grows with their length: tables more than DEEP_TABLES deep show their cells as blocks, and a table whose
alignment would need more than SPREAD times its text has its cells two spaces apart; repeated rows render each; an empty table gives an empty result; other columns pass through if named in
`keep`.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript iframe noembed noframes canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul caption".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure pre ul ol menu table hr".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
#: An opening tag of the key closes open elements named in the value, up to an element of SCOPE.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th", "caption", "colgroup", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "p"}, "thead": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "p"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "p"}, "body": {"head"},
}
NO_P = BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "body", "html"}
SCOPE = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
P_SCOPE = {"table", "td", "th", "caption", "button", "object", "body", "html"}
BODY_ONLY = BLOCK - {"html", "body"} | {"a", "span", "b", "i", "em", "strong", "img", "br", "input", "button", "label", "select"}

#: Pieces of a tag, matched one after another from where the last one ended.
_NAME = re.compile(r"[^ \t\n\f\r/>]*")
_BETWEEN = re.compile(r"[ \t\n\f\r/]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\f\r/>=]*")
_EQUALS = re.compile(r"[ \t\n\f\r]*=[ \t\n\f\r]*")
_UNQUOTED = re.compile(r"[^ \t\n\f\r>]*")
#: What may hold semicolons in a style without ending a declaration.
_STYLE_INERT = re.compile(r"""(?s)/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|(?i:url)\([^)]*\)""")
#: Of svg and math: what is never drawn itself, and HTML's tags that end a drawing or formula left open.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = ("svg", "math")
TABLE_TAGS = frozenset("table tr tbody thead tfoot td th".split())
_WHITE = re.compile(r"[ \t\n\f\r]+")
#: HTML's limit of a colspan.
MAX_COLSPAN = 1000
#: Levels of tables in tables that are laid out in columns.
DEEP_TABLES = 24
#: Times a table's text that its alignment may take up.
SPREAD = 16
#: In what order the parts of a table stand.
GROUPS = {"thead": 0, "tbody": 1, "tfoot": 2}


class Node:
    __slots__ = ("attrs", "children", "lines", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.lines = tag, attrs or {}, [], None


def attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes from `at` on (names in small letters; the first of a name counts), whether the tag ends in a slash, and where
    it ends: -1 if it never does."""
    found: dict[str, str] = {}
    size = len(html)
    while True:
        begin, at = at, _BETWEEN.match(html, at).end()
        if at >= size:
            return found, False, -1
        if html[at] == ">":
            return found, at > begin and html[at - 1] == "/", at + 1
        m = _ATTRIBUTE.match(html, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(html, at):
            at = m.end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(html, at)
                value, at = m[0], m.end()
        found.setdefault(name, unescape(value) if "&" in value else value)


def tokens(html: str):
    """(kind, what, attributes, slash, where it ends): kind is "text", "data" (nothing escaped), "open" or "close"."""
    at, size = 0, len(html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], None, False, size
            return
        nxt = html[lt + 1 : lt + 2]
        end_tag = nxt == "/"
        first = html[lt + 2 : lt + 3] if end_tag else nxt
        if first.isascii() and first.isalpha():
            if lt > at:
                yield "text", html[at:lt], None, False, lt
            m = _NAME.match(html, lt + 1 + end_tag)
            attrs, slash, at = attributes(html, m.end())
            if at < 0:  # a tag that never ends hides what follows, as in a browser
                return
            # the caller may move on, past what is no markup
            moved = yield "close" if end_tag else "open", m[0].lower(), attrs, slash, at
            at = moved if moved is not None else at
            continue
        if nxt in ("!", "?") and nxt or end_tag and first:
            if lt > at:
                yield "text", html[at:lt], None, False, lt
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt) + 1
                    continue
                end, skip = html.find("-->", lt + 4), 3
            elif html.startswith("<![CDATA[", lt):
                end, skip = html.find("]]>", lt + 9), 3
                yield "data", html[lt + 9 : end if end >= 0 else size], None, False, lt
            else:
                end, skip = html.find(">", lt + 2), 1
            if end < 0:
                return
            at = end + skip
            continue
        yield "text", html[at : lt + 1], None, False, lt + 1  # a sign like any other
        at = lt + 1


def declared(style: str):
    """Name, whether it is marked important, and value of each declaration."""
    for part in style.split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.strip().lower().partition("!")
        yield name.strip().lower(), bool(mark), value.strip()


#: A selector that is a tag, a class, an id, or a tag with a class or an id.
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?([.#][\w-]+)?")
_SHEET_INERT = re.compile(r"(?s)/\*.*?(?:\*/|\Z)|<!--|-->")
#: How specific a selector is: of no tag, by tag, class, tag and class, id, tag and id.
_WEIGHTS = {"": 0, ".": 10, "#": 100}


def rules(sheet: str, so_far: dict[str, dict[str, tuple]]) -> None:
    """Adds to so_far, by selector and property, (important, weight, turn, value) of the winning rule. At-rules are passed over."""
    sheet = _SHEET_INERT.sub(" ", sheet)
    at, size = 0, len(sheet)
    while (brace := sheet.find("{", at)) >= 0:
        head = sheet[at:brace]
        if ";" in head:  # an at-rule without a block
            head = head.rpartition(";")[2]
        head = head.strip()
        if head.startswith("@"):
            depth, k = 1, brace + 1
            for m in re.compile("[{}]").finditer(sheet, brace + 1):
                depth += 1 if m[0] == "{" else -1
                k = m.end()
                if not depth:
                    break
            at = k if not depth else size
            continue
        end = sheet.find("}", brace)
        end = size if end < 0 else end
        said = [d for d in declared(_STYLE_INERT.sub(" ", sheet[brace + 1 : end])) if d[0] in ("display", "visibility")]
        for selector in head.split(",") if said else ():
            m = _SELECTOR.fullmatch(selector.strip())
            if not m or not m[0]:
                continue
            tag, mark = (m[1] or "").lower().replace("*", ""), m[2] or ""
            weight = _WEIGHTS[mark[:1]] + bool(tag)
            own = so_far.setdefault((tag + mark) or "*", {})
            for name, strong, value in said:
                if name not in own or (strong, weight) >= own[name][:2]:
                    own[name] = strong, weight, len(so_far), value
        at = end + 1


def _styled(node: Node, sheet: dict[str, dict[str, tuple]]) -> dict[str, tuple]:
    """What the sheets say of an element: by property the winning rule."""
    tag, found = node.tag, {}
    keys = ["*", tag]
    for c in (node.attrs.get("class") or "").split():
        keys += [f".{c}", f"{tag}.{c}"]
    if name := node.attrs.get("id"):
        keys += [f"#{name}", f"{tag}#{name}"]
    for k in keys:
        for prop, rule in sheet.get(k, {}).items():
            if prop not in found or rule[:3] > found[prop][:3]:
                found[prop] = rule
    return found


def stands(node: Node, sheet: dict[str, dict[str, tuple]] | None = None) -> str | None:
    """What an element's attributes and the sheets say: "gone" with its place, "hidden" or "visible" for itself and what doesn't say
    otherwise, or None."""
    found = node.attrs
    if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in found):
        return "gone"
    said: dict[str, tuple[bool, str]] = {}
    for name in ("display", "visibility"):  # attributes of drawings
        if name in found:
            said[name] = False, found[name].strip().lower()
    for name, rule in (_styled(node, sheet) if sheet else {}).items():
        said[name] = rule[0], rule[3]
    style = found.get("style", "")
    for name, strong, value in declared(_STYLE_INERT.sub(" ", style)) if style else ():
        if strong >= said.get(name, (False, ""))[0]:
            said[name] = strong, value
    shown = said.get("display", (False, ""))[1]
    if shown == "none" or ("hidden" in found and not shown):
        return "gone"
    seen = said.get("visibility", (False, ""))[1]
    if seen == "collapse":
        return "gone" if node.tag in ("tr", "tbody", "thead", "tfoot", "col", "colgroup") else "hidden"
    return seen if seen in ("hidden", "visible") else None


def build(html: str, sheet: dict[str, dict[str, tuple]] | None = None) -> Node:
    """The tree of a page; the rules of its style sheets are added to `sheet`."""
    root = Node("html")
    stack = [root]
    where: dict[str, list[int]] = {}  # the places in the stack of each tag's open elements

    def push(node: Node) -> None:
        where.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(k: int) -> None:
        """Closes the elements from place k on."""
        while len(stack) > k:
            where[stack.pop().tag].pop()

    def last(*tags: str) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close(names, scope) -> None:
        """Closes the open elements of these names that lie within the scope, with what is open in them."""
        beyond = last(*scope)
        inner = [own[k] for n in names if (own := where.get(n)) and (k := bisect_right(own, beyond)) < len(own)]
        if inner:
            cut(min(inner))

    def text(raw: str, escaped: bool = True) -> None:
        if stack[-1].tag == "head" and not raw.isspace():
            cut(len(stack) - 1)
        stack[-1].children.append(unescape(raw) if escaped and "&" in raw else raw)

    found = tokens(html)
    moved = None
    while True:
        try:
            kind, tag, attrs, slash, at = found.send(moved)
        except StopIteration:
            return root
        moved = None
        if kind in ("text", "data"):
            if tag:
                text(tag, kind == "text")
            continue
        if kind == "close":
            if tag == "p" and not where.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag not in ("html", "body") and (k := last(tag)) and (tag in TABLE_TAGS or k > last("td", "th", "table")):
                cut(k)
            continue
        if tag == "html":
            continue
        inside = last(*FOREIGN)
        if inside < last("foreignobject"):
            inside = 0
        if inside and tag in BREAKOUT:
            cut(inside)
            inside = 0
        if inside:
            node = Node(tag, attrs if tag not in UNDRAWN else {"hidden": ""})
            stack[-1].children.append(node)
            if not slash:
                push(node)
            continue
        if tag == "body":
            if where.get("body"):
                continue
            cut(1)
        elif tag in BODY_ONLY and stack[-1].tag == "head":
            cut(len(stack) - 1)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, ()))
        elif tag in NO_P:
            close({"p"}, P_SCOPE)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{re.escape(tag)}(?=[ \t\n\f\r/>])[^>]*>?").search(html, at)
            body = html[at : end.start() if end else len(html)]
            if tag == "textarea":
                node.children.append(unescape(body))
            elif tag == "xmp":
                node.children.append(body)
            elif tag == "style" and sheet is not None:
                rules(body, sheet)
            moved = end.end() if end else len(html)
            continue
        if slash and tag in FOREIGN:
            continue
        push(node)


def take_out_hidden(root: Node, sheet: dict[str, dict[str, tuple]] | None = None) -> None:
    """Leaves in the tree what shows, and elements that keep their place without showing."""
    todo = [(root, False)]
    while todo:
        node, dark = todo.pop()
        kept = []
        if node.tag == "details" and "open" not in node.attrs:
            node.children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        for child in node.children:
            if isinstance(child, str):
                if not dark:
                    kept.append(child)
                continue
            state = stands(child, sheet) if sheet or child.attrs or child.tag in UNSEEN or child.tag == "dialog" else None
            hidden = dark if state is None else state == "hidden"
            if state == "gone" or (hidden and child.tag in VOID and child.tag != "br"):
                continue
            kept.append(child)
            if child.children:
                todo.append((child, hidden))
        node.children = kept


def width(text: str) -> int:
    """Columns that a text takes up in a fixed pitch: wide signs two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.started = False
        self.gap = 0
        self.indent: list[str] = []
        self.mark = ""

    def write(self, text: str, pre: bool = False) -> None:
        if pre:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end_line(True)
                if part:
                    self._begin()
                    self.line.append(part)
            return
        parts = _WHITE.sub(" ", text)
        if parts == " ":
            self.space = self.space or bool(self.line)
            return
        if not parts:
            return
        if parts[0] == " ":
            self.space, parts = bool(self.line), parts[1:]
        self._begin()
        if self.space:
            self.line.append(" ")
        self.space = parts[-1] == " "
        self.line.append(parts[:-1] if self.space else parts)

    def _begin(self) -> None:
        if not self.line:
            if self.started:
                self.lines += [""] * self.gap
            self.gap, self.started, self.space = 0, True, False
            self.line.append("".join(self.indent) + self.mark)
            if self.mark:  # further lines of the list item stand under its text
                self.indent[-1] = " " * len(self.mark)
                self.mark = ""

    def end_line(self, forced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        elif forced and self.started:
            self.gap += 1
        self.space = False

    def margin(self) -> None:
        self.end_line()
        self.gap = max(self.gap, 1)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def drawn(svg: Node) -> list[Node]:
    """The texts of a drawing in order; what lies outside of them is not shown."""
    out, todo = [], [svg]
    while todo:
        node = todo.pop()
        if node.tag in ("text", "foreignobject"):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def render(node: Node) -> str:
    """The text of a node whose inner tables have their lines."""
    page = Page()
    stack: list = [(node, None)]
    lists: list[list] = []
    pre = 0
    while stack:
        item, leave = stack.pop()
        if leave is not None:
            leave()
            continue
        if isinstance(item, str):
            page.write(item, pre > 0)
            continue
        tag = item.tag
        if tag == "br":
            page.end_line(True)
            continue
        if tag == "hr":
            page.margin()
            continue
        if tag in VOID:
            if tag == "input" and item.attrs.get("type", "").lower() in ("submit", "button", "reset") and item.attrs.get("value"):
                page.write(item.attrs["value"])
            continue
        if tag == "svg":  # each text stands by itself
            for t in reversed(drawn(item)):
                stack += [(None, page.end_line), *((c, None) for c in reversed(t.children)), (None, page.end_line)]
            continue
        if item.lines is not None:
            page.margin()
            for line in item.lines:
                page.write(line, True)
                page.end_line()
            page.margin()
            continue
        if tag not in BLOCK:
            stack += [(c, None) for c in reversed(item.children)]
            continue
        nested = tag in LISTS and lists
        start = page.margin if tag in MARGIN and not nested else page.end_line
        start()
        after = [start]
        if tag in LISTS:
            first = item.attrs.get("start", "").strip()
            lists.append([tag == "ol", int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1])
            after.append(lists.pop)
        elif tag == "li":
            if lists and lists[-1][0]:
                page.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.mark = "- "
            page.indent.append("")

            def out_of_item():
                page.indent.pop()
                page.mark = ""

            after.append(out_of_item)
        elif tag in ("blockquote", "dd"):
            page.indent.append("  ")
            after.append(page.indent.pop)
        elif tag == "pre":
            pre += 1

            def out_of_pre():
                nonlocal pre
                pre -= 1

            after.append(out_of_pre)
            if item.children and isinstance(item.children[0], str) and item.children[0].startswith("\n"):
                item.children[0] = item.children[0][1:]
        stack += [(None, f) for f in reversed([start, *after[1:]])]
        stack += [(c, None) for c in reversed(item.children)]
    return page.text()


def _inner(children: list) -> list[str]:
    node = Node("div")
    node.children = children
    text = render(node)
    return text.split("\n") if text else []


def _span(cell: Node, name: str, most: int, least: int) -> int:
    said = cell.attrs.get(name, "").strip()
    return min(most, max(least, int(said))) if re.fullmatch(r"[0-9]{1,9}", said) else 1


def _rows(table: Node) -> tuple[list[tuple[int, list[Node]]], list[str]]:
    """(group, cells) of each row as they stand, and the lines that go before: captions and what is in no cell."""
    rows, before = [], []

    def take(children: list, group: int, level: int = 0) -> list[Node]:
        """The cells right among the children of a table (level 0), a part of one (1) or a row (2)."""
        cells, stray = [], []
        for c in children:
            if isinstance(c, Node) and c.tag in CELLS:
                cells.append(c)
            elif isinstance(c, Node) and level < 2 and c.tag == "tr":
                rows.append((group, take(c.children, group, 2)))
            elif isinstance(c, Node) and level < 1 and c.tag in GROUPS:
                own = take(c.children, GROUPS[c.tag], 1)
                if own:
                    rows.append((GROUPS[c.tag], own))
            elif isinstance(c, Node) or c.strip():
                stray.append(c)
        before.extend(_inner(stray) if stray else [])
        return cells

    loose = take(table.children, GROUPS["tbody"])
    if loose:
        rows.append((GROUPS["tbody"], loose))
    return sorted(rows, key=lambda r: r[0]), before


class Taken:
    """Columns that cells from the rows above stand in: pieces (start, end, first free row), apart from each other and in order, and the
    runs that they form, so that the next free column is found without a walk."""

    def __init__(self):
        self.starts: list[int] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.run_starts: list[int] = []
        self.run_ends: list[int] = []
        self.until: dict[int, list[int]] = {}

    def free(self, k: int) -> int:
        """The first free column from k on."""
        r = bisect_right(self.run_starts, k) - 1
        return self.run_ends[r] if r >= 0 and k < self.run_ends[r] else k

    def put(self, a: int, b: int, row: int) -> None:
        """Takes the columns a to b up to the row; where they are taken already, the later row counts."""
        lo = bisect_right(self.starts, a) - 1
        lo = lo + 1 if lo < 0 or self.pieces[lo][1] <= a else lo
        hi = bisect_left(self.starts, b)
        new, at = [], a
        for p, q, old in self.pieces[lo:hi]:  # at most as many as a colspan may cover
            if p < a:
                new.append((p, a, old))
            if at < p:
                new.append((at, p, row))
            new.append((max(p, a), min(q, b), max(old, row)))
            if q > b:
                new.append((b, q, old))
            at = max(at, q)
        if at < b:
            new.append((at, b, row))
        self.pieces[lo:hi], self.starts[lo:hi] = new, [p for p, _, _ in new]
        for p, _, r in new:
            self.until.setdefault(r, []).append(p)
        lo, hi = bisect_left(self.run_ends, a), bisect_right(self.run_starts, b)
        if lo < hi:
            a, b = min(a, self.run_starts[lo]), max(b, self.run_ends[hi - 1])
        self.run_starts[lo:hi], self.run_ends[lo:hi] = [a], [b]

    def release(self, row: int) -> None:
        """Frees what is free from the row on."""
        for p in self.until.pop(row, ()):
            k = bisect_left(self.starts, p)
            if k == len(self.starts) or self.starts[k] != p or self.pieces[k][2] > row:
                continue
            a, b, _ = self.pieces.pop(k)
            del self.starts[k]
            r = bisect_right(self.run_starts, a) - 1
            left, right = (self.run_starts[r], a), (b, self.run_ends[r])
            kept = [x for x in (left, right) if x[0] < x[1]]
            self.run_starts[r : r + 1], self.run_ends[r : r + 1] = [x[0] for x in kept], [x[1] for x in kept]


def table_lines(table: Node) -> list[str]:
    """A table's rows, cells padded to their columns' widths; a cell's own lines stay lines, a span of rows leaves its place free below."""
    rows, out = _rows(table)
    ends = {g: n + 1 for n, (g, _) in enumerate(rows)}  # of each part of the table
    taken, grid, group = Taken(), [], None
    for n, (own_group, cells) in enumerate(rows):
        if own_group != group:
            taken, group = Taken(), own_group
        taken.release(n)
        row, k, below = [], 0, []
        for c in cells:
            k = taken.free(k)
            wide, high = _span(c, "colspan", MAX_COLSPAN, 1), _span(c, "rowspan", 65534, 0) or 65534
            row.append((k, wide, _inner(c.children)))
            if high > 1:
                below.append((k, k + wide, min(n + high, ends[group])))
            k += wide
        for span in below:
            taken.put(*span)
        grid.append(row)
    columns = sorted({k for row in grid for k, _, _ in row})
    widths = dict.fromkeys(columns, 0)
    for row in grid:
        for k, wide, lines in row:
            if bisect_left(columns, k + wide) - bisect_left(columns, k) == 1:  # it spans no other column
                widths[k] = max(widths[k], *map(width, lines)) if lines else widths[k]
    place, at = {}, 0
    for k in columns:
        place[k] = at
        at += widths[k] + 2 if widths[k] else 0  # a column that shows nothing takes no place
    laid, need, held = [], 0, 1000
    for row in grid:
        lines_of: dict[int, list[tuple[int, str]]] = {}
        for k, _, lines in row:
            for h, text in enumerate(lines):
                if text:
                    lines_of.setdefault(h, []).append((place[k], text))
                    held += len(text) + 2
        laid.append([lines_of[h] for h in sorted(lines_of)])
        need += sum(line[-1][0] for line in laid[-1])
    aligned = need <= SPREAD * held
    for row in laid:
        for parts in row:
            line, size = [], 0
            for where, text in parts:
                room = max(where - size if aligned else 0, 2 if size else 0)
                line += [" " * room, text]
                size += room + width(text)
            if joined := "".join(line).rstrip():
                out.append(joined)
    return out


def text_of(html: str | None) -> str:
    if not html:
        return ""
    sheet: dict[str, dict[str, tuple]] = {}
    root = build(html, sheet)
    take_out_hidden(root, sheet)
    tables, todo = [], [(root, 0)]
    while todo:
        node, level = todo.pop()
        if node.tag == "table":
            level += 1
            if level <= DEEP_TABLES:
                tables.append(node)
        todo += [(c, level) for c in node.children if isinstance(c, Node)]
    for table in reversed(tables):  # an inner table comes after the one around it
        table.lines = table_lines(table)
    return render(root)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns of `keep` and text: what each page shows."""
    keep = tuple(c for c in keep if c != "text")
    read = pages.select(*dict.fromkeys([*keep, html_col]))

    def run(batches):
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                made = pa.array([text_of(h) for h in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], names=[*keep, "text"])

    return read.mapInArrow(run, T.StructType([*(read.schema[c] for c in keep), T.StructField("text", T.StringType(), False)]))
