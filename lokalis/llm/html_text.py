"""HTML extraction by layout-aware rendering (operator 3).

A page is scanned into tags and text, a tree is built with the implied tags of the HTML parsing
rules that matter for text (paragraphs, list items, table parts and options close themselves; blocks
close paragraphs), invisible subtrees are left out, and the tree is laid out: a blank line around
paragraphs, headings, lists and tables, a line for other blocks, ``- `` or the number before list
items, indented by depth, preformatted text as it stands. A table's cells are laid out like pages; columns are
as wide as their widest cell, spans over columns and rows are kept, a cell of several lines makes a row of several.

Invisible are elements without a box, the hidden attribute, ``display: none`` and ``visibility`` (which a
descendant may turn back) of inline styles, and those of page styles for a single class, id or tag outside of
at-rules; other selectors are not followed. Of closed ``details`` only the summary is seen.

Time and output are in proportion to the page, whatever its tables and lists: lines are indented by MOST_INDENT
blanks at most, a table's row is padded by MOST_PAD characters a line at most and all of them by 20 times the table's text and
TABLE_PAD (further cells follow each other), and
tables in more than MOST_NESTED others are laid out as blocks. No text is left out for that.

Null and empty pages give an empty text; unclosed and stray tags are repaired, never an error; a tag that never
ends is text. Repeated rows give equal rows; other columns are ignored. Deep nesting is laid out without recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts

#: The roles of HTML's elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style template noscript iframe object embed audio video canvas datalist title noframes noembed input".split())
#: Inside MathML and SVG: what is not drawn where it stands.
UNDRAWN = frozenset("annotation annotation-xml desc metadata defs symbol clippath mask pattern marker".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())
BLOCK = SPACED | frozenset("html body div section article nav header footer main aside address form fieldset figcaption li dt dd tr caption thead tbody tfoot center details summary legend hgroup search optgroup option dialog".split())
CELL = frozenset(("td", "th"))
#: A start tag closes the open elements of its set that are above (inside) the nearest of its fence.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
FENCES = frozenset("table td th caption html template object button".split())
#: What an end tag may not reach beyond: of table parts the table, of a table nothing but the page, else FENCES.
TABLE_PARTS = frozenset("tr td th thead tbody tfoot caption".split())
#: The most columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Limits of what layout adds to the text: blanks before a line, characters that align the cells of a line, and of a table besides 20 times its text, tables around one that is drawn as a grid.
MOST_INDENT, MOST_PAD, TABLE_PAD, MOST_NESTED = 80, 2000, 20_000, 20

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quotes count only behind an equals sign. Possessive, so that no text is tried twice.
REST = re.compile(r"((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)(\s*!\s*important)?", re.I)
SIMPLE = re.compile(r"[.#]?-?[a-zA-Z_][\w-]*")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "kids", "hidden", "start", "foreign", "para", "ghost", "names", "spans", "lines", "flat")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1, parent: Node | None = None):
        self.tag, self.kids, self.hidden, self.start = tag, [], hidden, start
        #: "math", "svg" or "text" (SVG text) inside these; and whether a paragraph is open here.
        self.foreign = tag if tag in ("math", "svg") else "" if parent is None or tag == "foreignobject" else "text" if tag == "text" and parent.foreign == "svg" else parent.foreign
        self.para = tag == "p" or (parent is not None and parent.para and tag not in FENCES)
        #: Own visibility (None: as around it), what page styles know it by, columns and rows spanned, lines of a table.
        self.ghost: bool | None = None
        self.names: tuple[str, ...] = ()
        self.spans = (1, 1)
        self.lines: list[str] | None = None
        #: A table that is laid out as a block, or closed details.
        self.flat = False


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def declared(style: str) -> tuple[bool, bool | None]:
    """(not displayed, invisible or None if that isn't said) of declarations; the last important one counts, else the last."""
    said: dict[str, str] = {}
    firm: set[str] = set()
    for m in DECLARED.finditer(style):
        name = m[1].lower()
        if m[3] or name not in firm:
            said[name] = m[2].lower()
        if m[3]:
            firm.add(name)
    return said.get("display") == "none", said["visibility"] in ("hidden", "collapse") if "visibility" in said else None


def style_rules(css: str) -> dict[str, tuple[bool, bool | None]]:
    """What a page style says of single classes, ids and tags, outside of at-rules."""
    css, out = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S), {}
    depth, at, prelude = 0, 0, ""
    for m in re.finditer(r"[{};]", css):
        if m[0] == "{":
            if depth == 0:
                prelude, at = css[at : m.start()].strip(), m.end()
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                if not prelude.startswith("@"):
                    said = declared(css[at : m.start()])
                    if said != (False, None):
                        out |= {x.strip(): said for x in prelude.split(",") if SIMPLE.fullmatch(x.strip())}
                at = m.end()
        elif depth == 0:  # the end of an at-rule without a block
            at = m.end()
    return out


def number(text: str, most: int, least: int = 1) -> int:
    return min(most, max(least, int(text))) if re.fullmatch(r"\d{1,9}", text) else 1


class Builder:
    """The open elements, with the places of each tag among them, so that no search walks over the stack."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}
        self.rules: dict[str, tuple[bool, bool | None]] = {}
        self.tables: list[Node] = []

    def open(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags, fence) -> None:
        """Close the elements of ``tags`` above the last one of ``fence``."""
        while (k := self.last(tags)) > self.last(fence):
            self.cut(k)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].kids.append(Node("br"))
        elif tag not in ("html", "body"):
            fence = {"table"} if tag in TABLE_PARTS else FENCES - {tag} if tag != "table" else {"html"}
            if (k := self.last((tag,))) > self.last(fence):
                self.cut(k)

    def start(self, tag: str, rest: str, closed: bool) -> Node:
        attrs = attributes(rest) if rest and not rest.isspace() else {}
        if self.stack[-1].tag == "head" and tag not in HIDDEN and tag not in ("meta", "link", "base"):
            self.cut(len(self.stack) - 1)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag in BLOCK and self.stack[-1].para:
            self.close({"p"}, FENCES)
        if tag in CELL and self.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", parent=self.stack[-1])
            self.stack[-1].kids.append(row)
            self.open(row)
        above = self.stack[-1]
        first = attrs.get("start" if tag == "ol" else "value", "") if tag in ("ol", "li") else ""
        node = Node(tag, parent=above, start=int(first) if re.fullmatch(r"-?\d{1,9}", first) else (1 if tag == "ol" else -1))
        gone, node.ghost = declared(attrs["style"]) if "style" in attrs else (False, None)
        node.hidden = gone or tag in HIDDEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or (tag in UNDRAWN and above.foreign != "")
        if "class" in attrs or "id" in attrs:
            node.names = (*(f".{c}" for c in attrs.get("class", "").split()), f"#{attrs.get('id', '')}")
        if tag in CELL and ("colspan" in attrs or "rowspan" in attrs):
            node.spans = number(attrs.get("colspan", ""), MOST_COLUMNS), number(attrs.get("rowspan", ""), MOST_ROWS, 0)
        if tag == "table":
            node.flat = len(self.places.get("table", ())) > MOST_NESTED
            if not node.flat:
                self.tables.append(node)
        elif tag == "details":
            node.flat = "open" not in attrs
        if tag == "img" and attrs.get("alt"):  # inside the image's node, so that its visibility holds
            node.kids.append(attrs["alt"].replace("&", "&amp;"))
        above.kids.append(node)
        if tag not in RAW and tag not in VOID and not (closed and node.foreign):  # a slash at its end does not close an HTML element
            self.open(node)
        return node


_ends: dict[str, re.Pattern] = {}


def build(html: str) -> Builder:
    """The tree of a page: nodes and, for text, strings."""
    b = Builder()
    pos, n = 0, len(html)
    last_gt = html.rfind(">")
    simple = False  # after a tag that doesn't end, tags end at the next >

    def text(lo: int, hi: int) -> None:
        if hi > lo:
            if b.stack[-1].tag == "head" and not html[lo:hi].isspace():
                b.cut(len(b.stack) - 1)
            b.stack[-1].kids.append(html[lo:hi])

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0 or lt > last_gt and not html.startswith("<!", lt):
            text(pos, n)
            break
        c = html[lt + 1 : lt + 2]
        if c in ("!", "?"):
            text(pos, lt)
            end = html.find("-->", lt + 4) + 3 if html.startswith("<!--", lt) else html.find(">", lt) + 1
            if html.startswith(("<!-->", "<!--->"), lt):
                end = html.find(">", lt) + 1
            pos = end if end > lt else n
            continue
        m = NAME.match(html, lt)
        if m is None and c == "/" and html[lt + 2 : lt + 3]:  # an end tag without a name is a comment
            text(pos, lt)
            pos = html.find(">", lt) + 1
            continue
        if m is None:  # a bare less-than sign is text
            text(pos, lt + 1)
            pos = lt + 1
            continue
        text(pos, lt)
        rest = None if simple else REST.match(html, m.end())
        if rest is None:
            simple = True
            pos = html.find(">", m.end()) + 1
            inside = html[m.end() : pos - 1]
        else:
            pos, inside = rest.end(), rest[1]
        tag = m[1].lower()
        if c == "/":
            b.end(tag)
        elif tag != "html":
            closed = inside.endswith("/")
            node = b.start(tag, inside, closed)
            if tag in RAW and not (closed and node.foreign):
                if tag not in _ends:
                    _ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
                end = _ends[tag].search(html, pos)
                node.kids.append(html[pos : end.start() if end else n])
                pos = end.end() if end else n
                if tag == "style":
                    b.rules |= style_rules(node.kids[0])
    return b


class Page:
    """Lines under construction: inline text is collected, blocks flush it, ``gap`` asks for a blank line before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.indent = 0
        self.marker = ""

    def flush(self) -> None:
        if not self.inline:
            return
        text = "".join(self.inline)
        self.inline = []
        if text.rstrip(" \t\n\r\f").endswith("\v"):  # a break that ends a block makes no line of its own
            text = text.rstrip(" \t\n\r\f")[:-1]
        for k, part in enumerate(text.split("\v")):
            part = SPACE.sub(" ", part).strip(" ")
            if part or k:
                self.put(part)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        mark, self.marker = self.marker, " " * len(self.marker) if self.marker else ""
        self.lines.append(f"{' ' * min(self.indent, MOST_INDENT)}{mark}{line}".rstrip())

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap |= spaced


class Covered:
    """Columns that cells of rows above still cover: disjoint intervals, each until a row, and the runs that they make together."""

    def __init__(self) -> None:
        self.begin: list[int] = []
        self.end: list[int] = []
        self.until: list[int] = []
        self.runs: tuple[list[int], list[int]] = ([], [])
        self.queue: list[tuple[int, int]] = []

    def free(self, at: int) -> int:
        """The first column from ``at`` on that is not covered."""
        begin, end = self.runs
        k = bisect_right(begin, at) - 1
        return end[k] if k >= 0 and end[k] > at else at

    def cover(self, lo: int, hi: int, until: int) -> None:
        a, b = bisect_right(self.end, lo), bisect_left(self.begin, hi)
        new, at = [], lo
        for x, y, u in zip(self.begin[a:b], self.end[a:b], self.until[a:b]):  # what is there stays covered at least as long
            new += [(x, lo, u)] if x < lo else [(at, x, until)] if at < x else []
            new.append((max(x, lo), min(y, hi), max(u, until)))
            new += [(hi, y, u)] if y > hi else []
            at = min(y, hi)
        new += [(at, hi, until)] if at < hi else []
        self.begin[a:b], self.end[a:b], self.until[a:b] = map(list, zip(*new))
        for x, _, u in new:
            heappush(self.queue, (u, x))
        begin, end = self.runs
        a, b = bisect_left(end, lo), bisect_right(begin, hi)
        if a < b:
            lo, hi = min(lo, begin[a]), max(hi, end[b - 1])
        begin[a:b], end[a:b] = [lo], [hi]

    def row(self, number: int) -> None:
        """Let go of what ends before this row."""
        while self.queue and self.queue[0][0] <= number:
            until, lo = heappop(self.queue)
            k = bisect_left(self.begin, lo)
            if k == len(self.begin) or self.begin[k] != lo or self.until[k] != until:
                continue  # covered anew since
            hi = self.end[k]
            del self.begin[k], self.end[k], self.until[k]
            begin, end = self.runs
            k = bisect_right(begin, lo) - 1
            left = [(x, y) for x, y in ((begin[k], lo), (hi, end[k])) if x < y]
            begin[k : k + 1], end[k : k + 1] = [x for x, _ in left], [y for _, y in left]


def row_lines(cells: list[tuple[int, int, list[str]]], at: list[int], purse: list[int]) -> list[str]:
    """A row's lines: cells (first column, column behind, lines) padded to where columns begin (``at``), by MOST_PAD characters a line and by ``purse`` in the table at most."""
    here: list[list[int]] = [[] for _ in range(max((len(c[2]) for c in cells), default=0))]
    for i, (_, _, lines) in enumerate(cells):
        for k in range(len(lines)):
            here[k].append(i)
    out = []
    blank = lambda lo, hi: [" " * (at[c + 1] - at[c] - 3) + " | " for c in range(lo, hi)]
    for k, present in enumerate(here):
        most = left = min(MOST_PAD, purse[0])
        parts, column, i = [], 0, 0
        for j in [*present, len(cells)]:
            while i < j and left > 0:  # cells without this line
                first, behind, _ = cells[i]
                left -= at[behind] - at[column]
                if left > 0:
                    parts += [*blank(column, first), " " * (at[behind] - at[first] - 3) + " | "]
                    column = behind
                i += 1
            if j == len(cells):
                break
            first, behind, lines = cells[j]
            if first > column:
                left -= at[first] - at[column]
                parts += blank(column, first) if left > 0 else ["| "]
            pad = at[behind] - at[first] - 3 - len(lines[k])
            left -= pad
            parts.append(lines[k] + (" " * pad if left > 0 else "") + " | ")
            column, i = behind, j + 1
        purse[0] -= most - max(left, 0)
        text = "".join(parts)[:-3].rstrip() if i == len(cells) else "".join(parts).rstrip()
        out.append(text if text.strip(" |") else "")
    return out


def table_lines(table: Node, rules: dict) -> list[str]:
    """Rows of a table on a grid of columns; a cell's lines are padded to the widths of the columns that it spans."""
    rows: list[list[tuple[int, int, list[str]]]] = []  # first column, columns spanned, lines
    captions: list[str] = []
    todo = list(reversed(table.kids))
    covered = Covered()
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if not node.isspace():
                captions.append(SPACE.sub(" ", unescape(node)).strip())
        elif unseen(node, rules):
            continue
        elif node.tag == "tr":
            row, at = [], 0
            below = []
            covered.row(len(rows))
            for c in node.kids:
                if isinstance(c, str) and c.isspace() or isinstance(c, Node) and unseen(c, rules):
                    continue
                at = covered.free(at)
                lines = render(c, rules).split("\n") if isinstance(c, Node) else [SPACE.sub(" ", unescape(c)).strip()]
                wide, deep = c.spans if isinstance(c, Node) else (1, 1)
                row.append((at, wide, lines))
                if deep != 1:
                    below.append((at, at + wide, len(rows) + (deep or MOST_ROWS)))
                at += wide
            for lo, hi, until in below:
                covered.cover(lo, hi, until)
            rows.append(row)
        elif node.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(node.kids)
        else:
            captions += render(node, rules).split("\n")
    starts = sorted({at for row in rows for at, *_ in row})  # columns in which no cell begins have no width
    place = {at: k for k, at in enumerate(starts)}
    width = [0] * len(starts)
    spanning = []
    for row in rows:
        for at, wide, lines in row:
            k, to = place[at], bisect_left(starts, at + wide)
            need = max(map(len, lines))
            if to - k <= 1:
                width[k] = max(width[k], need)
            else:
                spanning.append((to - k, k, to, need))
    for _, k, to, need in sorted(spanning):
        width[to - 1] += max(0, need - sum(width[k:to]) - 3 * (to - k - 1))
    begins = list(accumulate((w + 3 for w in width), initial=0))
    out, purse = [], [TABLE_PAD + 20 * sum(len(x) for row in rows for *_, lines in row for x in lines)]
    for row in rows:
        out += row_lines([(place[at], bisect_left(starts, at + wide), lines) for at, wide, lines in row], begins, purse)
        if out and not out[-1]:
            out.pop()
    return [c for c in captions if c] + out


def unseen(node: Node, rules: dict) -> bool:
    return node.hidden or bool(rules) and any(rules[x][0] for x in (node.tag, *node.names) if x in rules)


def seen_of(details: Node) -> list:
    """What is seen of details: all if they are open, else the summary."""
    return details.kids if not details.flat else next(([k] for k in details.kids if isinstance(k, Node) and k.tag == "summary"), [])


def ghostly(node: Node, rules: dict, around: bool) -> bool:
    """Whether the text right inside is invisible, though elements inside may be visible."""
    said = [rules[x][1] for x in (node.tag, *node.names) if x in rules] if rules else []
    own = node.ghost if node.ghost is not None else next((x for x in reversed(said) if x is not None), None)
    return around if own is None else own


def render(root: Node, rules: dict) -> str:
    """Lay the tree out; an explicit stack, so depth is no limit. Tables inside have been laid out before."""
    page = Page()
    todo: list[tuple] = [("open", root, 0, None, False)]
    while todo:
        what, node, depth, counter, ghost = todo.pop()
        if what == "close":
            page.block(node.tag in SPACED and not (node.tag in ("ul", "ol", "menu") and depth > 1))
            if node.tag == "li":
                page.marker = ""
            page.indent = counter
            continue
        if isinstance(node, str):
            if not ghost:
                page.inline.append(unescape(node) if "&" in node else node)
            continue
        if unseen(node, rules):
            continue
        tag = node.tag
        ghost = ghostly(node, rules, ghost)
        if tag == "br":
            page.inline.append("\v")
        elif tag == "hr":
            page.block(True)
        elif tag in ("pre", "textarea"):
            page.block(True)
            for line in plain(node, rules, ghost).strip("\n").split("\n"):
                page.put(line)
            page.gap = True
        elif tag == "table" and node is not root and not node.flat:
            page.block(True)
            for line in [] if ghost else node.lines or []:
                page.put(line)
            page.gap = True
        elif tag in BLOCK or tag in CELL:
            nested = tag in ("ul", "ol", "menu") and depth > 0
            page.block(tag in SPACED and not nested)
            todo.append(("close", node, depth + (tag in ("ul", "ol", "menu")), page.indent, ghost))
            if tag == "li":
                page.marker = f"{counter}. " if counter is not None else "- "
            elif nested or tag in ("blockquote", "dd"):
                page.indent += 2
            inner = depth + (tag in ("ul", "ol", "menu"))
            number, kids = node.start, []
            for k in seen_of(node) if tag == "details" else node.kids:
                if tag == "ol" and isinstance(k, Node) and k.tag == "li":
                    number = k.start if k.start >= 0 else number
                    kids.append(("open", k, inner, number, ghost))
                    number += 1
                else:
                    kids.append(("open", k, inner, None, ghost))
            todo += reversed(kids)
        elif node.foreign in ("svg", "text"):  # of SVG, text elements are drawn as text, each by itself
            kids = node.kids if node.foreign == "text" else [k for k in node.kids if isinstance(k, Node)]
            todo += [("open", k, depth, None, ghost) for k in reversed([" ", *kids, " "] if tag in ("text", "svg") else kids)]
        else:
            todo += [("open", k, depth, None, ghost) for k in reversed(node.kids)]
    page.flush()
    return "\n".join(page.lines)


def plain(node: Node, rules: dict, around: bool) -> str:
    out, todo = [], [(node, around)]
    while todo:
        x, ghost = todo.pop()
        if isinstance(x, str):
            if not ghost:
                out.append(unescape(x))
        elif x.tag == "br":
            out.append("\n")
        elif not unseen(x, rules) or x is node:
            todo += [(k, ghostly(x, rules, ghost)) for k in reversed(x.kids)]
    return "".join(out)


def visible_text(html: str) -> str:
    if not html:
        return ""
    tree = build(html)
    for table in reversed(tree.tables):  # inner ones first
        table.lines = table_lines(table, tree.rules)
    return render(tree.root, tree.rules)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text`` of each page: all its visible text, laid out."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([visible_text(h) for h in texts(batch, "html")], pa.string())], ["id", "text"])

    kept = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)
