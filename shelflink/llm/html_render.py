"""HTML to visible text with its layout.

A tokenizer cuts tags from text; a tree builder supplies what the markup leaves out (end tags
that a following tag implies, void elements, stray end tags); a renderer walks the tree, skips
what a browser would not show, and writes block spacing, list markers and table columns.
Pages are independent: the work is one ``mapInPandas`` pass over the rows, page by page, with
no shuffle and memory bounded by one page.  All steps use explicit stacks, so depth is no limit.

Edge cases: null or empty html gives empty text; html without tags is its own text, entities
decoded; an unclosed comment or raw-text element runs to the end of the page, as in browsers;
repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas param source track".split())
#: Parts of drawings and formulas that are not shown as text where they stand.
HIDDEN |= frozenset("defs desc metadata symbol clippath mask annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tbody thead tfoot tr".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr".split())
#: Start tag -> open elements it ends, and the elements that stop the search for them.
IMPLIED_END = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "thead": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED_END = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED_END.items()}
ENDS_P = BLOCKS - frozenset("body html caption tbody thead tfoot tr option optgroup legend".split())
P_SCOPE = frozenset("td th table button caption html body li".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?/]")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SHOWN = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_MARK = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


class Tags:
    """The tags of a page in order.  Every search goes forward from where the last one ended: where
    no > follows, no tag is looked for; after a quote that never closes, quotes protect no more."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        place = at
        while self.quoted:
            stop = _STOP.search(self.page, place)
            if stop and stop[0] == ">":
                return stop.end()
            close = self.page.find(stop[0], stop.end()) if stop else -1
            if close < 0:
                self.quoted = False
            place = close + 1
        return self.page.find(">", at) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, "/" if closing, name, attributes) of the next tag; comments and
        declarations have no name."""
        while (found := _OPEN.search(self.page, at)) is not None:
            if found[0] == "<!--":
                close = self.page.find("-->", found.end())
                return found.start(), close + 3 if close >= 0 else len(self.page), "", "", ""
            if found.end() <= self.last:
                if not found[2]:
                    return found.start(), self.page.find(">", found.end()) + 1, "", "", ""
                end = self._end(found.end())
                return found.start(), end, found[1], found[2], self.page[found.end() : end - 1]
            at = found.end()
        return None


def build_tree(page: str) -> Node:
    """The page as nodes and strings, with implied tags supplied."""
    root = Node("#root")
    stack, at, open_, tags = [root], 0, Counter(), Tags(page)

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            open_[node.tag] -= 1
        del stack[depth:]

    def close(ended: frozenset[str], stop: frozenset[str]) -> None:
        """End all open ``ended`` tags down to the nearest of ``stop``; nothing is searched when none is open."""
        depth = len(stack) - 1
        while depth > 0 and any(open_[t] for t in ended) and stack[depth].tag not in stop:
            if stack[depth].tag in ended:
                cut(depth)
            depth -= 1

    while at < len(page):
        found = tags.next(at)
        if found is None:
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        start, end, closing, name, rest = found
        if start > at:
            stack[-1].children.append(entities.unescape(page[at:start]))
        at = end
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag == "br":  # browsers read a stray </br> as <br>
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not open_["p"]:
                stack[-1].children.append(Node("p"))
            else:
                for depth in range(len(stack) - 1 if open_[tag] else 0, 0, -1):
                    if stack[depth].tag == tag:
                        cut(depth)
                        break
                    if tag not in ("table", "body", "html") and stack[depth].tag in ("td", "th", "table") and tag not in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                        break
            continue
        if tag in ENDS_P:
            close(frozenset(("p",)), P_SCOPE)
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
        attributes = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(entities.unescape(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1
    return root


def _screen(condition: str) -> bool:
    """Whether a media query list holds on any screen: no width or other feature, no other medium."""
    return any(re.fullmatch(r"(?:only\s+)?(?:all|screen)|", x.strip()) for x in condition.lower().split(","))


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) that hold on every screen, in order.  Blocks of @-rules that depend
    on a condition are skipped whole; those of @layer and of @media for screens are read."""
    sheet, selectors = _COMMENT.sub(" ", sheet), ""
    at, skipped, depth = 0, 0, 0  # skipped: the depth at which a block is left out, if any
    for mark in _MARK.finditer(sheet):
        if mark[0][0] in "\"'":
            continue
        head = sheet[at : mark.start()].strip()
        if mark[0] == "{":
            depth += 1
            name = re.match(r"@([\w-]+)\s*(.*)", head, re.S)
            if name and not skipped and not (name[1].lower() == "layer" or name[1].lower() == "media" and _screen(name[2])):
                skipped = depth
            selectors = "" if name else head
        elif mark[0] == "}":
            if not skipped and selectors:
                yield selectors, head
            selectors, skipped, depth = "", 0 if skipped >= depth else skipped, max(0, depth - 1)
        elif selectors or skipped:  # a semicolon inside declarations
            continue
        at = mark.end()


def hidden_selectors(root: Node) -> dict[str, dict[str, tuple[bool, bool, int]]]:
    """Simple selectors (tag, .class, #id) of the page's own style sheets, with what the last rule
    says on display and visibility: (important, hides, place)."""
    sheets, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and _screen(node.attributes.get("media", "")):
            sheets.append("".join(node.children))
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    found, place = {}, 0
    for sheet in sheets:
        for selectors, body in _rules(sheet):
            said = _said(body)
            for s in (x.strip().lower() for x in selectors.split(",")) if said else ():
                if re.fullmatch(r"[.#]?[\w-]+", s):
                    for what, (important, hides) in said.items():
                        place += 1
                        last = found.setdefault(s, {}).get(what)
                        if last is None or important >= last[0]:
                            found[s][what] = (important, hides, place)
    return found


def _said(declarations: str) -> dict[str, tuple[bool, bool]]:
    """What declarations say on display and visibility: (important, hides)."""
    said = {}
    for m in _SHOWN.finditer(declarations):
        now = (bool(m[3]), m[2].lower() in ("none", "hidden", "collapse"))
        if now >= (said.get(m[1].lower(), now)[0], False):
            said[m[1].lower()] = now
    return said


def visible(node: Node, selectors: dict[str, dict[str, tuple[bool, bool, int]]]) -> bool:
    """Of all rules for the node the most specific one (id, class, tag) counts, of these the last;
    its own style attribute comes before them, and what is important before all."""
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "dialog" and "open" not in a:
        return False
    own = _said(a.get("style", ""))
    names = [(1, node.tag), (3, "#" + a["id"].lower()) if "id" in a else (0, ""), *((2, "." + c) for c in a.get("class", "").lower().split())] if selectors else []
    for what in ("display", "visibility"):
        rules = [(x[0], rank, x[2], x[1]) for rank, s in names if (x := selectors.get(s, {}).get(what))]
        if what in own:
            rules.append((own[what][0], 4, 0, own[what][1]))
        elif what == "display" and "hidden" in a:
            rules.append((False, 0, 0, True))
        if rules and max(rules)[3]:
            return False
    return True


class Page:
    """Lines of text; a block break ends the line, a spaced one leaves an empty line."""

    def __init__(self):
        self.lines, self.line, self.gap, self.indent, self.marker = [], [], False, 0, ""

    def text(self, words: str, pre: bool) -> None:
        if pre:
            first, *rest = words.split("\n")
            self.line.append(first)
            for more in rest:
                self.end(force=True)
                self.line.append(more)
            return
        words = _SPACE.sub(" ", words)
        if words == " " and not self.line:
            return
        if words.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            words = words[1:]
        if words:
            self.line.append(words)

    def end(self, spaced: bool = False, force: bool = False) -> None:
        line = "".join(self.line).rstrip(" \t\r\f")
        self.line = []
        if line or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = " " * max(0, self.indent - len(self.marker)) + self.marker
            self.marker = ""
            self.lines.append((lead + line).rstrip())
        self.gap = self.gap or spaced

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _span(cell: Node, name: str, most: int) -> int:
    span = cell.attributes.get(name, "1").strip()
    return min(int(span), most) if re.fullmatch(r"[0-9]{1,9}", span) and int(span) else 1


def _cells(table: Node, selectors: dict) -> tuple[list[Node], list[list[tuple[Node | None, int]]]]:
    """Captions, and rows of (cell, colspan), None for what a cell above covers, of the table itself and not of tables inside it."""
    captions, rows, todo = [], [], [iter(table.children)]
    groups: list[int] = [0]  # where a group of rows begins; no rowspan goes beyond it
    loose: list[tuple[Node, int]] = []
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            groups.append(len(rows))
        elif not isinstance(child, Node) or not visible(child, selectors):
            if isinstance(child, str) and child.strip():
                captions.append(Node("div"))
                captions[-1].children.append(child)
        elif child.tag == "tr":
            cells = []
            for cell in child.children:
                if isinstance(cell, Node) and visible(cell, selectors):
                    cells.append((cell, _span(cell, "colspan", 1000)))
                elif isinstance(cell, str) and cell.strip():
                    cells.append((Node("td"), 1))
                    cells[-1][0].children.append(cell)
            rows.append(cells)
        elif child.tag in ("tbody", "thead", "tfoot"):
            groups.append(len(rows))
            todo.append(iter(child.children))
        elif child.tag in ("td", "th"):  # a row's tag is implied
            if not rows or rows[-1] is not loose:
                loose = []
                rows.append(loose)
            loose.append((child, _span(child, "colspan", 1000)))
        elif child.tag not in ("colgroup", "col"):
            captions.append(child)
    return captions, _spread(rows, set(groups))


def _spread(rows: list[list[tuple[Node, int]]], groups: set[int]) -> list[list[tuple[Node | None, int]]]:
    """Rows with an empty place wherever a cell of an earlier row reaches down."""
    out, down = [], {}  # column -> rows that its cell still covers
    for at, row in enumerate(rows):
        down = {} if at in groups else {k: n - 1 for k, n in down.items() if n > 1}
        cells, column = [], 0
        for cell, span in row:
            while column in down:
                cells.append((None, 1))
                column += 1
            cells.append((cell, span))
            rest = 65534 if cell.attributes.get("rowspan", "").strip() == "0" else _span(cell, "rowspan", 65534)
            if rest > 1:
                down |= {k: rest for k in range(column, column + span)}
            column += span
        out.append(cells)
    return out


def _run(task: Iterator) -> None:
    """A walk and the walks that it yields, on a stack of their own."""
    tasks = [task]
    while tasks:
        try:
            tasks.append(next(tasks[-1]))
        except StopIteration:
            tasks.pop()


def _table(page: Page, table: Node, selectors: dict) -> Iterator:
    """Columns as wide as their widest line; a cell of several lines takes several lines."""
    captions, rows = _cells(table, selectors)
    for caption in captions:
        yield _walk(page, caption, selectors)
        page.end()
    drawn = []
    for row in rows:
        cells = []
        for cell, span in row:
            inner = Page()
            if cell is not None:
                yield _walk(inner, cell, selectors)
            cells += [inner.result().split("\n")] + [[""]] * (span - 1)
        drawn.append(cells)
    widths = [max((len(x) for r in drawn if k < len(r) for x in r[k]), default=0) for k in range(max(map(len, drawn), default=0))]
    for cells in drawn:
        for k in range(max(map(len, cells), default=0)):
            line = " | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, widths)).rstrip(" |")
            if line:
                page.line.append(line)
                page.end()


def _walk(page: Page, top: Node, selectors: dict) -> Iterator:
    """Depth-first; tables and their cells, which are pages of their own, are yielded as walks."""
    stack: list = [("open", top, False, "")]
    while stack:
        what, node, pre, marker = stack.pop()
        if what == "close":
            page.end(spaced=node.tag in SPACED and not (node.tag in ("ul", "ol") and page.indent > 2))
            if node.tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
                page.indent -= 2
            continue
        if isinstance(node, str):
            page.text(node, pre)
            continue
        if node is not top and not visible(node, selectors):
            continue
        tag = node.tag
        if tag == "br":
            page.end(force=True)
        elif tag == "hr":
            page.end(spaced=True)
        elif tag == "wbr" or tag == "input" and node.attributes.get("type", "").lower() in ("hidden", "checkbox", "radio", "password", "file", "image"):
            pass
        elif tag == "input":
            page.text(" " + entities.unescape(node.attributes.get("value", "")) + " ", False)
        elif tag == "table":
            page.end(spaced=True)
            yield _table(page, node, selectors)
            page.end(spaced=True)
        elif tag not in VOID:
            block = tag in BLOCKS
            if block:
                page.end(spaced=tag in SPACED and not (tag in ("ul", "ol") and page.indent))
                stack.append(("close", node, pre, ""))
                if tag in ("ul", "ol", "menu", "dir", "blockquote", "dd"):
                    page.indent += 2
                if marker:
                    page.marker = marker
            elif tag in ("td", "th", "text", "mtd"):  # labels of a drawing and cells of a matrix stand apart
                page.text(" ", False)
            pre = pre or tag in ("pre", "textarea", "xmp")
            number, todo = node.attributes.get("start", "1"), []
            number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
            for child in node.children:
                mark = ""
                if isinstance(child, Node) and child.tag == "li":
                    mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                todo.append(("open", child, pre, mark))
            stack += reversed(todo)


def render(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    root = build_tree(page)
    out = Page()
    _run(_walk(out, root, hidden_selectors(root)))
    return out.result()


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [render(p) for p in batch["html"]]
            out = batch[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
