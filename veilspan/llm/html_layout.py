"""Text of web pages as a reader sees it.

A tree is built with the tags that HTML lets authors leave out; elements that are not
displayed are passed over; the rest is laid out as text: blocks on lines of their own
with blank lines where browsers leave room, list items with their marks, table cells in
aligned columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
STYLE_PART = re.compile(r"([^{};]*)([{};])")
SIMPLE_SELECTOR = re.compile(r"^([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)$", re.IGNORECASE)
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)\s*(!\s*important)?", re.IGNORECASE)
SHEET_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)\s*(!\s*important)?", re.IGNORECASE)
#: Groups of rules that hold on a screen of any size.
SHOWN_GROUP = re.compile(r"@(?:supports\b|layer\b|media\s+(?:(?:only\s+)?(?:screen|all)\s*(?:,|$)|[^()]*,\s*(?:screen|all)\s*(?:,|$)))", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
SPACE = re.compile(r"[ \t\n\r\f]+")

# What HTML says of its elements (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(
    "script style title head template iframe noembed noframes datalist audio video canvas object meta link base".split()
)
#: Not shown inside an element of the first name.
UNSEEN_INSIDE = {
    "math": frozenset("annotation annotation-xml".split()),
    "svg": frozenset("defs title desc metadata symbol clippath mask marker pattern lineargradient radialgradient".split()),
}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table "
    "tbody tfoot thead tr ul caption xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir hr fieldset xmp".split())
CLOSES_P = BLOCKS - frozenset("body html option optgroup tbody tfoot thead tr caption".split())
#: Opening the first closes the open elements of the second, up to a border of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
HEAD_ONLY = frozenset("base link meta title script style template noscript head html body".split())
#: An end tag does not reach over these.
SCOPES = frozenset("table td th caption html template".split())
#: Blanks that aligned columns may take, beside so many for each character of the page; tables beyond
#: it have columns of at most ``NARROW`` characters, out of which longer cells stick.
BLANKS, BLANKS_EACH, NARROW = 1 << 20, 8, 40
#: Tables within so many others are laid out as running text.
DEEPEST_TABLE = 100
MOST_SPAN = 1000


class Node:
    __slots__ = ("attrs", "children", "inside", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], inside: str = "") -> None:
        self.tag, self.attrs, self.children, self.inside = tag, attrs, [], inside


def _inside(parent: Node) -> str:
    """The drawing or formula that children of ``parent`` are parts of; HTML may come again within."""
    return "" if parent.tag == "foreignobject" else parent.tag if parent.tag in UNSEEN_INSIDE else parent.inside


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def build_tree(source: str) -> tuple[Node, str]:
    """The document's tree and the text of its style sheets."""
    root = Node("html", {})
    stack, sheets, at = [root], [], 0
    opened: Counter[str] = Counter()  # so that the stack is searched only for what is in it

    def cut(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def close(tags: set[str], borders: set[str]) -> None:
        while any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    break
                if stack[i].tag in borders:
                    return
            else:
                return

    def text(part: str) -> None:
        if part:
            if stack[-1].tag == "head" and part.strip():
                cut(len(stack) - 1)
            stack[-1].children.append(part)

    size = len(source)
    while at < size:
        found = TOKEN.search(source, at)
        if not found:
            text(html.unescape(source[at:]))
            break
        text(html.unescape(source[at : found.start()]))
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag:
            if found["cdata"]:
                text(found["cdata"])
            continue
        if found["end"]:
            if not opened[tag]:
                if tag in ("p", "br"):
                    stack[-1].children.append(Node(tag, {}))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            continue
        attrs = _attributes(found["attrs"])
        if tag == "html":
            root.attrs = attrs | root.attrs
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close({"p"}, SCOPES | {"button", "foreignobject", "annotation-xml"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attrs, _inside(stack[-1]))
        stack[-1].children.append(node)
        if found["attrs"].endswith("/") and (node.inside or tag in UNSEEN_INSIDE):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
            inner = source[at : end.start()] if end else source[at:]
            at = end.end() if end else size
            if tag == "style":
                sheets.append(inner)
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    return root, "\n".join(sheets)


def sheet_rules(sheet: str) -> list[tuple]:
    """Rules of a style sheet on what is displayed and visible, by what weighs least first.

    Each has a simple selector (tag, classes, ids) and what it says: displayed and visible, true,
    false or None. Rules for print, for screens of some sizes only, and of key frames say nothing.
    """
    found, groups, selectors = [], [], ""
    for m in STYLE_PART.finditer(re.sub(r"/\*.*?\*/", "", sheet, flags=re.DOTALL)):
        before, mark = m[1].strip(), m[2]
        if mark == "{":
            group = before.startswith("@")
            groups.append((bool(SHOWN_GROUP.match(before)) if group else True, before, []))
        elif groups:
            groups[-1][2].append(before)
            if mark == "}":
                _, selectors, body = groups.pop()
                if not selectors.startswith("@") and all(g[0] and g[1].startswith("@") for g in groups):
                    found += _rules_of(selectors, "; ".join(body), len(found))
    return [rule[1:] for rule in sorted(found, key=lambda r: r[0])]


def _rules_of(selectors: str, body: str, place: int) -> list[tuple]:
    shown, seen = (list(p.finditer(body))[-1:] for p in (DISPLAY, SHEET_VISIBILITY))
    out = []
    for one in selectors.split(",") if shown or seen else ():
        if m := SIMPLE_SELECTOR.match(one.strip()):
            parts = re.findall(r"([.#])([\w-]+)", m[2] or "")
            if m[1] or parts:
                tag = (m[1] or "*").lower()
                classes, ids = (frozenset(n for k, n in parts if k == kind) for kind in ".#")
                weight = (len(ids), len(classes), tag != "*", place)
                for important in (False, True):
                    says = [
                        v[0][1].lower() not in ("none", "hidden", "collapse") if v and bool(v[0][2]) == important else None
                        for v in (shown, seen)
                    ]
                    if says != [None, None]:
                        out.append(((important, *weight), tag, classes, ids, *says, important))
    return out


class Page:
    """Lays a tree out as lines."""

    def __init__(self, rules: list, size: int = 0) -> None:
        self.rules = rules
        self.blanks = BLANKS + BLANKS_EACH * size

    def displayed(self, node: Node) -> bool:
        attrs = node.attrs
        if node.tag in UNSEEN:
            return False
        if node.inside and (node.tag in UNSEEN_INSIDE[node.inside] or attrs.get("display") == "none"):
            return False
        if node.tag == "dialog" and "open" not in attrs:
            return False
        own = list(DISPLAY.finditer(attrs.get("style", "")))[-1:]
        says = self.said(node, 0)
        if own and not (says and says[-1][1] and not own[0][2]):
            return own[0][1].lower() != "none"
        return says[-1][0] if says else "hidden" not in attrs

    def said(self, node: Node, what: int) -> list[tuple[bool, bool]]:
        """What the sheet's rules for an element say of its display (0) or visibility (1), the last word last."""
        if not self.rules:
            return []
        classes, own = set(node.attrs.get("class", "").split()), {node.attrs.get("id")}
        return [
            (rule[3 + what], rule[5])
            for rule in self.rules
            if rule[3 + what] is not None and rule[0] in ("*", node.tag) and rule[1] <= classes and rule[2] <= own
        ]

    def seen(self, node: Node, inherited: bool) -> bool:
        """Whether an element is visible, by its own style, else by the sheet, else as what it stands in."""
        if m := VISIBILITY.search(node.attrs.get("style", "")):
            return m[1].lower() == "visible"
        rules = self.said(node, 1)
        return rules[-1][0] if rules else inherited

    def lines(self, top: Node, tables: int = 0, seen: bool = True) -> list[str]:
        """The lines below ``top``; walks without recursion but for tables."""
        out: list[str] = []
        line: list[str] = []
        state = {"gap": False, "indent": 0, "mark": "", "pre": 0}

        def end_line(gap: bool = False) -> None:
            content = "".join(line)
            content = content.rstrip("\n") if state["pre"] else content.strip(" ").removesuffix("\n")
            line.clear()
            if content:
                for part in content.split("\n"):
                    if state["gap"] and out:
                        out.append("")
                    state["gap"] = False
                    out.append(" " * max(0, state["indent"] - len(state["mark"])) + state["mark"] + part)
                    state["mark"] = ""
            state["gap"] = state["gap"] or gap

        todo: list = [(n, seen, None) for n in reversed(top.children)]
        while todo:
            item, visible, leave = todo.pop()
            if leave is not None:
                end_line(leave[0])
                state["indent"], state["pre"] = leave[1], leave[2]
                if leave[3]:
                    state["mark"] = ""
                continue
            if isinstance(item, str):
                if visible:
                    if state["pre"]:
                        line.append(item)
                    else:
                        part = SPACE.sub(" ", item)
                        if part.startswith(" ") and (not line or line[-1][-1:] in (" ", "\n")):
                            part = part[1:]
                        if part:
                            line.append(part)
                continue
            tag = item.tag
            if not self.displayed(item):
                continue
            visible = self.seen(item, visible)
            if tag == "br":
                if line:
                    line[-1] = line[-1].rstrip(" ")
                line.append("\n")
                continue
            if tag == "input":
                kind = item.attrs.get("type", "text").lower()
                if visible and kind in ("text", "search", "submit", "button", "reset", "url", "email", "number"):
                    line.append(item.attrs.get("value", ""))
                continue
            if tag == "table" and tables < DEEPEST_TABLE:
                end_line(True)
                for row in self.table(item, tables + 1, visible):
                    line.append(row)
                    state["pre"] += 1
                    end_line()
                    state["pre"] -= 1
                end_line(True)
                continue
            if tag in ("td", "th"):
                line.append(" ")
            if tag == "text" and item.inside == "svg":
                end_line()
                todo.append((None, visible, (False, state["indent"], state["pre"], False)))
            children = item.children
            if tag == "details" and "open" not in item.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in BLOCKS:
                gap = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and state["indent"])
                end_line(gap)
                todo.append((None, visible, (gap, state["indent"], state["pre"], tag == "li")))
                if tag in ("ul", "ol", "menu", "dir"):
                    children = self.numbered(item)
                if tag in ("li", "dd", "blockquote"):
                    state["indent"] += 2 if tag == "li" and state["indent"] == 0 else 4 if tag != "blockquote" else 2
                if tag == "li":
                    state["mark"] = item.attrs.get("\0mark", "- ")
                    state["indent"] = max(state["indent"], len(state["mark"]))
                if tag in ("pre", "xmp"):
                    state["pre"] += 1
            todo.extend((c, visible, None) for c in reversed(children))
        end_line()
        return out

    def numbered(self, node: Node) -> list:
        """The children of a list, its items with their marks."""
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                child.attrs["\0mark"] = f"{number}. " if node.tag == "ol" else "- "
                number += 1
        return node.children

    def table(self, node: Node, depth: int, visible: bool) -> list[str]:
        """Caption and rows of a table, the cells of a column under each other."""
        before: list[str] = []
        rows: list[list[tuple[Node, bool]]] = []
        todo = [(c, visible) for c in reversed(node.children)]
        while todo:
            item, shown = todo.pop()
            if isinstance(item, str):
                if shown and item.strip():
                    before.append(SPACE.sub(" ", item).strip())
                continue
            if not self.displayed(item):
                continue
            shown = self.seen(item, shown)
            if item.tag in ("td", "th"):
                if not rows:
                    rows.append([])
                rows[-1].append((item, shown))
            elif item.tag in ("thead", "tbody", "tfoot", "tr"):
                if item.tag == "tr":
                    rows.append([])
                todo.extend((c, shown) for c in reversed(item.children))
            else:
                box = Node("div", {})
                box.children = [item]
                before += self.lines(box, depth, shown)
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}
        for row in rows:
            cells: dict[int, list[str]] = {}
            column = 0
            for cell, shown in row:
                while taken.get(column, 0) > 0:
                    column += 1
                cells[column] = self.lines(cell, depth, shown)
                wide, high = (self.span(cell, k) for k in ("colspan", "rowspan"))
                for c in range(column, column + wide):
                    if high > 1:
                        taken[c] = high
                column += wide
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            grid.append(cells)
        places = self.places(grid)
        out = list(before)
        for cells in grid:
            for i in range(max((len(x) for x in cells.values()), default=0)):
                text = ""
                for c in sorted(cells):
                    if i < len(cells[c]) and cells[c][i]:
                        text = text.ljust(places[c]) if len(text) <= places[c] else text + "  "
                        text += cells[c][i]
                out.append(text.rstrip())
        return out

    def places(self, grid: list[dict[int, list[str]]]) -> dict[int, int]:
        """Where columns begin: each is as wide as its widest cell, while there are blanks left for that."""
        widths: dict[int, int] = {}
        for cells in grid:
            for c, cell in cells.items():
                widths[c] = max([widths.get(c, 0), *map(len, cell)])
        for most in (max(widths.values(), default=0), NARROW):
            places, at = {}, 0
            for c in sorted(widths):
                places[c] = at
                at += min(widths[c], most) + (2 if widths[c] else 0)
            needed = sum(places[max(cells)] * max(map(len, cells.values())) for cells in grid if cells)
            if needed <= self.blanks:
                break
        self.blanks = max(0, self.blanks - needed)
        return places

    @staticmethod
    def span(cell: Node, name: str) -> int:
        value = cell.attrs.get(name, "1").strip()
        return min(MOST_SPAN, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def visible_text(source: str) -> str:
    """All text that a page shows, laid out; no text for an empty page."""
    root, sheet = build_tree(source)
    page = Page(sheet_rules(sheet), len(source))
    return "\n".join(page.lines(root)).strip("\n")


def html_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """``key``, the laid-out ``text`` and ``n_lines`` of every page, each whole.

    Null and empty pages have an empty text and no lines; text without markup is text.
    Repeated keys give a row each, an empty table gives an empty one, other columns are not
    read. No shuffle. Columns are as wide as their widest cell; on a page where that would take
    more than ``BLANKS`` and ``BLANKS_EACH`` times its length of blanks, cells of further tables may
    stick out. Tables within ``DEEPEST_TABLE`` others are running text. No text is lost by either.
    """

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, raws in batches:
            texts = [visible_text((r or b"").decode("utf-8", "replace")) for r in raws]
            yield [keys, texts, [t.count("\n") + 1 if t else 0 for t in texts]]

    kind = pages.schema[key].dataType.simpleString()
    return map_texts(pages, [key, markup], work, f"`{key}` {kind}, text string, n_lines long")
