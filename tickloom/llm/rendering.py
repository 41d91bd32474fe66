"""HTML to text as a page would show it: a tree builder with implied tags, visibility rules and a line layout.

Blocks stand on lines of their own, paragraphs and headings with an empty line around them; lists have bullets or
numbers and an indent; cells of tables are padded to columns. All visible text is kept, whatever the markup: formulas as
their texts in order, each text of a drawing on a line. `display: none` cuts what is below it, `visibility` is inherited and a
descendant may turn it on again; hidden items and cells keep their place. Only style attributes are read, not style sheets.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())         # no tags inside
HIDDEN = frozenset("script style template noscript head title iframe noembed noframes audio video canvas object "
                   "datalist defs symbol metadata desc annotation annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure table dl ul ol hr fieldset".split())
BLOCK = MARGIN | frozenset("address article aside body center caption dd details dialog dir div dt fieldset figcaption footer "
                           "form header hgroup html legend li listing main menu nav option optgroup section summary "
                           "tbody td tfoot th thead tr search xmp text".split())
ENDS_P = BLOCK - frozenset("option optgroup li dd dt td th tr tbody thead tfoot caption body html summary text".split())
IN_HEAD = frozenset("title style script noscript template base basefont bgsound link meta head html noframes".split())  # else it ends
# a start tag ends open elements of these kinds, up to one of the barriers
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
           "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
           "tr": ({"tr", "caption"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
           "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"})}
CELLS = frozenset(("td", "th", "caption"))
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++)))?+""")
ABSENT = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
WHITE = re.compile("[ \t\n\r\f]+")
PADDED = 80             # widest column that others are aligned behind
INDENTS = 32            # levels of lists and quotes that are shown by an indent; deeper ones stand like the last


class Node:
    __slots__ = ("tag", "attributes", "children", "seen")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.seen = tag, attributes, [], True


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), entities.unescape(a or b or c))
    return found


def tokens(html: str) -> Iterator[tuple[str, str, object]]:
    """("text", text, raw?), ("start", tag, attributes) and ("end", tag, None) of a page, in one pass."""
    at, quoted, size = 0, True, len(html)
    while at < size:
        less = html.find("<", at)
        if less < 0:
            yield "text", html[at:], False
            return
        if less > at:
            yield "text", html[at:less], False
        mark = html[less + 1:less + 2]
        if html.startswith("<!--", less):
            end = html.find("-->", less + 4)
            at = size if end < 0 else end + 3
        elif mark and mark in "!?" or mark == "/" and not html[less + 2:less + 3].isalpha():
            end = html.find(">", less)
            at = size if end < 0 else end + 1
        elif name := NAME.match(html, less):
            tag = TAG.match(html, less) if quoted else None
            if tag:
                at, inside = tag.end(), tag[2]
            else:                                        # a quote that never closes: no more looking for quotes
                quoted = False
                end = html.find(">", name.end())
                if end < 0:
                    return
                at, inside = end + 1, html[name.end():end]
            kind = name[1].lower()
            if mark == "/":
                yield "end", kind, None
                continue
            yield "start", kind, attributes(inside) if "=" in inside or inside.strip(" /\n\t") else {}
            if kind in RAW:
                close = re.compile(f"</{kind}(?=[\\s/>])", re.I).search(html, at)
                stop = close.start() if close else size
                if stop > at:
                    yield "text", html[at:stop], kind not in ("textarea", "title")
                at = stop
        else:
            yield "text", "<", False
            at = less + 1


def build(html: str) -> Node:
    """The page's tree. End tags without a start are passed over, missing ones implied; cells get a row."""
    root = Node("#root", {})
    stack, open_ = [root], Counter()

    def push(tag, values):
        node = Node(tag, values)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_[tag] += 1

    def pop_to(place):
        while len(stack) > place:
            open_[stack.pop().tag] -= 1

    def end(kinds, barriers):
        """Closes the outermost open element of these kinds above the barriers."""
        if not any(open_[k] for k in kinds):
            return
        last = None
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].tag in barriers:
                break
            if stack[place].tag in kinds:
                last = place
        if last is not None:
            pop_to(last)

    def in_head():
        """An open head that no element hidden for itself (a noscript or template) stands in between."""
        return open_["head"] and not (open_["template"] or open_["noscript"])

    for kind, value, more in tokens(html):
        if kind == "text":
            if stack[-1].tag == "head" and not more and WHITE.sub("", value):
                end({"head"}, set())
            stack[-1].children.append(value if more else entities.unescape(value))
        elif kind == "start":
            if value in ENDS_P and open_["p"]:
                end({"p"}, CELLS | {"table", "button"})
            if value in IMPLIED:
                end(*IMPLIED[value])
            if value in ("td", "th") and open_["table"] and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr", {})
            if value not in IN_HEAD and in_head():
                end({"head"}, set())
            push(value, more)
        elif open_[value]:
            barriers = () if value in ("table", "body", "html", *CELLS, "tr", "tbody", "thead", "tfoot") else CELLS | {"table"}
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == value:
                    pop_to(place)
                    break
                if stack[place].tag in barriers:
                    break
    return root


def hidden(node: Node, parent: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a and a["hidden"].lower() != "until-found" or ABSENT.search(a.get("style", "")):
        return True
    return (node.tag == "dialog" and "open" not in a) or (
        parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary")


def seen(node: Node, parent: Node) -> bool:
    """Visibility as the element's style says last, else as its parent has it."""
    rules = VISIBILITY.findall(node.attributes.get("style", ""))
    return rules[-1].lower() in ("visible", "initial") if rules else parent.seen


class Lines:
    """Lays text out in lines: runs of white space are one space, blocks break lines, margins are empty lines."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent: list[str] = []
        self.mark = ""

    def text(self, value: str, kept: bool) -> None:
        if kept:
            first, *rest = value.replace("\r\n", "\n").split("\n")
            for i, part in enumerate([first, *rest]):
                if i:
                    self.new_line(bool(self.line) or i > 1)
                if part:
                    self.put(part)
            return
        words = WHITE.sub(" ", value)
        if words == " ":
            self.space = self.space or bool(self.line)
            return
        if not words:
            return
        if words[0] == " " and self.line:
            self.space = True
        self.put(words.strip(" "))
        self.space = words[-1] == " "

    def put(self, words: str) -> None:
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(words)

    def new_line(self, even_empty: bool = False) -> None:
        self.space = False
        if self.line or even_empty:
            self.write("".join(self.line))
            self.line = []

    def write(self, line: str) -> None:
        if self.done:
            self.done.extend([""] * self.gap)
        self.gap = 0
        lead = "".join(self.indent[:INDENTS])
        if self.mark:
            lead = lead[:max(0, len(lead) - len(self.mark))] + self.mark
            self.mark = ""
        self.done.append((lead + line).rstrip())

    def block(self, margin: int) -> None:
        self.new_line()
        self.gap = max(self.gap, margin)


def number(value: str | None, other: int) -> int:
    try:
        return int(value) if value else other
    except ValueError:
        return other


def aligned(rows: list[list[tuple[list[str], int]]]) -> Iterator[str]:
    """Lines of a table whose cells (lines, columns spanned) are padded to the widths of their columns."""
    widths: dict[int, int] = {}
    for row in rows:
        column = 0
        for lines, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), min(PADDED, max(map(len, lines), default=0)))
            column += span
    for row in rows:
        for at in range(max((len(lines) for lines, _ in row), default=0)):
            column, line = 0, ""
            for lines, span in row:
                part = lines[at] if at < len(lines) else ""
                wide = sum(widths.get(column + i, 0) for i in range(min(span, 50))) + 2 * (min(span, 50) - 1)
                line += part.ljust(wide) + "  "
                column += span
            yield line.rstrip()


def render(root: Node) -> str:
    """The visible text of a tree. Walks with a stack of its own, so depth is no limit."""
    out = Lines()
    writers, tables, lists, kept = [out], [], [], 0
    walk: list[tuple[bool, object, Node]] = [(False, root, root)]
    while walk:
        leaving, node, parent = walk.pop()
        now = writers[-1]
        if isinstance(node, str):
            if parent.seen and (parent.tag != "details" or "open" in parent.attributes):
                now.text(node, kept > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("pre", "listing", "xmp", "textarea"):
                kept -= 1
            if tag in ("td", "th") and tables:
                now.block(0)
                writers.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((now.done, min(max(1, number(node.attributes.get("colspan"), 1)), 1_000)))
                continue
            if tag == "table":
                rows = tables.pop()
                now.block(1)
                for line in aligned(rows):
                    now.write(line)
                now.gap = 1
                continue
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                now.new_line()
                if now.mark:                               # an item without text
                    now.write("")
                now.indent.pop()
            if tag in BLOCK:
                now.block(0 if tag in ("ul", "ol", "menu") and lists else int(tag in MARGIN))
            continue
        if hidden(node, parent):
            continue
        node.seen = seen(node, parent)
        if tag == "br":
            now.new_line(True)
            continue
        if tag in ("td", "th") and tables:
            writers.append(Lines())
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            now.block(1)
            tables.append([])
        elif tag in BLOCK:
            now.block(0 if tag in ("ul", "ol", "menu") and lists else int(tag in MARGIN))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, number(node.attributes.get("start"), 1)])
        elif tag == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = number(node.attributes.get("value"), lists[-1][1])
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if now.mark:                                   # an item that begins with a list
                now.write("")
            now.indent.append(" " * len(mark))
            now.mark = mark if node.seen else ""
        elif tag == "dd":
            now.indent.append("  ")
        elif tag == "blockquote":
            now.indent.append("> ")
        elif tag in ("pre", "listing", "xmp", "textarea"):
            kept += 1
        walk.append((True, node, parent))
        walk.extend((False, child, node) for child in reversed(node.children))
    out.new_line()
    return "\n".join(out.done).strip("\n")


def visible_text(html: Column) -> Column:
    """Column of the text that pages show; null for null, empty for pages that show nothing."""
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else render(build(p)) for p in pages.to_pylist()], pa.string())
    return run(html.cast("string"))
