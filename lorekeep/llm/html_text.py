"""Layout-aware text of web pages.

A tokenizer feeds a tree builder that supplies implied tags (list items,
paragraphs, table rows and cells, table bodies end each other as HTML says)
and closes what stays open. Visibility rules skip what a reader never sees:
scripts, styles, the head, templates, hidden attributes,
display:none and visibility:hidden styles, hidden inputs, closed comments,
fallbacks of noscript, frames, object, canvas, audio and video, and the
titles, descriptions, metadata and annotations of svg and math, whose other
text is shown. A head ends before whatever may not stand in it.
The renderer then emits all visible text: blocks on lines of their own, blank
lines between paragraphs, list markers with indentation, preformatted text as
it stands, and table cells aligned in columns.

Null and empty pages give empty text. Broken markup never fails: unknown end
tags are ignored, an unclosed comment or raw element runs to the end. Rows
are independent, so repeated rows give repeated results and an empty table an
empty one. Only the id and the results are returned. Nesting may have any
depth. Building takes time in proportion to the page: open elements are found
by tag, never by a walk over all that are open, and an unclosed tag is not
searched for its end again and again.

A cell may span columns and rows (within the ranges that HTML itself sets).
Columns that begin within the first ALIGNED characters of a line are aligned;
cells further right follow one another without padding, and a line of a cell
longer than that does not widen its column but moves the rest of its own line.
So no text is left out, a table pads a line by ALIGNED characters at most, and
how a row is shown depends on the widths of its columns, never on the number of
rows or the size of the table or page.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame

from lorekeep.llm.common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title meta link template noscript iframe noembed noframes object canvas audio video datalist".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table ul tr caption thead tbody tfoot td th hr xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: A start tag on the left ends an open element on the right, unless a fence stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"body", "html", "li", "dd", "dt", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"} | {"p"}
SCOPE = frozenset("table td th caption html body button object template".split())
#: Most columns and rows that a cell spans (fixed values of HTML).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Characters of a line within which columns are aligned.
ALIGNED = 400
#: What may stand in a head, and what svg and math hold unseen; both read markup their own way until an element on the third list.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head".split())
FOREIGN_UNSEEN = frozenset("title desc metadata style script annotation annotation-xml".split())
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())

COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
UNQUOTED = re.compile(r"[^>\"']*")
ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANK = " \t\n\r\f"
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(source)} if source else {}


def closed(attrs: str) -> bool:
    """Whether the last slash ends the tag; it may belong to a value without quotes."""
    k = max(attrs.rfind(c) for c in BLANK + "\"'") + 1
    return "=" not in attrs[k:] and not attrs[:k].rstrip(BLANK).endswith("=")


def tag_end(page: str, at: int) -> int:
    """Where the > of a tag stands whose name ends at `at`; -1 when there is none."""
    k = at
    while True:
        k = UNQUOTED.match(page, k).end()
        if k >= len(page):
            return page.find(">", at)
        if page[k] == ">":
            return k
        close = page.find(page[k], k + 1)
        if close < 0:  # an unclosed quote is none
            return page.find(">", at)
        k = close + 1


class Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags; 0 when none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_above(self, floor: int, tags) -> int | None:
        """Place of the outermost element of these tags inside the one at floor."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, floor)) < len(p)]
        return min(found, default=None)

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()


TABLE_PARTS = frozenset("table tr tbody thead tfoot body html".split())
LI_FENCE = BLOCK - {"p", "div", "address"}


def build(page: str) -> Node:
    """The page's tree, with implied tags supplied."""
    root = Node("#root")
    opened = Open(root)
    stack, last, push, close_to = opened.stack, opened.last, opened.push, opened.close_to

    def implied_end(tag: str) -> None:
        if tag in ENDS_P and (k := last("p")) and k > last(*SCOPE):
            close_to(k)
        ends, fences = IMPLIED.get(tag, ((), ()))
        if not ends:
            return
        floor = last(*fences)
        if tag in ("li", "dt", "dd"):
            floor = max(floor, last(*(LI_FENCE - ends)))
        own = last(tag) if tag in ("li", "td", "th", "option") else 0
        lowest = own if own > floor else opened.first_above(floor, ends)
        if lowest is not None:
            close_to(lowest)

    def supply(tag: str) -> None:
        """Row and body elements that a cell or row needs around it."""
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if stack[-1].tag == "table":
                push(Node("tbody"))
            push(Node("tr"))
        elif tag == "tr" and stack[-1].tag == "table":
            push(Node("tbody"))

    def foreign() -> bool:
        """Whether the innermost open element is read as svg or math."""
        k = last("svg", "math")
        return k > 0 and k > last(*HTML_AGAIN)

    def put_text(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(BLANK):
            close_to(len(stack) - 1)
        stack[-1].children.append(text)

    at, end = 0, len(page)
    last_end = page.rfind(">")
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = end if stop < 0 else stop
            text = page[at:stop]
            put_text(html.unescape(text) if "&" in text else text)
            at = stop
            continue
        if page.startswith("<!--", at):
            at = COMMENT.match(page, at).end()
            continue
        if page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at) and not NAME.match(page, at):
            if page.startswith("<![CDATA[", at) and foreign():
                stop = page.find("]]>", at)
                put_text(page[at + 9 : stop if stop >= 0 else end])
                at = stop + 3 if stop >= 0 else end
                continue
            stop = page.find(">", at) if at <= last_end else -1
            at = stop + 1 if stop >= 0 else end
            continue
        m = NAME.match(page, at)
        if m is None:
            put_text("<")
            at += 1
            continue
        stop = tag_end(page, m.end()) if at <= last_end else -1
        if stop < 0:  # an unclosed tag at the end is text
            put_text(html.unescape(page[at:]))
            break
        at = stop + 1
        tag = m[2].lower()
        if m[1]:
            k = last(tag)
            if k and (tag in TABLE_PARTS or k >= last("td", "th", "table")):
                close_to(k)
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close_to(len(stack) - 1)
        implied_end(tag)
        supply(tag)
        attrs = page[m.end() : stop]
        node = Node(tag, attrs)
        inside = tag in FOREIGN_UNSEEN and foreign()
        if inside:
            node.attrs = "hidden"
        # svg and math take the slash at a tag's end as its end, HTML does not
        empty = attrs.endswith("/") and (tag in ("svg", "math") or inside or foreign()) and closed(attrs)
        if tag in VOID or empty:
            stack[-1].children.append(node)
        elif tag in RAW:
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : over.start() if over else end]
            at = over.end() if over else end
            if tag == "textarea":
                node.children.append(html.unescape(body))
            elif tag == "xmp":
                node.children.append(body)
            stack[-1].children.append(node)
        else:
            push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    if node.attrs:
        low = node.attrs.lower()
        if "hidden" in low or "display" in low or "visibility" in low:
            a = attributes(node.attrs)
            if "hidden" in a or HIDDEN_STYLE.search(a.get("style", "")):
                return False
    return True


def width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Lines:
    """Collects lines; white space collapses and blocks begin new lines."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s.startswith(" "):
            self.space, s = True, s[1:]
        tail = s.endswith(" ")
        s = s[:-1] if tail else s
        if s:
            if self.space and self.line:
                self.line.append(" ")
            self.line.append(s)
            self.space = False
        self.space = self.space or tail

    def feed(self) -> None:
        if self.line:
            self.done.append("".join(self.line))
        self.line, self.space = [], False

    def blank(self) -> None:
        self.feed()
        if self.done and self.done[-1]:
            self.done.append("")

    def result(self) -> list[str]:
        self.feed()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def render(node: Node) -> list[str]:
    out = Lines()
    flow(node, out)
    return out.result()


def flow(node: Node, out: Lines) -> None:
    number = 0
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
            continue
        if not visible(child):
            continue
        tag = child.tag
        if tag == "br":
            if not out.line:
                out.done.append("") if out.done and out.done[-1] else None
            out.feed()
        elif tag == "hr":
            out.feed()
            out.done.append("-" * 8)
        elif tag == "img":
            alt = attributes(child.attrs).get("alt")
            if alt:
                out.text(alt)
        elif tag == "input":
            a = attributes(child.attrs)
            if a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url") and a.get("value"):
                out.text(a["value"])
        elif tag in ("pre", "xmp"):
            out.blank()
            out.done += plain(child).strip("\n").expandtabs(8).split("\n")
            out.blank()
        elif tag == "table":
            out.blank()
            out.done += table(child)
            out.blank()
        elif tag == "li":
            out.feed()
            number += 1
            marker = f"{number}. " if node.tag == "ol" else "- "
            lines = render(child)
            out.done += [(marker if i == 0 else " " * len(marker)) + x if x else "" for i, x in enumerate(lines)]
        elif tag in ("ul", "ol", "menu") and node.tag == "li":
            out.feed()
            out.done += render(child)
        elif tag == "blockquote":
            out.blank()
            out.done += [f"> {x}".rstrip() for x in render(child)]
            out.blank()
        elif tag == "dd":
            out.feed()
            out.done += [f"    {x}".rstrip() for x in render(child)]
        elif tag == "text":  # svg places each on its own
            out.space = True
            flow(child, out)
            out.space = True
        elif tag in BLOCK:
            out.blank() if tag in SPACED else out.feed()
            flow(child, out)
            out.blank() if tag in SPACED else out.feed()
        else:
            flow(child, out)


def plain(node: Node) -> str:
    """Text as it stands, for preformatted elements."""
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.tag == "br":
            parts.append("\n")
        elif visible(child):
            parts.append(plain(child))
    return "".join(parts)


def span_of(cell: Node, name: str, most: int) -> int:
    given = attributes(cell.attrs).get(name, "1").strip() if cell.attrs else "1"
    return min(int(given[:9]), most) if given.isascii() and given.isdigit() else 1


def table(node: Node) -> list[str]:
    """Rows of cells, each padded to the width of the columns it spans."""
    before: list[str] = []
    rows: list[list[tuple[int, int, list[str]]]] = []  # (first column, columns, lines) of each cell

    def seated(row: Node, held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Gives a row's cells their columns; held: (first, end, rows left) of cells from above."""
        cells, column, taken = [], 0, sorted(held)
        fresh, k = [], 0
        for child in row.children:
            if isinstance(child, str):
                if not child.strip():
                    continue
                lines, wide, tall = [SPACES.sub(" ", child).strip()], 1, 1
            elif not visible(child):
                continue
            else:
                lines, wide = render(child) or [""], max(1, span_of(child, "colspan", MOST_COLUMNS))
                tall = span_of(child, "rowspan", MOST_ROWS) or MOST_ROWS
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            cells.append((column, wide, lines))
            if tall > 1:
                if fresh and fresh[-1][1] == column and fresh[-1][2] == tall:
                    fresh[-1] = (fresh[-1][0], column + wide, tall)
                else:
                    fresh.append((column, column + wide, tall))
            column += wide
        rows.append(cells)
        return [(a, b, left - 1) for a, b, left in (*taken, *fresh) if left > 1]

    def walk(part: Node) -> None:
        held: list[tuple[int, int, int]] = []
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    before.append(SPACES.sub(" ", child).strip())
            elif not visible(child):
                continue
            elif child.tag == "tr":
                held = seated(child, held)
            elif child.tag in ("thead", "tbody", "tfoot"):
                walk(child)
            elif child.tag not in ("colgroup", "col"):
                before.extend(render(child))

    walk(node)
    # only columns in which a cell begins take room
    starts = sorted({c[0] for r in rows for c in r})
    widths = [0] * len(starts)
    placed = []
    for r in rows:
        row = []
        for first, wide, lines in r:
            i = bisect_right(starts, first) - 1
            row.append((i, bisect_right(starts, first + wide - 1), lines))
        placed.append(row)
    for spread in (False, True):
        for row in placed:
            for i, j, lines in row:
                wide = max((w for w in map(width, lines) if w <= ALIGNED), default=0)
                if j - i == 1:
                    widths[i] = max(widths[i], wide)
                elif spread:  # what a wide cell still needs goes to its last column
                    widths[j - 1] += max(0, wide - sum(widths[i:j]) - 3 * (j - i - 1))
    left = [0]
    for w in widths:
        left.append(left[-1] + w + 3)
    near = bisect_right(left, ALIGNED, hi=len(widths))  # columns that begin within the aligned part

    def padded(text: str, i: int, j: int) -> str:
        """The text up to where column j begins, if that is within the aligned part."""
        return text + " " * (left[j] - left[i] - 3 - width(text)) if left[j] <= ALIGNED else text

    out = list(before)
    for row in placed:
        first = [c for c in row if c[0] < near]
        rest = [c for c in row if c[0] >= near]
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line, at = [], 0
            for i, j, lines in first:
                # columns before it are held by cells from above
                line += [padded("", c, c + 1) for c in range(at, i)]
                line.append(padded(lines[k] if k < len(lines) else "", i, j))
                at = j
            rest = [c for c in rest if k < len(c[2])]
            if rest:
                line += [padded("", c, c + 1) for c in range(at, near)]
                line += [lines[k] for *_, lines in rest]
            out.append(" | ".join(line).rstrip())
    return out


def text_of(page: bytes | None) -> str:
    if not page:
        return ""
    tree = build(page.decode("utf-8", "replace"))
    # rendering recurses by the depth of the tree, which a page's size bounds
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * page.count(b"<") + 1000))
    try:
        lines = render(tree)
    finally:
        sys.setrecursionlimit(before)
    return "\n".join(x.rstrip() for x in lines)


TITLE = re.compile(r"<title(?=[\s>])[^>]*>", re.I)
TITLE_END = re.compile(r"</title", re.I)


def title_of(page: str) -> str:
    m = TITLE.search(page)
    over = m and TITLE_END.search(page, m.end())
    return SPACES.sub(" ", html.unescape(page[m.end() : over.start()])).strip() if over else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The id with title, text, n_chars, n_lines and text_sha256."""

    def setup():
        def fn(page):
            text = text_of(page)
            return title_of((page or b"").decode("utf-8", "replace")), text, len(text), text.count("\n") + 1 if text else 0, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

        return fn

    return map_texts(pages.select(id_col, html_col), html_col, "title string, text string, n_chars bigint, n_lines bigint, text_sha256 string", setup, keep=[id_col])
