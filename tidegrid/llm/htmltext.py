"""HTML to text by layout: a tree with implied tags, visibility rules and block, list and table spacing."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas desc metadata defs symbol annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure hr fieldset".split())
BLOCK = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li listing main nav option optgroup search section summary tbody td tfoot th thead tr".split())
CLOSES_P = (BLOCK - frozenset("body caption dd dt html legend option optgroup summary tbody td tfoot th thead tr li".split())) | frozenset(("li", "dd", "dt"))
#: A start tag closes these where they are the nearest open ones, looking no further than the stop tags.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)),
}
SCOPE = frozenset("table td th caption html object template".split())
WRAP = 60  # lines of a table's cells are folded at blanks to this length, as a screen folds them; a longer word runs over

_TAG = re.compile(r"<!--|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_STRING_OR_NOTE = re.compile(r"/\*.*?(?:\*/|$)|\"[^\"\n]*\"|'[^'\n]*'|<!--|-->", re.S)
_CUT = re.compile(r"[{};]")
_ALWAYS = re.compile(r"(?:only\s+)?(?:all|screen)|not\s+(?:print|speech|tty|tv|projection|handheld|braille|embossed|aural)|", re.I)
_PLAIN = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)$", re.I)
_COMBINED = re.compile(r"[^\s>]+|\s*>\s*|\s+")
_BLANKS = re.compile(r"[ \t\n\r\f]{2,}|[\t\n\r\f]")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """The tree; end tags without a start are passed over, open elements end with their parents."""
    root = Node("#root", {})
    open_ = [root]
    at, end = 0, len(html)

    def close_to(tags: tuple[str, ...], stop: frozenset | tuple) -> None:
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return
            if open_[k].tag in stop:
                return

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            open_[-1].kids.append(html[at:])
            break
        if m.start() > at:
            open_[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            if html.startswith((">", "->"), at):  # closed at once
                at = html.index(">", at) + 1
                continue
            stop = html.find("-->", m.end())
            at = end if stop < 0 else stop + 3
            continue
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not any(n.tag == "p" for n in open_[1:]):
                open_[-1].kids.append(Node("p", {}))
            elif tag == "br":
                open_[-1].kids.append(Node("br", {}))
            elif tag not in VOID:
                close_to((tag,), () if tag in SCOPE else ("table",) if tag in ("tr", "td", "th") else ("td", "th"))
            continue
        tag, raw = (m[2] or m[4] or "").lower(), m[3] if m[2] else m[5]
        if not tag:
            continue
        if tag in CLOSES_P:
            close_to(("p",), SCOPE)
        for _ in range(3):  # a row ends its cell, its row and its section
            if tag in IMPLIED_END:
                close_to(*IMPLIED_END[tag])
        node = Node(tag, attributes(raw) if raw and raw != "/" else {}, open_[-1])
        open_[-1].kids.append(node)
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = m.start() if m else end
            node.kids.append(html[at:stop])
            at = stop
            if m:
                close = html.find(">", stop)
                at = end if close < 0 else close + 1
        elif tag not in VOID:
            open_.append(node)
    return root


def declared(parts: list[str]) -> dict[str, tuple[bool, bool]]:
    """Whether it is important and whether it hides, for display and visibility; the last declaration counts, important first."""
    out: dict[str, tuple[bool, bool]] = {}
    for part in parts:
        prop, _, value = part.partition(":")
        prop, value = prop.strip().lower(), value.strip().lower()
        if prop in ("display", "visibility") and value:
            strong = value.endswith("important") and "!" in value
            word = value.split("!")[0].strip()
            if prop == "visibility" and word not in ("visible", "hidden", "collapse"):
                continue  # as its parent
            if strong or not out.get(prop, (False,))[0]:
                out[prop] = (strong, word in (("none",) if prop == "display" else ("hidden", "collapse")))
    return out


def applies(media: str) -> bool:
    """Media lists that hold on every screen; those that ask for its width or other features don't."""
    return any(_ALWAYS.fullmatch(q.strip()) for q in media.split(","))


Step = tuple[bool, str, frozenset[str], frozenset[str]]  # whether its parent (else any ancestor) comes next, tag, classes, ids
Rule = tuple[tuple[bool, int, int, int], tuple[Step, ...], str, bool]


def selector(text: str) -> tuple[Step, ...] | None:
    """Steps of a selector from the element outwards: tags, classes and ids, as children or descendants of others. Other
    kinds of selectors are not read."""
    steps: list[Step] = []
    child = False
    for part in _COMBINED.findall(text.strip()):
        if part.strip() in ("", ">"):
            child = part.strip() == ">"
            continue
        m = _PLAIN.match(part)
        if not m:
            return None
        marks = re.findall(r"[.#][\w-]+", m[2])
        tag = (m[1] or "").lower()
        steps.append((child, "" if tag == "*" else tag, frozenset(p[1:] for p in marks if p[0] == "."), frozenset(p[1:] for p in marks if p[0] == "#")))
        child = False
    return tuple(reversed(steps)) or None


def display_rules(css: str) -> list[Rule]:
    """Weight, selector, property and whether it hides, of the rules with readable selectors that say how they
    show; others are left alone. Rules within other rules and in at-rules that may not hold are passed over."""
    css = _STRING_OR_NOTE.sub(lambda m: '""' if m[0][0] in "\"'" else " ", css)
    out: list[Rule] = []
    open_: list[tuple[str | bool, list[str]]] = [(True, [])]  # a rule's selectors, or whether rules count

    def close() -> None:
        names, parts = open_.pop()
        if isinstance(names, str):
            said = declared(parts)
            for name in names.split(",") if said else ():
                steps = selector(name)
                if steps:
                    heavy = sum(len(s[3]) for s in steps), sum(len(s[2]) for s in steps), sum(bool(s[1]) for s in steps)
                    out.extend(((strong, *heavy), steps, prop, hides) for prop, (strong, hides) in said.items())

    at = 0
    for m in _CUT.finditer(css):
        piece, at = css[at : m.start()].strip(), m.end()
        if m[0] == "{":
            if open_[-1][0] is not True:
                open_.append((False, []))
            elif piece.startswith("@"):
                kind, _, rest = piece[1:].replace("(", " (", 1).partition(" ")
                open_.append((kind.lower() in ("layer", "supports") or (kind.lower() == "media" and applies(rest)), []))
            else:
                open_.append((piece, []))
        elif m[0] == ";" or len(open_) > 1:
            open_[-1][1].append(piece)
            if m[0] == "}":
                close()
    open_[-1][1].append(css[at:])
    while len(open_) > 1:
        close()
    return out


def by_weight(rules: list[Rule]) -> list[Rule]:
    """Heaviest first, and of equal ones the last."""
    return sorted(reversed(rules), key=lambda r: r[0], reverse=True)


def _fits(node: Node, step: Step) -> bool:
    _, tag, classes, ids = step
    return (not tag or tag == node.tag) and (not ids or ids == {node.attrs.get("id")}) and (not classes or classes <= frozenset(node.attrs.get("class", "").split()))


def matches(node: Node | None, steps: tuple[Step, ...]) -> bool:
    """Whether the element is one that the selector means."""
    if node is None or not _fits(node, steps[0]):
        return False
    if len(steps) == 1:
        return True
    # what joins an element to the next step outwards stands with the element
    if steps[0][0]:
        return matches(node.up, steps[1:])
    above = node.up
    while above is not None:
        if matches(above, steps[1:]):
            return True
        above = above.up
    return False


def hidden(node: Node, rules: list[Rule]) -> tuple[bool, bool | None]:
    """Whether nothing of the element shows, whatever is in it, and whether its own text is invisible (None: as its
    parent's; a visible element within it shows again). Rules come heaviest first; of each property the first that
    matches decides, a style of its own before all but important ones."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return True, None
    own = declared(a["style"].split(";")) if "style" in a else {}
    found = {p: hides for p, (strong, hides) in own.items() if strong}
    for weight, steps, prop, hides in rules:
        if prop in found or (prop in own and not weight[0]):
            continue
        if matches(node, steps):
            found[prop] = hides
            if len(found) == 2:
                break
    display = found.get("display", own.get("display", (False, False))[1])
    return display, found.get("visibility", own["visibility"][1] if "visibility" in own else None)


class Flow:
    """Lines of a page or of a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.blank, self.indent, self.marker = 0, True, "", ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            if first:
                self.now.append(first)
                self.blank = False
            for line in more:
                self.end(1, True)
                if line:
                    self.now.append(line)
                    self.blank = False
            return
        s = _BLANKS.sub(" ", s)
        if self.blank:
            s = s.lstrip(" ")
        if s:
            self.now.append(s)
            self.blank = s[-1] == " "

    def end(self, breaks: int, keep: bool = False) -> None:
        """End the line; at least ``breaks`` line breaks before what follows."""
        line = "".join(self.now).rstrip(" ")
        if line or (keep and self.lines and not self.gap):
            self.lines += [""] * (self.gap if self.lines else 0)
            self.lines.append((self.indent[: len(self.indent) - len(self.marker)] + self.marker + line).rstrip(" "))
            self.gap, self.marker = 0, ""
        self.now, self.blank = [], True
        self.gap = max(self.gap, breaks - 1)

    def add(self, lines: list[str]) -> None:
        self.end(2)
        for line in lines:
            self.now.append(line)
            self.end(1, True)
        self.end(2)


def folded(line: str) -> list[str]:
    """A cell's line in pieces of WRAP characters at most, parted at blanks; a longer word is a piece of its own."""
    out = []
    while len(line) > WRAP:
        at = line.rfind(" ", 1, WRAP + 1)
        at = line.find(" ", WRAP) if at <= 0 or not line[:at].strip() else at
        if at < 0:
            break
        out.append(line[:at].rstrip(" "))
        line = line[at + 1 :].lstrip(" ")
    return [*out, line]


class Grid:
    """Rows of a table; a cell is (column, columns it spans, lines). Lines of a column begin at the same place."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken: dict[int, int] = {}
        self.column = 0

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            self.column += 1
        self.rows[-1].append((self.column, across, [part for line in lines for part in folded(line)]))
        if down > 1:
            self.taken |= {self.column + k: down for k in range(across)}
        self.column += across

    def render(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, across, lines in row:
                if across == 1:
                    width[c] = max(width.get(c, 0), max((len(x) for x in lines if len(x) <= WRAP), default=0))
        left, at = {}, 0
        for c in range(max(width, default=-1) + 1):
            left[c] = at
            at += width.get(c, 0) + 2 * (c in width)
        out = []
        for row in self.rows:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for c, _, lines in row:
                    part = lines[k] if k < len(lines) else ""
                    if part:
                        line = (line + "  " if line.strip() and len(line) + 2 > left.get(c, 0) else line.ljust(left.get(c, 0))) + part
                out.append(line.rstrip())
        return out


def _span(node: Node, name: str) -> int:
    v = node.attrs.get(name, "")
    return min(max(int(v), 1), 1000) if v.isascii() and v.isdigit() and len(v) < 6 else 1


def render(html: str | None) -> str:
    """All visible text. Blocks start lines, paragraphs, headings, lists and tables stand apart by an empty
    line, list items carry markers and indents, cells of a column start at the same place, pre keeps its
    blanks. Works on a stack, so depth has no limit."""
    if not html:
        return ""
    root = parse(html)
    rules, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag == "style" and applies(n.attrs.get("media", "")):
            rules += display_rules("".join(k for k in n.kids if isinstance(k, str)))
        todo += [k for k in reversed(n.kids) if not isinstance(k, str)]
    rules = by_weight(rules)
    flows, grids, lists, pre = [Flow()], [], [], 0
    stack: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while stack:
        node, leaving, shown = stack.pop()
        out = flows[-1]
        if isinstance(node, str):
            if grids and not grids[-1][1] and not node.strip():
                continue  # blanks between cells
            if shown:
                out.text(unescape(node) if "&" in node else node, pre > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and grids and grids[-1][1]:
                out.end(1)
                grids[-1][1] -= 1
                lists[:] = grids[-1][2].pop()
                flows.pop()
                grids[-1][0].cell(out.lines, _span(node, "colspan"), _span(node, "rowspan"))
            elif tag == "table":
                grid = grids.pop()
                out.add(grid[0].render())
            else:
                if tag in ("ul", "ol", "menu", "dir"):
                    lists.pop()
                if tag == "pre":
                    pre -= 1
                if tag in BLOCK:
                    out.end(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1)
                if tag in ("li", "blockquote", "dd"):
                    cut = node.attrs["#indent"]
                    out.marker = ""
                    out.indent = out.indent[: len(out.indent) - len(cut)]
            continue
        if tag == "br":
            out.end(1, True)
            continue
        if tag != "#root":
            gone, invisible = hidden(node, rules)
            if gone:
                continue
            shown = shown if invisible is None else not invisible
        if tag == "table":
            out.end(2)
            grids.append([Grid(), 0, []])
        elif tag == "tr" and grids and not grids[-1][1]:
            grids[-1][0].row()
        elif tag in ("td", "th") and grids and not grids[-1][1]:
            grids[-1][1] += 1
            grids[-1][2].append(list(lists))
            lists.clear()
            flows.append(Flow())
        elif tag in BLOCK and tag not in ("tbody", "thead", "tfoot"):
            out.end(2 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 1)
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attrs.get("start", "")
            lists.append([tag, int(start) if start.isascii() and start.isdigit() and len(start) < 10 else 1])
        elif tag in ("li", "blockquote", "dd"):
            marker = "  "
            if tag == "li":
                marker = "- "
                if lists and lists[-1][0] == "ol":
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out.marker = marker
            node.attrs = node.attrs | {"#indent": marker}
            out.indent += marker if tag != "li" else " " * len(marker)
        if tag == "pre":
            pre += 1
        if tag not in VOID:
            kids = node.kids
            if tag == "details" and "open" not in node.attrs:  # closed: the summary alone is seen
                kids = [k for k in kids if not isinstance(k, str) and k.tag == "summary"][:1]
            stack.append((node, True, shown))
            stack.extend((k, False, shown) for k in reversed(kids))
    while len(flows) > 1:
        flows.pop()
    flows[0].end(1)
    return "\n".join(flows[0].lines).replace("\xa0", " ").strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, ``keep`` columns and ``text`` of each row of pages; a null or empty page has an empty text, rows that repeat
    are rows of their own, an empty table gives none. ``keep`` must not hold the id or ``text``; other columns play no part."""
    if {"text", "__html", id_col} & set(keep) or id_col == "text" or len(set(keep)) != len(keep):
        raise ValueError(f"columns {list(keep)} clash with the id or text")
    own = pages.select(F.col(id_col), *keep, F.col(html_col).alias("__html"))
    names = [*own.columns[:-1], "text"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((render(x.as_py()) for x in b.columns[-1]), pa.string())], names)

    kinds = ", ".join(f"`{n}` {t}" for n, t in own.dtypes[:-1])
    return own.mapInArrow(run, f"{kinds}, text string")
