"""Visible text of HTML pages, laid out: blocks on their own lines, list markers, aligned table cells.

A page is cut into tags and text by one regular expression, built into a tree (implied end tags, implied
rows, text that strays into a table moved before it, head closed by the first visible thing), and walked
once. Walking is iterative, so nesting depth is bounded by memory only. Spark deals the pages; one page is
handled by one call.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import row_blocks

# Widest column that short cells are padded to, so that one long cell does not widen every row.
PAD = 60
PAGE_BLOCK = 4 << 20

# Element classes, from the HTML standard (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe noembed noframes datalist audio video canvas object rp desc metadata".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu dir listing xmp".split())
BLOCK = SPACED | frozenset(
    "html body div section article header footer nav main aside address form details summary figcaption center li dt dd "
    "legend hgroup search dialog optgroup option textarea frameset caption".split()
)
CLOSES_P = SPACED | frozenset(
    "div section article header footer nav main aside address form details summary figcaption center li dt dd hgroup search dialog".split()
) - {"table"}
SCOPE = frozenset("table td th caption button html template object".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
TABLE_HOLDERS = frozenset("table thead tbody tfoot tr".split())
SECTIONS = frozenset("thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OTHER = re.compile(r"<!--(?:.*?--!?>|.*)|<[!?/][^>]*+>?|[^<]++|<", re.S)
_OPENING = re.compile(r"<(/?)([a-zA-Z])")
_NAME = re.compile(r"[^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
# A string that nothing closes ends with its line.
_CSS_MARK = re.compile(r"""[{};]|"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?""", re.S)
_COMPOUND = re.compile(r"(?:([a-zA-Z][\w-]*)|\*)?((?:[.#][\w-]+)*)")
_COMBINATOR = re.compile(r"\s*(>)\s*|\s+")


class Tags:
    """Ends of tags. Quotes are followed from tag to tag, so each is looked at once however many tags never end."""

    def __init__(self, page: str):
        self.page = page
        self.quoted: dict[int, int] = {}
        # A search from the first place found the second one; -1 if there is none.
        self.stop, self.next = (0, 0), (0, 0)

    def _ahead(self, known: tuple[int, int], at: int, find) -> tuple[int, int]:
        begin, found = known
        return known if begin <= at and (found < 0 or at <= found) and known != (0, 0) else (at, find(at))

    def _next_stop(self, at: int) -> int:
        def find(at):
            found = _STOP.search(self.page, at)
            return found.start() if found else -1

        self.stop = self._ahead(self.stop, at, find)
        return self.stop[1]

    def next_end(self, at: int) -> int:
        """The next >, in quotes or not."""
        self.next = self._ahead(self.next, at, lambda at: self.page.find(">", at))
        return self.next[1]

    def end(self, at: int) -> int:
        """The next > outside of quotes."""
        path = []
        while True:
            found = self._next_stop(at)
            if found < 0 or self.page[found] == ">":
                break
            if found in self.quoted:
                found = self.quoted[found]
                break
            path.append(found)
            closing = self.page.find(self.page[found], found + 1)
            if closing < 0:
                found = -1
                break
            at = closing + 1
        for quote in path:
            self.quoted[quote] = found
        return found


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        value = a or b or c
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree below a root node, and the texts of its style elements."""
    root = Node("html", {})
    stack, styles, at = [root], [], 0
    end_of_page, tags = len(page), Tags(page)

    # Places of the open elements in the stack, by tag, so that nesting of any depth is looked up at once.
    places: dict[str, list[int]] = {"html": [0]}

    def push(node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    def innermost(tags) -> int:
        return max((found[-1] for tag in tags if (found := places.get(tag))), default=-1)

    def close_to(tags, bounds) -> bool:
        """Close the innermost open element of `tags`, unless one of `bounds` is open inside it."""
        place = innermost(tags)
        if place < 1 or place < len(stack) - 1 and innermost(bounds - tags) > place:
            return False
        cut(place)
        return True

    def strayed():
        """The open table's parent if the current element may only hold table parts."""
        if stack[-1].tag not in TABLE_HOLDERS:
            return None
        place = innermost({"table"})
        return (stack[place - 1], stack[place]) if place > 0 else None

    def put(child):
        moved = strayed() if not isinstance(child, Node) or child.tag not in TABLE_PARTS | HEAD_ONLY | {"form"} else None
        if moved is None:
            stack[-1].children.append(child)
        else:
            holder, table = moved
            where = len(holder.children) - 1
            while where > 0 and holder.children[where] is not table:
                where -= 1
            holder.children.insert(where, child)

    while at < end_of_page:
        opening = _OPENING.match(page, at)
        if opening is None or tags.next_end(at) < 0:
            # Nothing closes a tag from here on: what looks like one is text, an end tag swallows the rest.
            token = _OTHER.match(page, at)
            at, text = token.end(), token[0]
            if text.startswith("<") and len(text) > 1:
                continue
            if not text.isspace():
                if stack[-1].tag == "head":
                    cut(len(stack) - 1)
                put(html.unescape(text) if "&" in text else text)
            elif stack[-1].tag not in TABLE_HOLDERS:
                stack[-1].children.append(text)
            continue
        name = _NAME.match(page, opening.start(2))
        end = tags.end(name.end())
        if end < 0:
            end = tags.next_end(name.end())
        at, tag, raw = end + 1, name[0].lower(), page[name.end() : end]
        if opening[1]:
            if tag == "p" and not places.get("p"):
                put(Node("p", {}))
            elif tag == "br":
                put(Node("br", {}))
            elif tag in HEADINGS:
                close_to(HEADINGS, SCOPE)
            elif tag in TABLE_PARTS or tag in TABLE_HOLDERS:
                close_to({tag}, {"table"} - {tag})
            elif tag in BLOCK:
                close_to({tag}, {"td", "th", "caption", "table"})
            elif tag not in ("html", "body"):
                close_to({tag}, BLOCK | SCOPE)
            continue
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                cut(len(stack) - 1)
            stack[0].attributes = {**attributes, **stack[0].attributes}
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close_to({"p"}, SCOPE)
        if tag == "li":
            close_to({"li"}, {"ul", "ol", "menu", "dir", *SCOPE})
        elif tag in ("dt", "dd"):
            close_to({"dt", "dd"}, {"dl", *SCOPE})
        elif tag in ("option", "optgroup"):
            close_to({"option"} if tag == "option" else {"option", "optgroup"}, {"select", "datalist"})
        elif tag in ("rt", "rp"):
            close_to({"rt", "rp"}, {"ruby"})
        elif tag in HEADINGS:
            if stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
        elif tag in ("a", "button"):
            close_to({tag}, BLOCK | SCOPE - {tag})
        elif tag in TABLE_PARTS:
            if not places.get("table"):
                continue
            while stack[-1].tag != "table" and not (
                stack[-1].tag == "tr" and tag in ("td", "th") or stack[-1].tag in SECTIONS and tag in ("tr", "td", "th")
                or stack[-1].tag == "colgroup" and tag == "col"
            ):
                cut(len(stack) - 1)
            if tag in ("td", "th") and stack[-1].tag != "tr":
                row = Node("tr", {})
                stack[-1].children.append(row)
                push(row)
        node = Node(tag, attributes)
        put(node)
        if tag in RAW:
            closing = _RAW_END[tag].search(page, at)
            content = page[at : closing.start() if closing else end_of_page]
            at = closing.end() if closing else end_of_page
            if tag == "style":
                styles.append(content)
            elif tag in ("textarea", "xmp"):
                node.children.append(html.unescape(content) if tag == "textarea" else content)
        elif tag not in VOID and not (raw.endswith("/") and (places.get("svg") or places.get("math"))):
            push(node)
    return root, styles


def _on_screen(prelude: str) -> bool:
    """Whether the rules in an at-rule's block hold. Conditions on the screen's size are unknown and count as not met."""
    kind, _, rest = prelude.lower().partition(" ")
    if kind in ("@layer", "@supports"):
        return True
    return kind == "@media" and any(q.strip() in ("", "all", "screen", "only screen", "only all", "not print", "not speech") for q in rest.split(","))


def rules_of(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on a screen, in one pass."""
    css = _COMMENT.sub(" ", css)
    blocks: list[str | None] = []
    begin, hidden = 0, 0
    for mark in _CSS_MARK.finditer(css):
        what = mark[0]
        if what == "{":
            prelude = css[begin : mark.start()].strip()
            inside_rule = bool(blocks) and blocks[-1] is not None
            if prelude.startswith("@") or inside_rule:
                blocks.append(None)
                hidden += hidden > 0 or inside_rule or not _on_screen(prelude)
            else:
                blocks.append(prelude)
            begin = mark.end()
        elif what == "}" and blocks:
            selectors = blocks.pop()
            if selectors is not None and not hidden:
                yield selectors, css[begin : mark.start()]
            hidden -= selectors is None and hidden > 0
            begin = mark.end()
        elif what == ";" and not (blocks and blocks[-1] is not None):
            begin = mark.end()
    if blocks and blocks[-1] is not None and not hidden:
        yield blocks[-1], css[begin:]


def _declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of what sets visibility."""
    found = []
    for part in body.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility"):
            found.append((name, value.replace("!important", "").strip(), "!important" in value))
    return found


def _chain(selector: str) -> tuple[tuple[str, str, frozenset, frozenset], ...] | None:
    """(combinator before it, element, classes, ids) of each compound; None for selectors that are not understood."""
    chain, at, combinator = [], 0, ""
    while True:
        compound = _COMPOUND.match(selector, at)
        if compound.end() == at:
            return None
        parts = re.findall(r"([.#])([\w-]+)", compound[2])
        chain.append((combinator, (compound[1] or "*").lower(), frozenset(n for k, n in parts if k == "."), frozenset(n for k, n in parts if k == "#")))
        at = compound.end()
        if at == len(selector):
            return tuple(chain)
        found = _COMBINATOR.match(selector, at)
        if not found:
            return None
        combinator, at = found[1] or " ", found.end()


class Styles:
    """Rules of a page. A selector is matched from the outside in: what its first compounds found is handed down the tree."""

    def __init__(self, sheets: list[str]):
        self.chains: list[tuple] = []
        # What a chain sets, by property and importance: the last rule of those with equal selectors counts.
        self.sets: list[dict[tuple[str, bool], tuple[str, tuple, str]]] = []
        self.first: dict[str, list[int]] = {}
        known: dict[tuple, int] = {}
        order = 0
        for selectors, body in (rule for sheet in sheets for rule in rules_of(sheet)):
            declared = _declarations(body)
            for chain in (_chain(s.strip()) for s in selectors.split(",")) if declared else ():
                if not chain:
                    continue
                if (number := known.setdefault(chain, len(self.chains))) == len(self.chains):
                    _, element, classes, ids = chain[0]
                    self.first.setdefault(f"#{min(ids)}" if ids else f".{min(classes)}" if classes else element, []).append(number)
                    self.chains.append(chain)
                    self.sets.append({})
                weight = (sum(len(c[3]) for c in chain), sum(len(c[2]) for c in chain), sum(c[1] != "*" for c in chain))
                order += 1
                for what, value, important in declared:
                    self.sets[number][what, important] = (what, (important, False, weight, order), value)

    def apply(self, node, handed: tuple[frozenset, frozenset]) -> tuple[list, tuple[frozenset, frozenset]]:
        """What the rules set for a node, and what its children are handed: (rule, compounds matched) by any element
        above, and by the parent."""
        if not self.chains:
            return [], handed
        tag, attributes = node.tag, node.attributes
        classes, own = frozenset(attributes.get("class", "").split()), attributes.get("id")
        keys = ["*", tag, *(f".{c}" for c in classes), *([f"#{own}"] if own else [])]
        states = {(rule, 0) for key in keys for rule in self.first.get(key, ())} | handed[0] | handed[1]
        found, above, parent = [], [], []
        for rule, i in states:
            chain = self.chains[rule]
            _, element, wanted, ids = chain[i]
            if element in ("*", tag) and wanted <= classes and ids <= {own}:
                if i + 1 == len(chain):
                    found += self.sets[rule].values()
                else:
                    (parent if chain[i + 1][0] == ">" else above).append((rule, i + 1))
        return found, (handed[0].union(above) if above else handed[0], frozenset(parent))


def _shown(node: Node, found: list) -> tuple[bool, str | None]:
    """Whether the element is laid out, and the visibility that it sets; `found`: what the rules say."""
    attributes = node.attributes
    if not attributes and not found:
        return node.tag not in UNSEEN, None
    display = "none" if "hidden" in attributes or node.tag in UNSEEN else ""
    if node.tag == "dialog" and "open" not in attributes or node.tag == "input" and attributes.get("type", "").lower() == "hidden":
        display = "none"
    visibility = None
    if "style" in attributes:
        inline = _declarations(attributes["style"])
        found = found + [(what, (important, True, (0, 0, 0), i), value) for i, (what, value, important) in enumerate(inline)]
    for what, _, value in sorted(found, key=lambda f: f[1]):
        if what == "display" and node.tag not in UNSEEN:
            display = value
        elif what == "visibility":
            visibility = value
    return display != "none", visibility


class Box:
    """Lines of one flow of text: the page, or one table cell."""

    __slots__ = ("lines", "parts", "gap", "indent", "marker")

    def __init__(self):
        # `parts` of the line that is not ended yet; none is empty.
        self.lines, self.parts, self.gap, self.indent, self.marker = [], [], 0, "", ""

    def add(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.parts or self.parts[-1][-1] == " ":
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def add_kept(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.parts.append(first)
        for line in rest:
            self.end_line(True)
            self.parts = [line] if line else []

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        if line.strip() or forced:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.lines.append((self.indent[: len(self.indent) - len(self.marker)] + self.marker + line).rstrip(" "))
            self.marker = ""
        self.parts = []

    def block(self, lines: int) -> None:
        self.end_line()
        self.gap = max(self.gap, lines)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


class Table:
    """Rows of cell texts; `held` are the columns that a row span still covers."""

    __slots__ = ("rows", "held", "caption")

    def __init__(self):
        self.rows, self.held, self.caption = [], {}, ""

    def new_row(self) -> None:
        row = {}
        for column, left in list(self.held.items()):
            row[column] = ""
            if left > 1:
                self.held[column] = left - 1
            else:
                del self.held[column]
        self.rows.append(row)

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.new_row()
        row, column = self.rows[-1], 0
        while column in row:
            column += 1
        for i in range(across):
            row.setdefault(column + i, "")
            if down > 1:
                self.held[column + i] = down - 1
        row[column] = text

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        cut = [{c: text.split("\n") for c, text in row.items()} for row in self.rows if any(row.values())]
        for row in cut:
            for column, lines in row.items():
                widths[column] = max(widths.get(column, 0), min(PAD, max(map(len, lines))))
        columns = [c for c in sorted(widths) if widths[c]]
        out = self.caption.split("\n") if self.caption else []
        for row in cut:
            for i in range(max(len(lines) for lines in row.values())):
                cells = [(row[c][i] if c in row and i < len(row[c]) else "").ljust(widths[c]) for c in columns]
                last = max((n for n, cell in enumerate(cells) if cell.strip(" ")), default=0)
                out.append(" | ".join(cells[: last + 1]).rstrip(" "))
        return out


def _number(text: str | None, default: int, most: int = 1000) -> int:
    return min(int(text), most) if text and text.strip().isascii() and text.strip().isdigit() else default


def render(page: str | None) -> str:
    """The visible text of one page. Null, empty and invisible pages give an empty string."""
    if not page:
        return ""
    root, styles = parse(page.replace("\x00", ""))
    rules = Styles(styles)
    box, tables, lists = Box(), [], []
    # Work still to do: (node or text, visible, kept white space, what selectors found above) or a function that ends an element.
    work: list = [(root, True, False, (frozenset(), frozenset()))]
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, visible, kept, handed = item
        if isinstance(node, str):
            if visible:
                box.add_kept(node) if kept else box.add(node)
            continue
        found, handed = rules.apply(node, handed)
        shown, visibility = _shown(node, found)
        if not shown:
            continue
        if visibility is not None:
            visible = visibility not in ("hidden", "collapse")
        tag, children = node.tag, node.children
        if tag == "br":
            box.end_line(True) if visible else None
            continue
        if tag == "input":
            if visible and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                box.add(node.attributes.get("value", ""))
            continue
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        elif tag == "select":
            options = [o for c in children if isinstance(c, Node) for o in (c.children if c.tag == "optgroup" else [c]) if isinstance(o, Node)]
            if "multiple" in node.attributes or _number(node.attributes.get("size"), 1) > 1:
                children = [Node("div", {}) for _ in options]
                for line, option in zip(children, options, strict=True):
                    line.children.append(option)
            else:
                children = [o for o in options if "selected" in o.attributes][:1] or options[:1]
        ends = []
        spacing = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        inner = bool(lists) and tag in ("ul", "ol", "menu", "dir")
        if spacing and tag != "option":
            box.block(1 if inner else spacing)
            ends.append(lambda n=1 if inner else spacing: box.block(n))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag == "ol", _number(node.attributes.get("start"), 1, 10**9)])
            ends.append(lists.pop)
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0]:
                lists[-1][1] = _number(node.attributes.get("value"), lists[-1][1], 10**9)
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            before = box.indent
            box.indent, box.marker = before + " " * len(marker), marker

            def end_item(before=before):
                box.end_line()
                box.indent, box.marker = before, ""

            ends.append(end_item)
        elif tag in ("blockquote", "dd"):
            before = box.indent
            box.indent = before + "  "

            def end_indent(before=before):
                box.end_line()
                box.indent = before

            ends.append(end_indent)
        elif tag in ("pre", "textarea", "listing", "xmp"):
            kept = True
            if children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
        elif tag == "table":
            tables.append((Table(), lists))
            lists = []

            def end_table():
                nonlocal lists
                table, lists = tables.pop()
                for line in table.lines():
                    box.parts = [line]
                    box.end_line()

            ends.append(end_table)
        elif tag == "tr" and tables:
            tables[-1][0].new_row()
        elif tag in ("td", "th", "caption") and tables:
            outer, box = box, Box()

            def end_cell(outer=outer, node=node, table=tables[-1][0]):
                nonlocal box
                text, box = box.text(), outer
                if node.tag == "caption":
                    table.caption = text
                else:
                    table.cell(text, max(1, _number(node.attributes.get("colspan"), 1)), max(1, _number(node.attributes.get("rowspan"), 1, 65534)))

            ends.append(end_cell)
        work.extend(ends)
        work.extend((child, visible, kept, handed) for child in reversed(children))
    return box.text()


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """One row per page: the key, text, n_chars (characters of text).

    Null and empty pages give an empty text; broken markup never fails, what cannot be read as a tag is
    text. The time for a page grows with its length, whatever is left open in it, and with the different selectors that
    match about an element. Style rules are read with
    element, class and id selectors, alone, compound, or as descendants and children, in the order of the cascade; selectors
    with attributes, pseudo-classes or siblings, and media queries with conditions, are passed over. Cells are
    aligned up to PAD characters. Repeated rows are rendered each; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches, "html", PAGE_BLOCK):
            texts = [render(page) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "text", "n_chars"],
            )

    rows = pages.select(F.col(key).alias("id"), F.col(source).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, n_chars long").withColumnRenamed("id", key)
