"""Visible text of HTML pages with their layout: a tree builder with implied tags, visibility rules, and a
renderer that keeps block spacing, lists and aligned table cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import session, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that browsers with scripts never show, or show something else for.
HIDDEN = frozenset(
    "head title script style template noscript noembed noframes iframe object video audio canvas datalist area param rp "
    "desc metadata defs symbol clippath mask marker pattern annotation annotation-xml".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td text textarea tfoot th thead tr ul".split()
)
#: Elements whose text keeps its lines and spaces.
PRE = frozenset(("pre", "textarea"))
#: Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure".split())
#: An opening tag ends these where they are open, up to the nearest tag of the scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - frozenset("body html caption legend li dd dt summary tbody td tfoot th thead tr optgroup option text textarea".split())
#: Open inline tags do not keep an end tag of an outer block from its element.
SCOPE = frozenset("table td th caption html".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def style(self) -> dict[str, str]:
        """The declarations of the style attribute; of several for a property the last."""
        pairs = (x.partition(":") for x in (self.attrs.get("style") or "").lower().split(";"))
        return {k.strip(): v.replace("!important", "").strip() for k, _, v in pairs}

    def laid_out(self, parent: Node) -> bool:
        """Whether the element has a box: not so elements that are never shown, hidden or closed ones, and what
        a closed details element holds beside its first summary."""
        if self.tag in HIDDEN or "hidden" in self.attrs or (self.tag == "dialog" and "open" not in self.attrs):
            return False
        if "style" in self.attrs and self.style().get("display") == "none":
            return False
        if parent.tag == "details" and "open" not in parent.attrs:
            return self is next((c for c in parent.children if isinstance(c, Node) and c.tag == "summary"), None)
        return True

    def seen(self, before: bool) -> bool:
        """Whether text right within is visible, where `before` says so of the parent. Unlike display, visibility
        can be had back within a hidden element."""
        own = self.style().get("visibility") if "style" in self.attrs else None
        return own == "visible" if own in ("visible", "hidden", "collapse") else before


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open: list[Node] = [self.root]

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections are comments in HTML, whatever stands in them."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def _end(self, tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        """Closes the outermost open element of tags that lies within the nearest of scope."""
        at = None
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in scope:
                break
            if self.open[k].tag in tags:
                at = k
        if at is not None:
            del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ENDS_P:
            self._end({"p"}, SCOPE)
        if self.open[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
            self.open.pop()  # a head that was never closed
        top = self.open[-1].tag
        if tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr"))
        self._push(Node(tag, dict(attrs)), tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on elements that are not void

    def _push(self, node: Node, void: bool = False) -> None:
        self.open[-1].children.append(node)
        if not void:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self._push(Node("br"), True)
            return
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self._push(Node("p"), True)
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in SCOPE and tag not in ("table", "tbody", "thead", "tfoot", "tr", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


class _Block:
    """Lines gathered so far. Space around blocks is one empty line, however many ask for it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            parts = s.split("\n")
            for part in parts[:-1]:
                self.inline.append(part)
                self.flush(True)
            self.inline.append(parts[-1])
        elif s := _SPACE.sub(" ", s):
            if s[0] == " " and (not self.inline or self.inline[-1].endswith(" ")):
                s = s[1:]
            if s:
                self.inline.append(s)

    def flush(self, keep_empty: bool = False, pre: bool = False) -> None:
        line = "".join(self.inline)
        line = line.rstrip() if pre or keep_empty else line.strip()
        self.inline = []
        if line or keep_empty:
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines and self.lines[-1] and lines[0]:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def space(self) -> None:
        self.gap = True


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Cells (lines, span) of rows as padded columns; a cell that spans several columns widens none."""
    width: list[int] = []
    for row in rows:
        k = 0
        for lines, span in row:
            width += [0] * (k + span - len(width))
            if span == 1:
                width[k] = max([width[k], *map(len, lines)])
            k += span
    out = []
    for row in rows:
        for n in range(max([1, *(len(lines) for lines, _ in row)])):
            line, k = "", 0
            for lines, span in row:
                w = sum(width[k : k + span]) + 3 * (span - 1)
                line += (" | " if k else "") + (lines[n] if n < len(lines) else "").ljust(w)
                k += span
            out.append(line.rstrip())
    return out


def _span(node: Node) -> int:
    n = node.attrs.get("colspan") or "1"
    return min(max(int(n), 1), 1000) if n.isascii() and n.isdigit() else 1


def render(root: Node) -> str:
    """Text of the visible nodes. The walk keeps its own stack, so depth is bounded by memory alone."""
    top = _Block()
    blocks, pres, lists, tables = [top], [False], [], []
    # of open elements: the rest of the children, whether visibility allows text, whether text is drawn (in SVG only that of text elements is)
    stack: list[tuple[Node, Iterator[Node | str], bool, bool]] = [(root, iter(root.children), True, True)]
    while stack:
        node, children, seen, drawn = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            _leave(node, blocks, pres, lists, tables, seen)
        elif isinstance(child, str):
            closed = node.tag == "details" and "open" not in node.attrs
            if seen and drawn and not closed and not (node.tag in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "dl", "select", "optgroup") and not child.strip()):
                blocks[-1].text(child, pres[-1])
        elif child.laid_out(node):
            shown = child.seen(seen)
            _enter(child, blocks, pres, lists, tables, shown)
            stack.append((child, iter(child.children), shown, child.tag != "svg" and (drawn or child.tag in ("text", "foreignobject"))))
    top.flush()
    return "\n".join(top.lines)


def _enter(node: Node, blocks: list[_Block], pres: list[bool], lists: list[list], tables: list[list], seen: bool) -> None:
    b, tag = blocks[-1], node.tag
    if tag in BLOCK:
        b.flush(pre=pres[-1])
        if tag in SPACED or (tag in ("ul", "ol", "menu") and not lists):
            b.space()
    if tag in PRE:
        pres.append(True)
    elif tag in ("ul", "ol", "menu"):
        start = node.attrs.get("start") or "1"
        lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
    elif tag == "table":
        tables.append([])
    elif tag == "tr" and tables:
        tables[-1].append([])
    if tag == "li" or tag == "dd" or tag == "blockquote" or (tag in ("td", "th", "caption")) or tag == "table":
        blocks.append(_Block())
        if tag in ("td", "th", "caption", "table"):
            pres.append(False)
    elif not seen:
        return
    elif tag == "br":
        b.flush(True, pres[-1])
    elif tag == "hr":
        b.add(["---"])
    elif tag == "img" and node.attrs.get("alt"):
        b.text(node.attrs["alt"], False)
    elif tag == "optgroup" and node.attrs.get("label"):
        b.add([_SPACE.sub(" ", node.attrs["label"]).strip()])


def _leave(node: Node, blocks: list[_Block], pres: list[bool], lists: list[list], tables: list[list], seen: bool) -> None:
    tag = node.tag
    if tag in PRE:
        blocks[-1].flush(pre=True)
        pres.pop()
    elif tag in ("li", "dd", "blockquote"):
        inner = blocks.pop()
        inner.flush(pre=pres[-1])
        mark = ""
        if tag == "li":
            kind = lists[-1] if lists else ["ul", 1]
            mark = "" if not seen and not inner.lines else f"{kind[1]}. " if kind[0] == "ol" else "- "
            kind[1] += 1
        pad = " " * len(mark) if mark else "  "
        blocks[-1].add([(mark if k == 0 and mark else pad if x else "") + x for k, x in enumerate(inner.lines or [""])] if inner.lines or mark else [])
    elif tag in ("td", "th", "caption"):
        pres.pop()
        inner = blocks.pop()
        inner.flush()
        if tag == "caption" or not tables:
            blocks[-1].add(inner.lines)
        else:
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((inner.lines, _span(node)))
    elif tag == "table":
        pres.pop()
        inner = blocks.pop()  # what stood between the cells
        inner.flush()
        rows = [r for r in tables.pop() if r]
        blocks[-1].add(inner.lines + _aligned(rows))
    elif tag in ("ul", "ol", "menu") and lists:
        lists.pop()
    if tag in BLOCK:
        blocks[-1].flush(pre=pres[-1])
        if tag in SPACED or (tag in ("ul", "ol", "menu") and not lists):
            blocks[-1].space()


def visible_text(html: str | None) -> str:
    """The visible text of a page as a browser with scripts on, but no style sheets, shows it; of a null or empty
    page, the empty text. Form text counts: all options of a select, and what a textarea holds. Values of input
    fields, alternatives for media and closed dialogs do not. Broken markup never raises."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows (page_id, text, n_chars, n_lines), one for each page, in one pass without a shuffle.

    Null ids and repeated rows come back as often as they occur; a null or empty page has the empty text, 0
    characters and 0 lines; of an empty table there are no rows. Other columns are ignored."""
    session(pages.sparkSession)
    schema = "page_id long, text string, n_chars long, n_lines long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [visible_text(h) for h in b.column("html").to_pylist()]
            yield batch_of(
                schema,
                {"page_id": b.column("page_id"), "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [len(t.splitlines()) for t in texts]},
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
