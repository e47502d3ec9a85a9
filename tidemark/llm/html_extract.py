"""The main text of a web page by tree scoring.

The page becomes a tree of elements. Menus, page headers and footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are struck out by tag, role or the words of class and id, unless a part struck out by its
name alone holds most of the page's running text. Each block of text then scores by its length and commas; the
score passes to its ancestors (whole to the parent, half to the grandparent, a third and so on above)
and is discounted by the share of text inside links. The best container is kept, widened to the article or
main element around it, with those siblings that score well or are running text. All blocks inside
come in page order: character references decoded, white space turned into single spaces, trimmed, joined by
an empty line. Nothing inside is dropped or shortened.

Defined cases: a null or empty page, or one without running text, gives the empty string. Markup that isn't closed
ends with what encloses it; a paragraph ends where a block begins. Every row is read by itself, so
repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Elements of HTML by how they behave.
VOID = set("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = set("script style noscript template textarea title iframe noframes noembed xmp svg math canvas object video audio select head".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption hr".split()
)
CLOSES_P = BLOCK - {"html", "body", "legend", "summary", "option", "optgroup"}
#: An open element of the first kind ends where one of the second kind begins, up to a boundary of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
STRUCK = set("nav footer aside form button input fieldset menu dialog search label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
NAMES = set(
    "nav navbar navigation menu menus header masthead topbar footer footers sidebar sidebars aside rail ad ads adv advert adverts advertisement advertising "
    "adbox banner banners promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert alerts warning popup popups modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager skip toolbar widget widgets copyright legal "
    "disclaimer tags taglist outbrain taboola hidden".split()
)
MAIN = set("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|$)?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "kids", "struck", "named", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids, self.struck, self.named, self.score, self.chars, self.linked = tag, parent, [], False, False, 0.0, 0, 0


def _judge(node: Node, attrs: str, inside_main: bool) -> None:
    """struck: never main text; named: only its name says so."""
    if node.tag in STRUCK or (node.tag == "header" and not inside_main):
        node.struck = True
    if not attrs.strip():
        return
    got = {}
    for k, *v in _ATTR.findall(attrs):
        got.setdefault(k.lower(), html.unescape("".join(v)))
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or _NONE.search(got.get("style", "").lower()) or got.get("role", "").lower() in ROLES:
        node.struck = True
    elif node.tag not in ("html", "body", "article", "main"):
        words = {w.lower() for w in _PART.findall(got.get("class", "") + " " + got.get("id", ""))}
        node.named = not words.isdisjoint(NAMES)
    if got.get("role", "").lower() in MAIN or "articlebody" in got.get("itemprop", "").lower():
        node.tag = "main"


def parse(page: str) -> Node:
    root = at = Node("#root", None)
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[4] is None:  # a quote that never ends: the tag ends at the next >
            end = page.find(">", m.start())
            pos = n if end < 0 else end + 1
            attrs = page[m.end(2) : pos].removesuffix(">")
        if m[1]:  # an end tag closes the nearest element of its name, if any is open
            up = at
            while up is not root and up.tag != tag and not (up.tag == "main" and tag in ("div", "section", "article")):
                if tag not in BLOCK and up.tag in BLOCK:
                    up = root  # an inline end tag doesn't reach out of its block
                    break
                up = up.parent
            if up is not root:
                at = up.parent
            elif tag == "p" or tag == "br":
                at.kids.append(Node(tag, at))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos) if not attrs.rstrip().endswith("/") else None
            if tag == "head" and end is None:
                continue
            pos = end.end() if end else (pos if attrs.rstrip().endswith("/") or tag in ("svg", "math", "object", "video", "audio", "canvas") else n)
            continue
        if tag in CLOSES_P:
            up = at
            while up is not root and up.tag not in ("p", "table", "td", "th", "li", "div", "article", "section", "main", "blockquote", "button"):
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in ENDS:
            kinds, stop = ENDS[tag]
            up, last = at, None
            while up is not root and up.tag not in stop:
                if up.tag in kinds:
                    last = up
                up = up.parent
            if last is not None:
                at = last.parent
        if tag in ("html", "body") and at is not root and attrs == "":
            continue
        node = Node(tag, at)
        up, inside = at, False
        while up is not None and not inside:
            inside, up = up.tag in MAIN, up.parent
        _judge(node, attrs, inside)
        at.kids.append(node)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            at = node
        elif attrs.rstrip().endswith("/") and tag not in VOID:
            at = node if tag in BLOCK else at
    return root


def _walk(root: Node) -> tuple[list[tuple[Node, str, int]], dict[int, tuple[int, int]]]:
    """Blocks of text in page order with the element that holds each and the characters inside links; and each element's span of blocks."""
    blocks: list[tuple[Node, str, int]] = []
    spans: dict[int, tuple[int, int]] = {}
    parts: list[str] = []
    linked = 0
    holder = root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((holder, text, min(linked, len(text))))
            parts, linked = [], 0

    # An explicit stack, as pages can nest deeper than Python's recursion.
    stack: list[tuple[Node, int, Node, int, int]] = []
    node, i, start, depth = root, 0, 0, 0
    while True:
        if i < len(node.kids):
            kid = node.kids[i]
            i += 1
            if isinstance(kid, str):
                parts.append(kid)
                if depth:
                    linked += len(kid)
            elif kid.struck:
                if kid.tag in BLOCK:
                    flush()
            elif kid.tag == "br":
                parts.append(" ")
            else:
                stack.append((node, i, holder, start, depth))
                if kid.tag in BLOCK:
                    flush()
                    holder = kid
                node, i, start, depth = kid, 0, len(blocks), depth + (kid.tag == "a")
            continue
        if node.tag in BLOCK or node is root:
            flush()
        spans[id(node)] = (start, len(blocks))
        if not stack:
            return blocks, spans
        node, i, holder, start, depth = stack.pop()


def _points(text: str, linked: int) -> float:
    if len(text) < 25:
        return 0.0
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def extract(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    blocks, spans = _walk(root)
    mains = [x for x in _nodes(root) if x.tag in MAIN and spans[id(x)][0] < spans[id(x)][1]]
    named = [x for x in _nodes(root) if x.named]
    if named:
        total = sum(_points(t, k) for _, t, k in blocks)
        for node in named:  # struck out by name, unless it holds the main element, or most of what scores where there is none
            a, b = spans[id(node)]
            holds = any(a <= spans[id(x)][0] and spans[id(x)][1] <= b for x in mains)
            node.struck = not holds and (bool(mains) or sum(_points(t, k) for _, t, k in blocks[a:b]) <= 0.5 * total)
        blocks, spans = _walk(root)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for holder, text, linked in blocks:
        points, share, up = _points(text, linked), 1.0, holder.parent if holder.tag in ("p", "li", "td", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else holder
        level = 0
        while up is not None:
            up.score += points * share
            up.chars += len(text)
            up.linked += linked
            scored[id(up)] = up
            level += 1
            share, up = (0.5 if level == 1 else 1 / (level * 3)), up.parent
    value = lambda x: x.score * (1 - x.linked / max(x.chars, 1)) * (1.5 if x.tag in MAIN else 1)
    mains = [x for x in _nodes(root) if x.tag in MAIN and id(x) in spans and spans[id(x)][0] < spans[id(x)][1]]
    best = max(scored.values(), key=lambda x: (value(x), x.chars), default=root)
    if value(best) <= 0:
        best = max(mains, key=lambda x: (value(x), x.chars), default=root)
    up = best
    while up is not None:
        if up.tag in MAIN:
            best = up
        up = up.parent
    keep = [spans[id(best)]]
    if best.parent is not None:
        least = 0.2 * value(best)
        for kid in best.parent.kids:
            if isinstance(kid, Node) and kid is not best and not kid.struck and id(kid) in spans:
                a, b = spans[id(kid)]
                chars, linked = sum(len(t) for _, t, _ in blocks[a:b]), sum(k for _, _, k in blocks[a:b])
                if (id(kid) in scored and value(kid) >= least) or (kid.tag in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol") and chars and linked < 0.3 * chars):
                    keep.append((a, b))
    return "\n\n".join(t for i, (_, t, _) in enumerate(blocks) if any(a <= i < b for a, b in keep))


def _nodes(root: Node) -> Iterator[Node]:
    """All elements outside what is struck out."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in node.kids if isinstance(k, Node) and not k.struck)


def main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The columns of pages besides html_col, and out_col (which replaces one of that name)."""
    own = [c for c in pages.columns if c.lower() not in (html_col.lower(), out_col.lower())]
    rows = pages.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{html_col}`").alias("hx_page"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(p) for p in b.column(len(own)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(own)], texts], names=[*own, out_col])

    return rows.mapInArrow(run, f"{schema}, `{out_col}` string" if schema else f"`{out_col}` string")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    out = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
