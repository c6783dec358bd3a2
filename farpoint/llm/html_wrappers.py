"""Main text of web pages by union-free regular expressions inferred for each host.

A page is read as a balanced stream of structural tags and texts.  A wrapper is an expression of
tags, optional and repeated groups and text slots, without alternatives.  Two streams of one
host are aligned from the outside in: equal tags are matched, a tag that only one of them has
becomes optional, a run that stands again next to itself becomes a repeated group, and texts
that differ become a slot; texts that never differ stay as the template's own.  Each task folds
its pages into one wrapper a host, and the wrappers of the tasks are aligned in two more rounds,
so a host of very many pages is never gathered.

A page's text is read by matching the page against its host's wrapper.  Slots that most pages of
the host hold alike are the template's, inside an article too, and are left out.  Never main text
are the slots of a menu, header, footer, sidebar, notice, advert, form or comment, which tags,
roles and names tell.  Of the rest, the text comes from one region: the innermost of page, main
element and article whose own slots, those that are not the template's, weigh enough.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import fresh_name, small_batches
from farpoint.session import materialize

#: Wrappers are sent to all tasks up to so many bytes; beyond it they are joined by host.
BROADCAST_BYTES = 8 << 20
SALTS = 32
#: A text is the template's where so many different pages of a host hold it, which are at least half
#: of the host's, and none holds another.
TEMPLATE_PAGES = 3
#: Different pages are counted by the least of their checksums: exactly up to so many, by their share beyond.
PAGES_KEPT = 16
#: An article in a main element, and either in its page, is the text's region if its own text weighs
#: at least this share of what surrounds it.  Headings weigh nothing.
REGION_SHARE = {2: 0.5, 1: 0.25}
#: A region that would lose more than this to the template keeps all: its pages are near copies.
TEMPLATE_SHARE = 0.75
#: Elements nested deeper end a block, but belong to the element at this depth.
DEEPEST = 150

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|select|svg|math|object|button|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

# Elements of HTML and the names that boilerplate goes by.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog head header".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social related recommended recommendations comment comments reply replies disqus widget pagination pager "
    "toolbar login search copyright legal disclaimer skip".split()
)
#: Last words of compound names that say nothing of what is inside.
_PLAIN_NAMES = frozenset(
    "area bar bottom box buttons button container inner item items left link links list outer panel posts right section slot top wrap wrapper".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",),
}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}


# --- reading a page ----------------------------------------------------------


@dataclass
class Element:
    label: str
    aside: bool = False
    main: bool = False
    children: list = field(default_factory=list)  # elements and texts


def _named(name: str) -> str:
    """What a class or id names: its last word, or the one before words like "box"."""
    words = [w.lower() for w in _WORDS.findall(name)]
    while len(words) > 1 and (words[-1] in _PLAIN_NAMES or words[-1].isdigit()):
        words.pop()
    return words[-1] if words else ""


def _flags(tag: str, rest: str) -> tuple[str, bool, bool]:
    """Label, whether it is beside the main text, and whether it holds the main text."""
    if not rest or "=" not in rest and "hidden" not in rest:
        return tag, tag in _ASIDE or " hidden" in rest, tag in ("article", "main")
    attributes = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(rest)}
    names = [*attributes.get("class", "").split(), *attributes.get("id", "").split()]
    words = {_named(name) for name in names}
    role = attributes.get("role", "").lower()
    style = attributes.get("style", "").replace(" ", "").lower()
    hidden = "display:none" in style or "visibility:hidden" in style or attributes.get("aria-hidden") == "true" or re.search(r"\shidden(\s|/?$)", rest)
    aside = tag in _ASIDE or role in _ASIDE_ROLES or bool(hidden)
    if tag not in ("html", "body", "main", "article") or "comment" in words or "comments" in words:
        beside = sum(_named(name) in _ASIDE_NAMES for name in names)
        aside = aside or beside > 0 and (2 * beside >= len(names) or _named(names[0]) in _ASIDE_NAMES)
    main = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
    label = tag + "".join(f".{c}" for c in sorted(attributes.get("class", "").split())[:2])
    return label, aside, main and not aside


def read(page: str) -> Element:
    """The page as a tree of block elements, ``DEEPEST`` at most; the white space of a text is still as it was."""
    root = Element("")
    stack: list[tuple[str, Element]] = [("", root)]

    def close(names: tuple[str, ...], up_to: tuple[str, ...]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                inner = stack[-1][1]
                del stack[at:]
                if stack[-1][1] is inner:
                    inner.children.append(Element("br"))
                return
            if stack[at][0] in up_to:
                return

    for m in _TOKEN.finditer(page):
        if m["text"] is not None or m["cdata"] is not None:
            text = entities.unescape(m["text"]) if m["text"] is not None else m["cdata"]
            held = stack[-1][1].children
            if held and isinstance(held[-1], str):
                held[-1] += text
            else:
                held.append(text)
        elif m["tag"]:
            tag = m["tag"].lower()
            if m["end"]:
                if tag in _BLOCKS or any(name == tag for name, _ in stack):
                    if tag == "p" and not any(name == "p" for name, _ in stack):
                        stack[-1][1].children.append(Element("br"))
                    close((tag,), ())
                continue
            if tag in _VOID:
                if tag in ("br", "hr"):
                    stack[-1][1].children.append(Element("br"))
                continue
            label, aside, main = _flags(tag, m["rest"])
            if tag not in _BLOCKS and not aside and not main:
                continue  # inline: its text belongs to the block around it
            if tag in _BLOCKS:
                close(("p",), ("td", "th", "li", "button"))
            if tag in _CLOSES:
                close(_CLOSES[tag], _HOLDS.get(tag, ()))
            element = Element(label, aside, main)
            if len(stack) > DEEPEST and (not aside or stack[-1][1].aside):
                stack[-1][1].children.append(Element("br"))
                element = stack[-1][1]
            else:
                stack[-1][1].children.append(element)
            if not m["rest"].rstrip().endswith("/"):
                stack.append((tag, element))
        elif m["raw"] and m["raw"].lower() not in ("svg", "math", "button"):
            pass  # scripts, styles and the like carry no text, and do not end a block
    return root


# --- wrappers ----------------------------------------------------------------
# A node is [label, least, most, text, children]: least 0 or 1, most 1 or 2 (two: any number).
# The label of an element has a "-" before it if it is beside the main text, a "+" if it holds it.
# An element's label has its first two classes, in order.
# A text slot has the label "#": its text is a checksum, or None where texts differ.  In place of
# children it has the least checksums of the pages that held the text, ``PAGES_KEPT`` at most.  The
# root has those of all pages in place of a text.

Node = list


def marked(element: Element) -> str:
    return ("-" if element.aside else "+" if element.main else "") + element.label


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def checksum(root: Element) -> int:
    """Checksum of what may be a page's main text: pages that differ in menus, sidebars or scripts are one page."""
    parts: list[str] = []
    waiting = [root]
    while waiting:
        element = waiting.pop()
        if isinstance(element, str):
            parts.extend(element.split())
        elif not element.aside:
            waiting.extend(reversed(element.children))
    return _digest(" ".join(parts))


def page_wrapper(root: Element) -> Node:
    """The wrapper of one page: its stream with what stands again next to itself made a group."""

    page = checksum(root)

    def node(element: Element) -> Node:
        children = []
        for child in element.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                if words:
                    children.append(["#", 1, 1, _digest(words), [page]])
            elif child.label != "br":
                children.append(node(child))
        return [marked(element), 1, 1, None, folded(children)]

    whole = node(root)
    whole[3] = [page]
    return whole


def folded(nodes: list[Node]) -> list[Node]:
    """``nodes`` with runs of up to four that are repeated at once made repeated groups.

    A longer run that is repeated stays written out; later pages find its places one after the other.
    """
    for period in range(1, 5):
        out: list[Node] = []
        for item in nodes:
            out.append(item)
            while len(out) >= 2 * period and [n[0] for n in out[-period:]] == [n[0] for n in out[-2 * period : -period]]:
                second, first = out[-period:], out[-2 * period : -period]
                del out[-2 * period :]
                for a, b in zip(first, second):
                    joined = merged(a, b)
                    joined[2] = 2
                    out.append(joined)
        nodes = out
    return nodes


def merged(a: Node, b: Node) -> Node:
    """The least node, without alternatives, that covers two of one label."""
    if a == b:
        return [*a]
    least, most = min(a[1], b[1]), max(a[2], b[2])
    if a[0] != "#":
        pages = _union(a[3], b[3]) if a[3] and b[3] else None
        return [a[0], least, most, pages, aligned(a[4], b[4])]
    if a[3] is None or a[3] != b[3]:
        return ["#", least, most, None, []]
    return ["#", least, most, a[3], _union(a[4], b[4])]


def _union(a: list[int], b: list[int]) -> list[int]:
    return sorted({*a, *b})[:PAGES_KEPT]


def of_template(held: list[int], pages: list[int]) -> bool:
    """Whether a text that no page differs in is the template's, by the pages that held it and all pages."""
    return len(held) >= TEMPLATE_PAGES and 2 * len({*held} & {*pages}) >= len(pages)


def aligned(xs: list[Node], ys: list[Node]) -> list[Node]:
    """Two sequences as one: equal labels are matched in order, others become optional."""
    start = 0
    out: list[Node] = []
    while start < min(len(xs), len(ys)) and xs[start][0] == ys[start][0]:
        out.append(merged(xs[start], ys[start]))
        start += 1
    xs, ys = xs[start:], ys[start:]
    end: list[Node] = []
    while xs and ys and xs[-1][0] == ys[-1][0]:
        end.append(merged(xs[-1], ys[-1]))
        xs, ys = xs[:-1], ys[:-1]
    if xs and ys:
        best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs) - 1, -1, -1):
            for j in range(len(ys) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if xs[i][0] == ys[j][0] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(xs) or j < len(ys):
            if i < len(xs) and j < len(ys) and xs[i][0] == ys[j][0]:
                out.append(merged(xs[i], ys[j]))
                i, j = i + 1, j + 1
            elif j == len(ys) or i < len(xs) and best[i + 1][j] >= best[i][j + 1]:
                out.append([xs[i][0], 0, *xs[i][2:]])
                i += 1
            else:
                out.append([ys[j][0], 0, *ys[j][2:]])
                j += 1
    else:
        out += [[n[0], 0, *n[2:]] for n in [*xs, *ys]]
    return folded([*out, *reversed(end)])


def expression(node: Node) -> str:
    """A wrapper as it is written in the literature: ``( )?``, ``( )+`` and ``#PCDATA``."""
    if node[0] == "#":
        body = "#PCDATA" if node[3] is None else f"#{node[3]:016x}"
    else:
        label, inside = node[0].lstrip("-+"), " ".join(expression(n) for n in node[4])
        body = f"<{label}>{inside}</{label.split('.')[0]}>" if label else inside
    mark = {(1, 1): "", (0, 1): "?", (1, 2): "+", (0, 2): "*"}[(node[1], node[2])]
    return f"({body}){mark}" if mark else body


def wrappers(pages: DataFrame, host: str = "host", page: str = "html") -> DataFrame:
    """``(host, pages, wrapper)``: the wrapper of every host as JSON and the pages it was inferred from."""

    def folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    one = page_wrapper(read(text))
                    known = held.get(name)
                    held[name] = [known[0] + 1, merged(known[1], one)] if known else [1, one]
            if len(held) > 5_000:  # very many hosts: hand on what there is
                yield _batch(held)
                held = {}
        yield _batch(held)

    def joining(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["host"].to_pylist(), table["wrapper"].to_pylist(), table["pages"].to_pylist()), key=lambda r: (r[1], r[2]))
        tree, count = json.loads(rows[0][1]), rows[0][2]
        for _, text, n in rows[1:]:
            tree, count = merged(tree, json.loads(text)), count + n
        return pa.Table.from_batches([_batch({rows[0][0]: [count, tree]})])

    schema = "host string, pages long, wrapper string"
    parts = small_batches(pages).select(F.col(host).alias("host"), F.col(page).alias("html")).mapInArrow(folding, schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    once = salted.groupBy("host", "salt").applyInArrow(joining, schema)
    return once.groupBy("host").applyInArrow(joining, schema)


def _batch(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(held), pa.string()),
            pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([json.dumps(w, separators=(",", ":")) for _, w in held.values()], pa.string()),
        ],
        names=["host", "pages", "wrapper"],
    )


# --- applying a wrapper ------------------------------------------------------


# Where a slot is: outside of main text, in a main element (which may have its own inner articles),
# in an article or the like, or in such an inner article.
OUTSIDE, MAIN, ARTICLE, INNER = range(4)
_DEPTH = (0, 1, 1, 2)


def _region(around: int, label: str) -> int:
    """The region that an element opens, or the one it stands in."""
    if label[:1] == "+":
        if around == OUTSIDE:
            return MAIN if label[1:].split(".")[0] == "main" else ARTICLE
        return INNER if around == MAIN else around
    return around


@dataclass
class Place:
    """A node of a wrapper as pages are matched against it."""

    label: str = ""
    region: int = OUTSIDE
    least: int = 0
    repeated: bool = False
    first: int = 0  # of the repeated nodes next to it: after one of them, any may follow
    fixed: int | None = None  # checksum of the template's own text
    children: list[Place] = field(default_factory=list)


@dataclass
class Places:
    """What a wrapper says of its slots; without a wrapper, pages are read by their tags alone."""

    root: Place | None = None

    @classmethod
    def of(cls, wrapper: str | None) -> Places:
        if not wrapper:
            return cls()

        def place(node: Node, around: int, first: int) -> Place:
            label, least, most, text, children = node
            if label == "#":
                return Place("#", around, least, most > 1, first, text if of_template(children, pages) else None)
            found = Place(label, _region(around, label), least, most > 1, first)
            start = 0
            for at, child in enumerate(children):
                if child[2] == 1 or at and children[at - 1][2] == 1:
                    start = at
                found.children.append(place(child, found.region, start))
            return found

        tree = json.loads(wrapper)
        pages = tree[3] or []
        return cls(place(tree, OUTSIDE, 0))


def _after(place: Place, at: int) -> int:
    """The first place that what follows a match with the place ``at`` can have."""
    return place.first if place.repeated else at + 1


def _missed(place: Place) -> int:
    return int(place.least > 0 and not place.repeated)


def matched(labels: list[str], places: list[Place]) -> list[Place | None]:
    """The place of each of the labels, in order: as many as can have one, then as few required places left empty."""
    out: list[Place | None] = [None] * len(labels)
    low, i, n, m = 0, 0, len(labels), len(places)
    while i < n and low < m and labels[i] == places[low].label:
        here = places[low]
        if here.repeated and (here.first != low or low + 1 < m and places[low + 1].repeated):
            break
        out[i] = here
        i, low = i + 1, low + 1
        while here.repeated and i < n and labels[i] == here.label:
            out[i] = here
            i += 1
    while i < n and low < m and labels[n - 1] == places[m - 1].label and not places[m - 1].repeated:
        n, m = n - 1, m - 1
        out[n] = places[m]
    if i == n or low == m:
        return out
    # score[r][j]: the best of the labels from r on against the places from j on
    width = m - low
    score = [[0] * (width + 1) for _ in range(n - i + 1)]
    for r in range(n - i, -1, -1):
        row, below = score[r], score[r + 1] if r < n - i else None
        for j in range(width, -1, -1):
            if j == width:
                row[j] = below[j] if below else 0
                continue
            here = places[low + j]
            best = row[j + 1] - _missed(here)
            if below:
                best = max(best, below[j])
                if here.label == labels[i + r]:
                    best = max(best, below[_after(here, low + j) - low] + (1 << 20))
            row[j] = best
    j = 0
    for r in range(n - i):
        while j < width:
            here = places[low + j]
            if here.label == labels[i + r] and score[r][j] == score[r + 1][_after(here, low + j) - low] + (1 << 20):
                out[i + r] = here
                j = _after(here, low + j) - low
                break
            if score[r][j] == score[r][j + 1] - _missed(here):
                j += 1
                continue
            break
    return out


@dataclass
class Block:
    depth: int  # of the region
    words: str
    own: bool  # not all of it is the template's
    weight: int  # of the text that is neither the template's nor a heading


def region_of(blocks: list[Block]) -> int:
    """The depth of the region that the main text is in: the innermost whose own text weighs enough."""
    weights = [sum(b.weight for b in blocks if b.depth == depth) for depth in range(3)]
    for depth in (2, 1):
        if weights[depth] and weights[depth] >= REGION_SHARE[depth] * max(weights[:depth]):
            return depth
    if weights[0]:
        return 0
    return max((b.depth for b in blocks), default=0)  # headings or the template's text alone


def main_text(page: str | None, places: Places) -> str:
    """The blocks of the main text, joined by newlines.

    A block is left out if all its texts are the template's, unless that were most of its region, or
    it is the h1 of an article.
    What no place of the wrapper fits is read by its own tags.
    """
    if not page:
        return ""
    blocks: list[Block] = []

    def walk(element: Element, place: Place | None, around: int, heading: bool, closed: bool) -> None:
        parts: list[str] = []
        own = False
        kind = element.label.split(".")[0]
        title, named = bool(re.fullmatch("h[1-6]", kind)), kind == "h1" and around != OUTSIDE  # an article's name is its own
        met = iter(matched([label for c in element.children if (label := _label(c))], place.children)) if place is not None else None

        def flush() -> None:
            nonlocal own
            words = " ".join("".join(parts).split())
            parts.clear()
            if words:
                blocks.append(Block(_DEPTH[around], words, own or named, len(words) if own and not title else 0))
            own = False

        for child in element.children:
            label = _label(child)
            there = next(met) if met is not None and label else None
            if isinstance(child, str):
                if not heading:
                    parts.append(child)
                    if label and not own:
                        own = there is None or there.fixed is None or there.fixed != _digest(" ".join(child.split()))
            elif not label:
                flush()
            else:
                name = child.label.split(".")[0]
                beside = child.aside and child.label != "header"
                if name in _BLOCKS or not beside:
                    flush()
                if not beside:
                    titled = (heading or child.aside) and not re.fullmatch("h[1-6]", name)
                    shut = closed or child.aside  # no region begins beside the main text
                    region = around if shut else there.region if there is not None else _region(around, label)
                    walk(child, there, region, titled, shut)
        flush()

    walk(read(page), places.root, OUTSIDE, False, False)
    depth = region_of(blocks)
    held = [b for b in blocks if b.depth == depth]
    lost = sum(len(b.words) for b in held if not b.own)
    if depth == 0 or lost <= TEMPLATE_SHARE * sum(len(b.words) for b in held):
        held = [b for b in held if b.own]
    return "\n".join(b.words for b in held)


def _label(child: Element | str) -> str:
    """The label in a wrapper; empty for what wrappers leave out."""
    if isinstance(child, str):
        return "" if child.isspace() or not child else "#"
    return "" if child.label == "br" else marked(child)


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extracted(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``page``, with the main ``text`` and its ``n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are
    joined in page order by one newline.  Null or empty pages have an empty text; pages without
    a host share one wrapper.  Repeated rows give repeated rows; columns called ``text`` or
    ``n_chars`` are replaced, others kept whatever their names.  An empty table gives an empty table.
    """
    kept = [c for c in pages.columns if c not in (page, out, "n_chars")]
    known = materialize(wrappers(pages.select(host_of(url).alias("host"), F.col(page).alias("html"))), "wrappers")
    size = known.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    of_host, of_page, of_wrapper = (fresh_name(pages, c) for c in ("page_host", "page_html", "page_wrapper"))
    rows = small_batches(pages).select(*[f"`{c}`" for c in kept], host_of(url).alias(of_host), F.col(f"`{page}`").alias(of_page))
    shared = None
    if size <= BROADCAST_BYTES:
        found = {r["host"]: r["wrapper"] for r in known.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(found)
        rows = rows.withColumn(of_wrapper, F.lit(None).cast("string"))
    else:
        joined = known.select(F.col("host").alias(of_host), F.col("wrapper").alias(of_wrapper))
        rows = rows.join(joined, of_host, "left").select(*[f"`{c}`" for c in kept], of_host, of_page, of_wrapper)
    schema = pages.select(*[f"`{c}`" for c in kept]).withColumns({out: F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    n = len(kept)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, Places] = {}
        for batch in batches:
            out_texts = []
            for host, body, wrapper in zip(*(batch.column(n + i).to_pylist() for i in range(3))):
                if host not in places:
                    if len(places) > 2_000:
                        places.clear()
                    places[host] = Places.of(shared.value.get(host) if shared else wrapper)
                out_texts.append(main_text(body, places[host]))
            lengths = pa.array([len(t) for t in out_texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out_texts, pa.string()), lengths], names=[*kept, out, "n_chars"])

    return rows.mapInArrow(texts, schema)
