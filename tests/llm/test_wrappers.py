"""HTML wrappers: what decides the text, near copies, deep pages, and alignment on random trees."""

import itertools
import json
import random

import pytest

from farpoint.llm import html_wrappers as hw
from tests.llm.test_texts import texts_of


def alone(page):
    return hw.main_text(page, hw.Places())


def test_the_region_is_where_own_text_weighs():
    assert alone("<main><h1>Head</h1><p>Real text</p><article></article></main>") == "Head\nReal text"
    assert alone("<main><h1>Head</h1><p>Real text</p><article><p>card</p></article></main>") == "Head\nReal text"
    assert alone("<div id=content>text</div><article><h3>Read also</h3></article>") == "text"
    assert alone("<p>See also</p><article><h1>T</h1><p>The article itself, of some length</p></article>") == "T\nThe article itself, of some length"
    assert alone("<article><h1>Only a heading</h1></article>") == "Only a heading"


@pytest.mark.parametrize("name, kept", [
    ("widget-body social-science legal", True), ("cookie-recipe", True), ("reading-list", True), ("adobe", True), ("header-image-story", True),
    ("site-header", False), ("cookie-banner", False), ("ad", False), ("ad-slot-3", False), ("share-buttons", False), ("mainNav", False),
    ("sidebar left", False), ("related-posts", False), ("comments", False), ("box newsletter", False),
])
def test_names_are_read_whole(name, kept):
    assert alone(f"<div><p>Text</p><div class='{name}'><p>inside</p></div></div>") == ("Text\ninside" if kept else "Text")
    assert alone(f"<div><p>Text</p><div id='{name.replace(' ', '-') if kept else name.split()[-1]}'>inside</div></div>") in ("Text\ninside", "Text")


def test_copies_with_other_sidebars_keep_their_text(spark):
    page = "<body><aside><ul>{0}</ul></aside><article><h1>Title</h1><p>The one article of this host.</p></article></body>"
    pages = [page.format("<li>link</li>" * i + f"<li>own {i}</li>") for i in range(1, 5)]
    assert texts_of(spark, pages) == ["Title\nThe one article of this host."] * 4
    near = "<body><article><h1>Title</h1><p>First paragraph of the same article.</p><p>Second one, as long.</p><p>{0}</p></article></body>"
    assert texts_of(spark, [near.format(i) for i in range(4)]) == [
        f"Title\nFirst paragraph of the same article.\nSecond one, as long.\n{i}" for i in range(4)
    ]


def test_a_text_of_few_pages_of_many_is_their_own(spark):
    plain = [f"<body><article><h1>T{i}</h1><p>Paragraph number {i} here</p></article></body>" for i in range(20)]
    quoting = [f"<body><article><h1>Q{i}</h1><p>Quoting page {i} here</p><blockquote>Same words</blockquote></article></body>" for i in range(3)]
    found = texts_of(spark, plain + quoting)
    assert found[:20] == [f"T{i}\nParagraph number {i} here" for i in range(20)]
    assert found[20:] == [f"Q{i}\nQuoting page {i} here\nSame words" for i in range(3)]


def test_wrappers_change_rows_without_article_tags(spark):
    """On a host that marks nothing, the template's texts are known by the wrapper alone."""
    page = "<div class=x1><p>Welcome to us</p></div><div class=x2><h1>T{0}</h1><p>Words of page {0}</p></div><div class=x3><p>All rights</p></div>"
    pages = [page.format(i) for i in range(6)]
    assert texts_of(spark, pages) == [f"T{i}\nWords of page {i}" for i in range(6)]
    assert sum(alone(p) != t for p, t in zip(pages, texts_of(spark, pages))) == 6


def test_deep_pages_and_clashing_columns(spark):
    deep = "<div>" * 5000 + "deep<p>x</p>" + "<aside>" * 200 + "no" + "</aside>" * 200 + "</div>" * 5000 + "<p>after</p>"
    rows = [(1, "http://h/", deep, "a", 1), (2, "http://h/", "<p>plain</p>", "b", 2), (3, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, __host string, page_html int")
    found = hw.extracted(pages).orderBy("page_id").collect()
    assert found[0].asDict() == {"page_id": 1, "url": "http://h/", "__host": "a", "page_html": 1, "text": "deep\nx\nafter", "n_chars": 12}
    assert [r.text for r in found] == ["deep\nx\nafter", "plain", ""]


# --- random trees ------------------------------------------------------------


def random_page(rng, depth=3):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "p", "h2", "div", "ul"])
        inside = random_page(rng, depth - 1) if kind == "div" and depth else rng.choice(["alike", "same", f"own {rng.random()}"])
        parts.append(f"<{kind}>{inside}</{kind}>")
    return "".join(parts)


def fits(element, place):
    """Whether every child of a page's element has a place, and no place that must be filled is empty."""
    labels = [label for c in element.children if (label := hw._label(c))]
    met = hw.matched(labels, place.children)
    if any(m is None for m in met) or any(p.least and not any(p is m for m in met) for p in place.children):
        return False
    named = [c for c in element.children if hw._label(c)]
    return all(isinstance(c, str) or fits(c, p) for c, p in zip(named, met))


@pytest.mark.parametrize("seed", range(40))
def test_a_wrapper_covers_the_pages_it_was_made_of(seed):
    rng = random.Random(seed)
    roots = [hw.read(random_page(rng)) for _ in range(rng.randrange(1, 5))]
    wrapper = hw.page_wrapper(roots[0])
    for root in roots[1:]:
        wrapper = hw.merged(wrapper, hw.page_wrapper(root))
    placed = hw.Places.of(json.dumps(wrapper)).root
    assert fits(roots[0], placed) if len(roots) == 1 else sum(fits(r, placed) for r in roots) >= 1
    assert len(wrapper[3]) == len({hw.checksum(r) for r in roots})


def brute_match(labels, places):
    """The most labels that can have places in order, by trying all assignments."""
    best = 0
    for chosen in itertools.product([None, *range(len(places))], repeat=len(labels)):
        used = [(l, c) for l, c in zip(labels, chosen) if c is not None]
        if any(places[c].label != l for l, c in used):
            continue
        at, ok = 0, True
        for _, c in used:
            if c < at:
                ok = False
                break
            at = hw._after(places[c], c)
        if ok:
            best = max(best, len(used))
    return best


@pytest.mark.parametrize("seed", range(60))
def test_matching_places_as_many_as_possible(seed):
    rng = random.Random(seed)
    places = [hw.Place(rng.choice("abc"), least=rng.randrange(2), repeated=rng.random() < 0.4, first=i) for i in range(rng.randrange(1, 5))]
    for a, b in zip(places, places[1:]):
        b.first = a.first if a.repeated and b.repeated else b.first
    labels = [rng.choice("abcz") for _ in range(rng.randrange(0, 5))]
    met = hw.matched(labels, places)
    assert all(m is None or m.label == l for l, m in zip(labels, met))
    assert sum(m is not None for m in met) == brute_match(labels, places)


def test_pages_are_counted_by_their_least_checksums():
    pages = sorted(random.Random(1).sample(range(1 << 60), 200))
    kept = hw._union(pages[:100], pages[50:])
    assert kept == pages[: hw.PAGES_KEPT]
    assert hw.of_template(pages[:16], kept) and hw.of_template(pages[:8], kept) and not hw.of_template(pages[9:], kept)
    assert not hw.of_template(pages[:2], pages[:2])
