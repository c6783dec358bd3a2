"""Toxicity grammar, ordinal quality, HTML wrappers, chat spans, revisits."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.llm import chat_spans, html_wrappers, ordinal_quality, revisit_asof, toxicity_grammar
from farpoint.llm.catalog import QUERIES
from farpoint.llm.common import table


def auc(scores, marks):
    ones, zeros = [s for s, m in zip(scores, marks) if m], [s for s, m in zip(scores, marks) if not m]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


# --- toxicity ----------------------------------------------------------------


def test_grammar_reads_clauses():
    grammar = toxicity_grammar.Grammar({"=scum": 3.0, "idio": 2.0})
    assert grammar.clause("they are scum".split()) == {"scum": pytest.approx(3.0 * toxicity_grammar.AT_TARGET)}
    assert grammar.clause("that is not scum".split()) == {"scum": pytest.approx(3.0 * toxicity_grammar.AFTER_NEGATION)}
    assert grammar.clause("someone said scum".split()) == {"scum": pytest.approx(3.0 * toxicity_grammar.REPORTED)}
    assert grammar.clause("idiots idiotic scu scums".split()) == {"idiots": 2.0, "idiotic": 2.0}
    assert "threat" in grammar.clause("i will kill you".split()) and "threat" not in grammar.clause("kill the process".split())
    assert grammar.score("a plain text") < 0.1 < 0.7 <= grammar.score("you scum. idiots! scum of idiotic idiots")
    assert 0 <= grammar.score("") < 0.1


def test_threats_are_read_in_their_place():
    grammar = toxicity_grammar.Grammar({})
    said = ["i will kill you", "i will not kill you", "somebody said we kill you", "kill the process you see"]
    weights = [grammar.clause(c.split()).get("threat", 0.0) for c in said]
    assert weights == pytest.approx([2.0, 2.0 * toxicity_grammar.AFTER_NEGATION, 2.0 * toxicity_grammar.REPORTED, 1.0])
    scores = [grammar.score(c) for c in said]
    assert len({round(v, 6) for v in scores}) == 4 and scores[0] == max(scores) and scores[3] == min(scores)
    assert grammar.clause("you kill".split()) == grammar.clause("kill you".split()) == {"threat": 2.0}
    assert grammar.clause("kill all of these you".split()) == {}


@pytest.mark.parametrize("seed", range(30))
def test_composed_transducers_equal_a_search_of_paths(seed):
    """Each transducer alone over the tags, weights multiplied, and the better way to a target."""
    rng = np.random.default_rng(seed)
    words = {toxicity_grammar.OTHER: "word", toxicity_grammar.INSULT: "scum", toxicity_grammar.THREAT: "kill",
             toxicity_grammar.TARGET: "you", toxicity_grammar.NEGATION: "not", toxicity_grammar.REPORT: "said"}
    tags = rng.choice(6, rng.integers(1, 12), p=[0.3, 0.2, 0.2, 0.1, 0.1, 0.1]).tolist()
    expected = {}
    for at, tag in enumerate(tags):
        if tag not in (toxicity_grammar.INSULT, toxicity_grammar.THREAT):
            continue
        weight = 3.0 if tag == toxicity_grammar.INSULT else toxicity_grammar.THREAT_WEIGHT
        if toxicity_grammar.NEGATION in tags[max(0, at - toxicity_grammar.REACH) : at]:
            weight *= toxicity_grammar.AFTER_NEGATION
        if toxicity_grammar.REPORT in tags[:at]:
            weight *= toxicity_grammar.REPORTED
        apart = min([abs(at - i) for i, t in enumerate(tags) if t == toxicity_grammar.TARGET], default=99)
        if tag == toxicity_grammar.INSULT:
            weight *= toxicity_grammar.AT_TARGET if apart <= toxicity_grammar.REACH else 1.0
        else:
            weight *= toxicity_grammar.AIMED[apart - 1] if apart <= toxicity_grammar.REACH else 0.0
        name = "scum" if tag == toxicity_grammar.INSULT else "threat"
        if weight:
            expected[name] = max(expected.get(name, 0.0), weight)
    found = toxicity_grammar.Grammar({"=scum": 3.0}).clause([words[t] for t in tags])
    assert found == {k: pytest.approx(v) for k, v in expected.items()}
    one, two = toxicity_grammar.NEGATING, toxicity_grammar.REPORTING
    both = toxicity_grammar.compose(one, two)
    for state, p, q, tag in zip(both.states(tags), one.states(tags), two.states(tags), tags):
        assert both.moves[state][tag][1] == pytest.approx(one.moves[p][tag][1] * two.moves[q][tag][1])


def test_the_form_is_chosen_by_folds():
    rng = np.random.default_rng(1)
    sums = np.exp(rng.normal(2.5, 1.5, 2000))  # the odds follow the logarithm
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * (np.log1p(sums) - 2.5)))).astype(float)
    fold = np.arange(2000) % toxicity_grammar.FOLDS
    x = {f: np.column_stack([np.ones(2000), [shape(v) for v in sums], np.zeros((2000, 4))]) for f, shape in toxicity_grammar.FORMS.items()}
    losses = {f: toxicity_grammar._unseen_loss(m, y, fold) for f, m in x.items()}
    assert losses["log"] < losses["sum"]
    assert toxicity_grammar.Grammar({"=bad": 2.0}, form="log").features("bad")[1] == pytest.approx(np.log1p(2.0))


def test_every_matched_word_counts_in_the_sum():
    words = [f"bad{chr(97 + i)}" for i in range(20)]
    grammar = toxicity_grammar.Grammar({f"={w}": 1.0 + i / 10 for i, w in enumerate(words)})
    features = grammar.features(". ".join(words))
    assert features[1] == pytest.approx(sum(1.0 + i / 10 for i in range(20))) and features[2] == pytest.approx(2.9)


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = QUERIES["op10_toxicity_grammar"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1_000
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.93
    flagged = [r for r in held if r.predicted]
    assert flagged and all(labels[r.doc_id] for r in flagged)


def test_toxicity_of_nasty_rows(spark, nasty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (8, 0), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        grammar = toxicity_grammar.fit(nasty, labels)
        scored = toxicity_grammar.with_scores(nasty, grammar)
        assert scored.columns == [*[c for c in nasty.columns if c != "text"], "score"]
        assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == nasty.count()
        kept = toxicity_grammar.clean_rows(nasty, grammar)
        assert kept.columns == nasty.columns
    assert toxicity_grammar.clean_rows(nasty.limit(0), grammar).count() == 0


# --- quality -----------------------------------------------------------------


def test_slopes_of_the_ordinal_loss(spark):
    rng = np.random.default_rng(1)
    rows = [([0, 3], [1.0, 0.5], 0), ([1], [2.0], 1), ([2, 3], [0.3, 1.5], 2), ([0], [1.0], 2)]
    df = spark.createDataFrame(rows, "buckets array<int>, values array<float>, grade int")
    w, cuts = rng.normal(size=4), np.array([-0.4, 0.7])
    loss, by_weight, by_cut = ordinal_quality._sums(df, w, cuts)
    for k in range(4):
        moved = w.copy()
        moved[k] += 1e-5
        assert (ordinal_quality._sums(df, moved, cuts)[0] - loss) / 1e-5 == pytest.approx(by_weight[k], abs=1e-3)
    for k in range(2):
        moved = cuts.copy()
        moved[k] += 1e-5
        assert (ordinal_quality._sums(df, w, moved)[0] - loss) / 1e-5 == pytest.approx(by_cut[k], abs=1e-3)


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = QUERIES["op6_ordinal_quality"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.tail_probability for r in held], [labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.expected_grade <= 2 for r in rows) and len(rows) == 1_000


def test_quality_of_nasty_rows(spark, nasty):
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 0), (8, 2), (99, 1)], "doc_id long, grade int")
    for ratings in (odd, odd.limit(0)):
        model = ordinal_quality.fit(nasty, ratings)
        assert np.all(np.diff(model.thresholds) > 0)
        rows = ordinal_quality.with_grades(nasty, model).collect()
        assert len(rows) == nasty.count() and all(0 <= r.tail_probability <= 1 for r in rows)
    assert ordinal_quality.with_grades(nasty.limit(0), model).count() == 0


# --- pages -------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style></head><body>
<div id="cookie-notice">We use cookies</div><header class="top"><p>Site name</p></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<script>var x = "</p><p>no";</script><aside>Side</aside><div class="ad banner">Buy</div>
<article><h1>Title &amp; {0}</h1><p>First&nbsp;block\n  of <b>{0}</b> words.<p>Second &lt;block&gt;<br>third<form><input><p>Mail</form>
<ul><li>one<li>two</ul><!-- no --><section class="comments"><p>Reader says</p></section><div class="share-buttons">Share</div></article>
<footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(i, "http://h.example/a", PAGE.format(f"w{i}"), "x") for i in range(6)], "page_id long, url string, html string, text string")
    rows = html_wrappers.extracted(pages).collect()
    for r in rows:
        w = f"w{r.page_id}"
        assert r.text == f"Title & {w}\nFirst block of {w} words.\nSecond <block>\nthird\none\ntwo"
        assert r.n_chars == len(r.text)


def test_template_text_goes_without_an_article(spark):
    page = "<body><div class=top>Welcome</div><div class=menu>Menu</div><div><p>Text {0}</p><p>More {0}</p></div><div>All rights</div></body>"
    pages = spark.createDataFrame([(i, "http://h.example/", page.format(i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_wrappers.extracted(pages).collect()} == {i: f"Text {i}\nMore {i}" for i in range(5)}


def texts_of(spark, pages):
    rows = [(i, "http://h.example/", page) for i, page in enumerate(pages)]
    found = html_wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_text_of_too_few_pages_is_not_the_templates(spark):
    page = "<body><div><h1>T{0}</h1><p>a{0}</p>{1}</div></body>"
    own = ["<p>b0</p>", "<blockquote>only here</blockquote><p>last here</p>", "<p>b2</p>"]
    pages = [page.format(i, o) for i, o in enumerate(own)]
    assert texts_of(spark, pages) == ["T0\na0\nb0", "T1\na1\nonly here\nlast here", "T2\na2\nb2"]
    # copies of a page are one page, and a notice of three different ones is the template's
    same = page.format(0, "<blockquote>same</blockquote>")
    assert texts_of(spark, [same, same, same.replace("<body>", "<body><!-- x -->")]) == ["T0\na0\nsame"] * 3
    assert texts_of(spark, [page.format(i, "<blockquote>same</blockquote>" if i < 3 else "") for i in range(5)]) == [f"T{i}\na{i}" for i in range(5)]
    assert texts_of(spark, [page.format(i, "<blockquote>same</blockquote>" if i < 2 else "") for i in range(5)])[:2] == ["T0\na0\nsame", "T1\na1\nsame"]


def test_constant_slots_go_inside_an_article_too(spark):
    page = "<body><{1}><h1>T{0}</h1><div class=qx7><p>Read our guide</p></div><p>a{0}</p><blockquote>quote {0}</blockquote>{2}</{3}></body>"
    for tag in ("article", "main", "div role=main", "div itemprop=articleBody"):
        end = tag.split()[0]
        pages = [page.format(i, tag, "<p>Read our guide</p>" if i == 1 else f"<p>b{i}</p>", end) for i in range(4)]
        # the same words in a slot where pages differ are the page's own
        assert texts_of(spark, pages) == [f"T{i}\na{i}\nquote {i}\n{'Read our guide' if i == 1 else f'b{i}'}" for i in range(4)]
        assert "Read our guide" in texts_of(spark, pages[:2])[0]


def test_pages_are_matched_against_wrappers():
    def places(*found):
        out = [html_wrappers.Place(label, least=mark in ("", "+"), repeated=mark in ("+", "*"), first=at) for at, (label, mark) in enumerate(found)]
        for a, b in zip(out, out[1:]):
            b.first = a.first if a.repeated and b.repeated else b.first
        return out

    def at(labels, *found):
        wanted = places(*found)
        return [next((i for i, p in enumerate(wanted) if p is m), None) for m in html_wrappers.matched(labels.split(), wanted)]

    assert at("a b c", ("a", ""), ("b", ""), ("c", "")) == [0, 1, 2]
    assert at("a a b", ("a", "+"), ("x", "?"), ("b", "")) == [0, 0, 2]
    assert at("p h p h p q", ("p", "+"), ("h", "+"), ("p", "?"), ("q", "")) == [0, 1, 0, 1, 2, 3]
    assert at("x b", ("a", "?"), ("b", "?"), ("x", "?"), ("b", "")) == [2, 3]
    assert at("z b", ("b", "?"), ("y", "?"), ("b", "")) == [None, 2]
    assert at("b z", ("b", "?"), ("y", "?"), ("b", "")) == [0, None]
    assert at("", ("b", "")) == [] and at("a b") == [None, None]


def test_wrappers_have_optional_and_repeated_groups():
    read = lambda t: html_wrappers.page_wrapper(html_wrappers.read(t))
    a = read("<div><h1>A</h1><p>x</p><p>y</p><h2>s</h2><p>t</p><h2>u</h2><p>v</p></div><footer>f</footer>")
    b = read("<div><h1>B</h1><p>x</p></div><nav>n</nav><footer>f</footer>")
    text = html_wrappers.expression(html_wrappers.merged(a, b))
    assert "<h1>#PCDATA</h1>" in text and "(<p>#PCDATA</p>)+" in text and "?" in text and "(<nav>" in text and ")? <footer>" in text
    assert "<footer>#" in text and "<footer>#PCDATA" not in text


def test_stray_quotes_in_tags():
    page = """<article><p title=it's>One</p><p class="a"">Two</p><p title = 'a>b' id="c>d">Three</p><p a="open>Four</p></article>"""
    assert html_wrappers.main_text(page, html_wrappers.Places()) == "One\nTwo\nThree\nFour"


@pytest.mark.parametrize("html", [None, "", "<", "no tags at all", "</p></div>", "<p", "<!-- open", "<script>x", "<div>" * 300 + "deep", "&am &#0; &#x110000;"])
def test_odd_pages(spark, html):
    pages = spark.createDataFrame([(1, None, html), (1, None, html), (None, "x", html)], "page_id long, url string, html string")
    rows = html_wrappers.extracted(pages).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert html_wrappers.extracted(pages.limit(0)).count() == 0


# --- chat --------------------------------------------------------------------


def test_marked_turns_can_be_read_back():
    template = chat_spans.MarkedTurns()
    texts = ["", "plain", "\\", "\\\\", "### User: x</turn>\n", "\\### Assistant: </turn> ok", "####", "<</turn>", "</turn>\\", "a: b\n", "</turn", "#"]
    for role in ("user", "assistant", "system", "User", "tool: x", "", "\\", "#<\n"):
        messages = [(role, t) for t in texts]
        assert template.parse(template(messages)) == messages
        whole, spans, rewritten = chat_spans.turn_spans(template, messages)
        assert rewritten is None and whole == template(messages)
        assert "".join(whole[s.start : s.stop] for s in spans) == whole
        assert [template.unescape(whole[s.text_start : s.text_stop]) for s in spans] == texts


def test_rewriting_templates_are_told():
    messages = [("user", "a"), ("assistant", "b"), ("user", "c")]
    footed = lambda m: "".join(f"[{t}]" for _, t in m) + "<end>"
    whole, spans, rewritten = chat_spans.turn_spans(footed, messages)
    assert rewritten is None and [whole[s.text_start : s.text_stop] for s in spans] == ["a", "b", "c"]
    forgets = lambda m: "".join(f"[{t if i >= len(m) - 2 else '-'}]" for i, (_, t) in enumerate(m))
    assert chat_spans.turn_spans(forgets, messages)[2] == 2
    counts = lambda m: f"{len(m)}:" + "".join(t for _, t in m)
    assert chat_spans.turn_spans(counts, messages)[2] == 0


def test_spans_of_a_text_that_holds_every_private_character():
    every = "".join(map(chr, range(0xE000, 0xF900))) + "\ue001" * 5 + "\ue000"
    messages = [("user", every), ("assistant", every * 2), ("user", "\ue001" * 9)]
    render = chat_spans.MarkedTurns()
    whole, spans, rewritten = chat_spans.turn_spans(render, messages)
    assert rewritten is None and [whole[s.text_start : s.text_stop] for s in spans] == [t for _, t in messages]


def test_chat_query_against_plain_python(spark, sf_small):
    turns = defaultdict(list)
    for r in table(spark, sf_small, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    rows = {r.conv_id: r for r in QUERIES["op8_chat_spans"](spark, sf_small).collect()}
    assert rows.keys() == turns.keys()
    for k, messages in turns.items():
        loss = "".join(t for role, t in messages if role == "assistant")
        r = rows[k]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(messages), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in messages).encode()).hexdigest()


def test_chat_of_nasty_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 3, "assistant", "y"), (2, 1, "assistant", "z " * 500_000)]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, k string")
    out = {r.conv_id: r for r in chat_spans.digests(chat_spans.formatted(turns)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {1: 3, None: 1, 2: 1} and out[2].loss_chars == 1_000_000
    assert chat_spans.formatted(turns.limit(0)).count() == 0


# --- revisits ----------------------------------------------------------------


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a?b=2&utm_source=x&a=1#f": "example.com/a?a=1&b=2",
        "https://example.com": "example.com/",
        "https://u:p@example.com./?ref=1": "example.com/",
        "https://example.com?q=1": "example.com/?q=1",
        " mailto:x ": "mailto:x",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    assert {r.url: r.c for r in df.select("url", revisit_asof.canonical_url(F.col("url")).alias("c")).collect()} == cases


def test_revisits_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1_500):
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.integers(20)}.example/"
        kind = "response" if rng.random() < 0.4 else "revisit"
        headers = {"ETag": f'"{rng.integers(3)}"'} if rng.random() < 0.6 else {}
        if rng.random() < 0.5:
            headers["Last-Modified"] = f"d{rng.integers(2)}"
        rows.append((f"{kind[2]}{i:05d}", url, int(rng.integers(2_000)), kind, headers))
    rows += [("n1", None, 5, "revisit", {}), ("n2", "http://hot.example/", None, "revisit", None), ("n3", None, None, "response", None)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "record_id string, url string, time long, kind string, headers map<string,string>, canonical string")

    def expected(r):
        _, url, time, _, headers = r
        earlier = [x for x in rows if x[3] == "response" and x[1] == url and url and time is not None and x[2] is not None and x[2] < time]
        if not earlier:
            return None, "nothing earlier"
        best = max(earlier, key=lambda x: (x[2], x[0]))
        for name, said in (("ETag", "etag"), ("Last-Modified", "last-modified")):
            if name in headers and name in best[4]:
                return (best[0], said) if headers[name] == best[4][name] else (None, "mismatch")
        return best[0], "time"

    wanted = {r[0]: expected(r) for r in rows if r[3] == "revisit"}
    for seconds in (50, 10_000):
        got = {r.record_id: (r.response_id, r.matched_by) for r in revisit_asof.resolved(df, seconds).collect()}
        assert got == wanted
    assert revisit_asof.resolved(df.limit(0)).count() == 0


def test_headers_of_a_304(spark):
    rows = [
        ("a", "http://x.example/", 1, "response", {"ETag": "W/\"1\"", "Content-Length": "9", "Date": "d1", "X": "y"}),
        ("b", "https://x.example/#f", 2, "revisit", {"etag": "\"1\"", "content-length": "0", "date": "d2", "Cache-Control": "no"}),
        ("b", "https://x.example/#f", 2, "revisit", {"etag": "\"1\"", "content-length": "0", "date": "d2", "Cache-Control": "no"}),
    ]
    df = spark.createDataFrame(rows, "record_id string, url string, time long, kind string, headers map<string,string>")
    out = revisit_asof.resolved(df).collect()
    assert len(out) == 2 and {r.response_id for r in out} == {"a"}
    assert out[0].headers == {"etag": '"1"', "content-length": "9", "date": "d2", "x": "y", "cache-control": "no"}


# --- the pipeline ------------------------------------------------------------


def test_pipeline_keeps_columns_and_cleans(spark, sf_small, nasty):
    import corpus_pipeline

    docs = table(spark, sf_small, "documents")
    bench = [r.text for r in table(spark, sf_small, "benchmark").collect()]
    dirty = spark.createDataFrame([(9_000, "x " + bench[0]), (9_001, docs.first().text)], "doc_id long, text string")
    now = docs.unionByName(dirty, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf_small).cache()
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "near_dedup":
            assert after.where("doc_id = 9001").count() == 0
        if name == "decontamination":
            assert after.where("doc_id = 9000").count() == 0 and after.count() > 100
        now = after
    assert now.columns == [*docs.columns, "shard", "slot"]


def test_pipeline_shingles_have_four_words(spark, sf_small):
    import corpus_pipeline

    # the shingles of the last two are all alike; the first has one of three words
    docs = spark.createDataFrame([(1, "la la la"), (2, "la la la la"), (3, "la la la la la")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_small).collect()) == [1, 2]


def test_pipeline_on_nasty_rows(spark, sf_small, nasty):
    import corpus_pipeline

    for docs in (nasty.drop("size"), nasty.drop("size").limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_small)
        assert docs.columns[-2:] == ["shard", "slot"]
        docs.collect()
