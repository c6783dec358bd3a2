"""Near-duplicates by balls, fingerprints with block tables, string tiling."""

import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import LONG, listed
from farpoint.llm import simhash_balls, simhash_tables, string_tiling
from farpoint.llm.common import connected_components, table


def brute_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = {f: f for f in fps}
    while True:
        new = {f: min(label[g] for g in fps if bin(f ^ g).count("1") <= radius) for f in fps}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " \t", "one", "A b c", "A b c d", "the É of the É of THE é", "x y z " * 50])
def test_fingerprint_is_the_majority(text):
    data = None if text is None else text.encode()
    assert simhash_balls.fingerprint(data) == brute_fingerprint(text)


@pytest.mark.parametrize("most", [2_000, 8_000_000])
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_cells_find_every_link(radius, most):
    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(8):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            fps.add(seed)
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for cell in range(8):
        for a, b in simhash_balls.cell_links(fps, cell, 3, radius, most):
            parent[root(a)] = root(b)
    got = {}
    for i, f in enumerate(fps.tolist()):
        got.setdefault(root(i), set()).add(f)
    wanted = {}
    for f, l in brute_components(fps.tolist(), radius).items():
        wanted.setdefault(l, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash_balls.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_near_duplicates_against_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    label = brute_components(sorted(set(fps.values())), 4)
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    rows = simhash_balls.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows} == {i: (f, least[label[f]]) for i, f in fps.items()}


def test_near_duplicates_of_nasty_rows(nasty):
    rows = simhash_balls.near_duplicates(nasty).collect()
    assert len(rows) == nasty.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by_id[1] == by_id[6] == {(next(iter(by_id[1]))[0], 1)}
    assert by_id[2] == by_id[3] == by_id[4] == {(0, 2)}
    assert {c for _, c in by_id[None]} == {2, None}
    assert simhash_balls.near_duplicates(nasty.limit(0)).count() == 0


def test_one_of_each_keeps_a_whole_row(nasty):
    kept = simhash_balls.one_of_each(nasty)
    assert kept.columns == nasty.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [-9, 0, 1, 2, 5, 7, 8]
    assert simhash_balls.one_of_each(nasty.limit(0)).count() == 0


def test_rows_that_differ_only_in_where_nulls_are(spark):
    rows = [(1, None, "a", {"k": 1}), (1, "a", None, {"k": 1}), (2, "b c", None, {"k": 1}), (2, "b c", None, {"k": 1}), (2, "b c", None, {"k": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra map<string,int>")
    kept = [(r.doc_id, r.text, r.lang) for r in simhash_balls.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == [(1, "a", None), (1, None, "a"), (2, "b c", None)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 50)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.label for r in rows}
    assert len(rows) == len(got)
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90} | {200 + i: 200 for i in range(50)}


# --- block tables ------------------------------------------------------------


def edited(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for i, k in enumerate(order):
        text, after = texts[k], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        out[k] = text[: len(text) - half] + after[:half]
    return out


def test_edits_against_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    texts = dict(docs.select("doc_id", "text").collect())
    wanted = edited(texts)
    rows = simhash_tables.with_edits(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {
        i: (len(t), hashlib.sha256(wanted[i].encode()).hexdigest()) for i, t in texts.items()
    }
    again = spark.createDataFrame([(i, t) for i, t in wanted.items()], "doc_id long, text string")
    plain = {r.doc_id: r.fp for r in simhash_tables.with_edits(again).collect()}
    assert {r.doc_id: r.edited_fp for r in rows} == plain


def test_edits_of_nasty_rows(nasty):
    rows = simhash_tables.with_edits(nasty).collect()
    assert len(rows) == nasty.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fp == by_id[6].fp and by_id[2].fp == by_id[3].fp == by_id[4].fp == 0
    assert by_id[5].n_chars == len(LONG) and by_id[7].n_chars == 18
    assert by_id[8].edited_sha256 == hashlib.sha256("oné".encode()).hexdigest()
    whole = LONG[: len(LONG) - len(LONG) // 2] + " \t\n "
    assert by_id[5].edited_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert simhash_tables.with_edits(nasty.limit(0)).count() == 0


def test_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    stored = {0, -1, -(1 << 63)}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(10):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            stored.add(base - (1 << 64) if base >> 63 else base)
    asked = sorted(stored)[::3]
    found = simhash_tables.within_radius(
        spark.createDataFrame([(q,) for q in asked], "query long"), spark.createDataFrame([(f,) for f in stored], "fp long")
    )
    near = lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 3
    assert listed(found) == sorted(((q, f) for q in asked for f in stored if near(q, f)), key=repr)


# --- string tiling -----------------------------------------------------------


def brute_tiles(doc, item, least):
    in_doc, in_item, tiles = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        n, j, i = best
        if n < least:
            return tiles
        in_doc[i : i + n] = [True] * n
        in_item[j : j + n] = [True] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(25))
def test_tiles_against_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
    doc = [rng.choice("abcde") for _ in range(rng.randint(0, 20))] + item[8:16] + ["z"] + item[:9] + [rng.choice("abc") for _ in range(9)]
    index = string_tiling.SeedIndex([("i", " ".join(item))], 3)
    found = index.pairs(" ".join(doc))
    wanted = brute_tiles(doc, item, 3)
    assert [(t) for _, tiles, _ in found for t in tiles] == wanted


@pytest.mark.parametrize("seed", range(40))
def test_tiles_of_items_that_share_lines(seed):
    rng = random.Random(seed)
    letters = "abcd"[: rng.randint(1, 4)]
    line = [rng.choice(letters) for _ in range(6)]
    items = [line + ["z"] * n + [rng.choice(letters) for _ in range(rng.randint(0, 12))] + line for n in range(3)] * 2
    doc = line * rng.randint(1, 4) + ["e"] + items[1][:9] + [rng.choice(letters) for _ in range(9)]
    index = string_tiling.SeedIndex(list(enumerate(map(" ".join, items))), 3)
    wanted = {n: tiles for n, item in enumerate(items) if (tiles := brute_tiles(doc, item, 3))}
    assert {n: tiles for n, tiles, _ in index.pairs(" ".join(doc))} == wanted
    leaking = {n for n, tiles in wanted.items() if sum(t[2] for t in tiles) >= 0.5 * len(items[n])}
    found = index.found(" ".join(doc), 0.5)
    assert {n for n, tiles, tokens in found if sum(t[2] for t in tiles) >= 0.5 * tokens} == leaking


def test_a_line_of_very_many_items():
    line = "read the text below and answer the question with one word"
    index = string_tiling.SeedIndex([(n, f"{line} " + " ".join(f"w{n}x{i}" for i in range(8))) for n in range(30_000)])
    start = time.monotonic()
    found = index.pairs(" . and then . ".join([line] * 100))
    assert [len(tiles) for _, tiles, _ in found] == [1] * 30_000
    repetitive = string_tiling.SeedIndex([(1, "ha " * 400)]).pairs("ha " * 20_000)
    assert repetitive[0][1] == [(0, 0, 400)]
    assert time.monotonic() - start < 5


def test_hashes_that_meet_are_drawn_anew(monkeypatch):
    rolling, calls = string_tiling.SeedIndex._rolling, []

    def poor(self, ids, k):
        calls.append(k)
        return rolling(self, ids, k) & np.uint64(1) if len(calls) <= 2 else rolling(self, ids, k)

    monkeypatch.setattr(string_tiling.SeedIndex, "_rolling", poor)
    index = string_tiling.SeedIndex([(1, "a b c d e f g"), (2, "h i j k l m n")], 3)
    assert [(n, t) for n, t, _ in index.pairs("x h i j k l m n a b c d")] == [(0, [(8, 0, 4)]), (1, [(1, 0, 7)])]


def test_documents_are_read_once_for_many_slices(spark):
    rng = random.Random(3)
    items = [(n, " ".join(f"w{rng.randrange(400)}" for _ in range(30))) for n in range(60)]
    docs = [(n, f"some {items[n % 60][1]} more {items[(n * 7) % 60][1][:60]}") for n in range(150)]
    docs = spark.createDataFrame([*docs, (150, None), (151, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, string_tiling.leaks(docs, bench).collect()))
    for scan_bytes, scans in ((1 << 20, 1), (2000, 3)):
        frame = string_tiling.leaks(docs, bench, slice_bytes=500, scan_bytes=scan_bytes)
        assert sorted(map(tuple, frame.collect())) == whole and len(whole) >= 150
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert (plan.count("MapInArrow") == 1) if scans == 1 else (plan.count("MapInArrow") >= scans)
        kept = string_tiling.without_leaks(docs, bench, slice_bytes=500, scan_bytes=scan_bytes)
        assert sorted(r.doc_id for r in kept.collect()) == [150, 151]


def test_leaks_and_reordered_passages(spark, nasty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    words = item.split()
    moved = " ".join(words[8:] + ["and"] + words[:8])
    half = " ".join(words[:5])
    added = spark.createDataFrame(
        [(20, f"before, {item.upper()}! after"), (21, f"x {moved} y"), (22, half), (23, LONG + " " + item)], "doc_id long, text string"
    )
    docs = nasty.unionByName(added, allowMissingColumns=True)
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    rows = string_tiling.leaks(docs, bench, slice_bytes=20).collect()
    assert sorted((r.doc_id, r.item_id, r.covered, r.tiles) for r in rows) == [(20, 1, 16, 1), (21, 1, 16, 2), (23, 1, 16, 1)]
    kept = string_tiling.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert string_tiling.leaks(docs.limit(0), bench).count() == 0
    assert string_tiling.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    chinese, thai = "光合作用把光能转化为化学能", "ภาษาไทยไม่มีช่องว่างระหว่างคำ"
    docs = spark.createDataFrame(
        [(1, f"前言{chinese}結尾"), (2, thai), (3, "so: Forty-Two is it, forty two"), (4, "forty and two"), (5, "two"), (6, "化学能"), (7, "这里不说化能学")], "doc_id long, text string"
    )
    bench = spark.createDataFrame([(1, chinese), (2, thai), (3, "forty two"), (4, "forty two"), (5, "化学能"), (6, "?!"), (7, None)], "item_id long, text string")
    rows = string_tiling.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.tokens, r.covered, r.tiles, r.longest) for r in rows) == [
        (1, 1, 13, 13, 1, 13), (1, 5, 3, 3, 1, 3), (2, 2, 24, 24, 1, 24), (3, 3, 2, 2, 1, 2), (3, 4, 2, 2, 1, 2), (6, 5, 3, 3, 1, 3)
    ]
    assert sorted(r.doc_id for r in string_tiling.without_leaks(docs, bench, slice_bytes=40).collect()) == [4, 5, 7]
    assert string_tiling.tokens_of("iPhone手机 x_1 が ไม่ naïve’s") == ["iphone", "手", "机", "x_1", "が", "ไ", "ม่", "naïve", "s"]


def test_leaks_against_all_pairs(spark, sf_small):
    docs, bench = table(spark, sf_small, "documents"), table(spark, sf_small, "benchmark")
    rows = string_tiling.leaks(docs, bench).select("doc_id", "item_id", "covered").collect()
    token = string_tiling._TOKEN
    wanted = []
    for item_id, text in bench.collect():
        item = token.findall(text.lower())
        seeds = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        for doc_id, body in docs.select("doc_id", "text").collect():
            doc = token.findall(body.lower())
            starts = [k for k in range(len(doc) - 4) if tuple(doc[k : k + 5]) in seeds]
            if starts:
                near = doc[max(0, starts[0] - 5) : starts[-1] + 10]
                covered = sum(n for *_, n in brute_tiles(near, item, 5))
                if covered >= 0.5 * len(item):
                    wanted.append((doc_id, item_id, covered))
    assert sorted(map(tuple, rows)) == sorted(wanted) and wanted
