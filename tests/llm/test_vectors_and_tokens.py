"""Heavy-hitter deduplication, whitening and tokenizer alignment against brute force."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from __spark_entry__ import queries
from farpoint.llm import heavy_hitter_dedup, token_alignment, whitening
from tests.llm.conftest import LONG, listed

# --- exact deduplication -----------------------------------------------------------


def _groups(rows):
    """``(id, keep_id, group_size, kept, sha)`` of ``(id, text)`` rows."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for text, keys in groups.items():
        keys = sorted(keys, key=lambda k: (k is not None, k or 0), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keys[0], len(keys), at == 0, sha) for at, k in enumerate(keys)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [1, 3, 1024])
def test_duplicate_groups_equal_brute_force(spark, heavy):
    rng = random.Random(heavy)
    texts = ["hot"] * 300 + ["warm"] * 60 + [f"t{rng.randrange(200)}" for _ in range(300)] + [None, ""] * 20
    rows = [(rng.choice([None, i, i, i % 50]), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert listed(heavy_hitter_dedup.duplicate_groups(docs, heavy=heavy)) == _groups(rows)
    kept = heavy_hitter_dedup.distinct_texts(docs, heavy=heavy)
    assert kept.columns == docs.columns
    expected = sorted(((k, t) for k, _, _, stays, t in _groups(rows) if stays), key=repr)
    assert sorted(((k, hashlib.sha256((t or "").encode()).hexdigest()) for k, t in kept.collect()), key=repr) == expected


def test_heavy_digests_are_found_and_bounded(spark):
    """The summary lists every digest beyond its share, also when it has to drop counters again and again."""
    rows = spark.range(200_000).selectExpr("sha2(cast(if(id % 5 = 0, id % 7, id) as string), 256) as digest")
    from pyspark.sql import functions as F

    found = {r.digest: r.rows for r in heavy_hitter_dedup.winners(rows, F.count("*"), heavy=100, counters=600).collect()}
    wanted = {hashlib.sha256(str(i).encode()).hexdigest() for i in range(7)}
    assert set(found) == wanted and sum(found.values()) >= 40_000
    with pytest.raises(ValueError):
        heavy_hitter_dedup.winners(rows, F.count("*"), heavy=1024, counters=100)


def test_dedup_of_nasty_rows(spark, nasty):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert listed(heavy_hitter_dedup.duplicate_groups(nasty)) == _groups(rows)
    kept = heavy_hitter_dedup.distinct_texts(nasty.withColumnRenamed("size", "text_digest"))
    assert kept.count() == len({t or "" for _, t in rows})
    assert heavy_hitter_dedup.duplicate_groups(nasty.limit(0)).count() == 0
    assert heavy_hitter_dedup.distinct_texts(nasty.limit(0)).count() == 0


# --- whitening -----------------------------------------------------------------------


def _whole(vector):
    return [int(Fraction(c) * 1024 // 1) + 100_000 for c in vector]


def _exact_covariance(rows):
    n, d = len(rows), len(rows[0])
    mean = [Fraction(sum(r[i] for r in rows), n) for i in range(d)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / n for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e7, 1e15])
def test_covariance_by_polarisation_is_exact(spark, scale):
    rng = np.random.default_rng(int(scale) % 7)
    matrix = rng.normal(size=(60, 5)) * scale + rng.normal(size=5) * scale
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "vec_id long, vector array<double>").repartition(3)
    model = whitening.fit(df)
    rows = [_whole(r) for r in matrix.tolist()]
    exact = _exact_covariance(rows)
    assert model.n == 60 and list(model.sums) == [sum(c) for c in zip(*rows)]
    assert all(float(exact[i][j] / 4**model.shift) == model.covariance[i, j] for i in range(5) for j in range(5))


def test_whitened_rows_deviations_and_identity(spark):
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    data = [(i, r.tolist(), "x") for i, r in enumerate(matrix)] + [(0, matrix[0].tolist(), None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, whitened string").repartition(4)
    found = whitening.components_table(df).toPandas()
    rows = np.array([_whole(v) for _, v, _ in data])
    n, sums = len(rows), rows.sum(axis=0)
    centred = rows - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    assert len(found) == 8 * n and set(found.n) == {n} and found.identity_error.max() < 1e-9
    far = {i: int(((n * rows[i] - sums) ** 2).sum()) for i in range(200)}
    assert all(far[i] == v for i, v in zip(found.vec_id, found.deviation))
    for component in range(1, 9):
        part = found[found.component == component].drop_duplicates("vec_id").sort_values("vec_id")
        mine = centred[:200] @ vectors[:, -component] / np.sqrt(values[-component])
        sign = np.sign(mine[0] * part.whitened.iloc[0])
        assert np.allclose(part.whitened, sign * mine, atol=1e-9)
        assert np.allclose(part.explained, values[-component] / np.trace(covariance), rtol=1e-9)


@pytest.mark.parametrize("vectors, n, columns", [
    ([], 0, 0),
    ([None, [], [None], [float("nan"), 1.0], [float("inf")]], 0, 0),
    ([[1.0, 2.0]], 1, 2),
    ([[1.0, 2.0]] * 7, 7, 2),
    ([[1.0], [2.0], [3.0, 4.0], None, [float("nan")], [None]], 2, 1),
    ([[1e300, 1.0], [-1e300, 2.0], [3.0, 1e-320]], 3, 2),
])
def test_odd_vectors(spark, vectors, n, columns):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    found = whitening.components_table(df).collect()
    assert len(found) == n * columns and all(r.n == n for r in found)
    for row in found:
        same = [_whole(v) for v in vectors if v and len(v) == columns and all(c is not None and abs(c) < float("inf") for c in v)]
        sums, x = [sum(c) for c in zip(*same)], _whole(vectors[row.vec_id])
        far = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert row.deviation == (far if far < 1 << 63 else None)
        assert row.whitened is None or np.isfinite(row.whitened)


# --- alignment -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_products_equal_dense_ones(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 3, shape) * (rng.random(shape) < 0.4) for shape in ((9, 7), (7, 11)))

    def compressed(dense):
        rows, columns = np.nonzero(dense)
        indptr = np.concatenate(([0], np.cumsum((dense != 0).sum(axis=1))))
        return token_alignment.Csr(indptr, columns, dense[rows, columns], dense.shape[1])

    for most in (1, 5, 1000):
        made = np.zeros((9, 11), int)
        for i, j, v in token_alignment.row_products(compressed(a), compressed(b), most):
            made[i, j] += v
        assert (made == a @ b).all()
    turned = compressed(a).transposed()
    back = np.zeros((7, 9), int)
    back[turned.row_of_entry(), turned.indices] = turned.data
    assert (back == a.T).all() and (token_alignment.product_sizes(compressed(a), compressed(b)) == (a != 0) @ (b != 0).sum(axis=1)).all()


def _brute(text, a, b):
    """Spans of both tokenizers by loops: ids, groups string, links ``(i, j, shared)``; None without tokens."""
    if not text:
        return None
    ids = a.ids([f" {text}"])[0], b.ids([f" {text}"])[0]
    spans = []
    for side, tokens in zip((a, b), ids):
        at, mine = 0, []
        for t in tokens:
            mine.append((at, at + len(side.token_bytes[t])))
            at = mine[-1][1]
        spans.append(mine)
        if b"".join(side.token_bytes[t] for t in tokens) != f" {text}".encode():
            return None
    linked = [(i, j, min(p[1], q[1]) - max(p[0], q[0])) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]]
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    group = [[sum(e < s[1] for e in ends) for s in mine] for mine in spans]
    written = ";".join("|".join(",".join(str(t) for t, g in zip(ids[s], group[s]) if g == k) for s in (0, 1)) for k in range(len(ends)))
    return ids, linked, written, len(ends), group


TEXTS = [
    "plain words of a text", "plain words of a text", None, "", " ", "two  spaces\tand\nlines\r\n", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ a mark that pieces write for spaces", "é ñ ß 你好，世界 \U0001f600 naïve", "\x00 nul", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't won't I'll",
    "  leading and trailing  ", "1234567890 3.14159", "é combined", "ไทยไม่มีช่องว่าง",
]


@pytest.fixture(scope="module")
def files(spark):
    return token_alignment.Files.sent(spark.range(1))


def _expected(texts, a, b):
    parts = [_brute(t, a, b) for t in texts]
    count = Counter((p[0][0][i], p[0][1][j]) for p in parts if p for i, j, _ in p[1])
    most = {}
    for (_, second), n in count.items():
        most[second] = max(n, most.get(second, 0))
    rows = []
    for p in parts:
        if p is None:
            rows.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        pairs = [(p[0][0][i], p[0][1][j]) for i, j, _ in p[1]]
        shared = sum(x == y for x in p[4][0] for y in p[4][1])
        rows.append((len(p[0][0]), len(p[0][1]), p[3], len(pairs), sum(count[q] == most[q[1]] for q in pairs),
                     sum(count[q] for q in pairs), hashlib.sha256(p[2].encode()).hexdigest(), shared))
    return rows


@pytest.mark.parametrize("block, slice_", [(8 << 20, 1 << 20), (64, 16)])
def test_alignments_equal_brute_force(spark, files, monkeypatch, block, slice_):
    a, b = files.sides()
    docs = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a long").repartition(3)
    found = token_alignment.alignments(docs, files=files, block_bytes=block).collect()
    by_id = {r.doc_id or 0: tuple(r)[1:] for r in found}
    assert [by_id[i] for i in range(len(TEXTS))] == _expected(TEXTS, a, b)
    # slices of any size give the same block
    kept = token_alignment._block_columns(0, [t or "" for t in TEXTS], a, b)
    monkeypatch.setattr(token_alignment, "SLICE_BYTES", slice_)
    assert all(p.equals(q) for p, q in zip(kept, token_alignment._block_columns(0, [t or "" for t in TEXTS], a, b)))


def test_units_are_encoded_as_within_their_text(files):
    """What both tokenizers make of a text is what they make of its units, whatever stands around a space."""
    a, b = files.sides()
    assert a.apart and b.apart
    rng = random.Random(7)
    letters = [*"ab'sT1.!é你ก", " ", " ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", "\u00a0", "\u200b"]
    for _ in range(3000):
        text = " " + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 20)))
        units = token_alignment._APART.split(text)
        assert "".join(units) == text and all(u.startswith(" ") for u in units)
        for side in (a, b):
            assert [i for ids in side.ids(units) for i in ids] == side.ids([text])[0]


def test_links_of_both_kinds(spark, files):
    a, b = files.sides()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    parts = [_brute(t, a, b) for t in TEXTS]
    overlap = [(k, i, j, p[0][0][i], p[0][1][j], s) for k, p in enumerate(parts) if p for i, j, s in p[1]]
    assert sorted(map(tuple, token_alignment.links(docs, files=files).collect())) == sorted(overlap)
    group = [(k, i, j) for k, p in enumerate(parts) if p for i, g in enumerate(p[4][0]) for j, h in enumerate(p[4][1]) if g == h]
    found = token_alignment.links(docs, by="group", files=files)
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(group)


def test_alignment_of_nasty_rows(spark, nasty, files):
    found = token_alignment.alignments(nasty, files=files)
    assert found.count() == nasty.count()
    long = next(r for r in found.collect() if r.doc_id == 5)
    a, b = files.sides()
    assert long.n_a == len(a.ids([f" {LONG}"])[0]) and long.n_links == long.n_a + long.n_b - long.n_groups
    assert token_alignment.alignments(nasty.limit(0), files=files).count() == 0
    nothing = token_alignment.alignments(nasty.where("text is null"), files=files)
    assert {(r.n_a, r.n_links, r.groups_sha256) for r in nothing.collect()} == {(0, 0, "")}


def test_queries_run_on_whole_tables(spark, sf_small):
    documents = spark.read.parquet(f"{sf_small}/documents.parquet")
    found = queries()["op13_token_alignment"](spark, sf_small)
    assert found.count() == documents.count()
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    a, b = token_alignment.Files.sent(documents).sides()
    assert [tuple(r)[1:4] for r in found.orderBy("doc_id").collect()][:20] == [r[:3] for r in _expected(texts[:20], a, b)]
    vectors = spark.read.parquet(f"{sf_small}/embeddings.parquet").count()
    assert queries()["op12_polarised_whitening"](spark, sf_small).count() == 8 * vectors
