"""Pivotal mixing and histogram shards."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from farpoint.llm import histogram_shards, pivotal_mix
from farpoint.llm.common import table


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = 0.0
        for s in list(open_):
            target[s] += left * weight[s] / total
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100}, {"a": 5, "b": 4000, None: 30, "d": 0}, {"only": 7}, {f"s{i}": 3 ** (i % 7) for i in range(20)}],
)
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in pivotal_mix.source_targets(rows).collect()}
    assert got == pytest.approx(water(sizes, pivotal_mix.WEIGHTS))


def test_mix_meets_targets_and_repeats(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    first = pivotal_mix.with_copies(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    taken, heaviest = Counter(), Counter()
    for r in first:
        assert 0 <= r.copies <= 2
        share = r.target / r.source_size
        assert int(share) <= r.copies <= int(share) + (share > int(share))
        taken[r.source] += r.copies * r["size"]
        heaviest[r.source] = max(heaviest[r.source], r["size"])
    for source, target in {r.source: r.target for r in first}.items():
        assert abs(taken[source] - target) <= heaviest[source] / 2 + 1e-6
    again = pivotal_mix.with_copies(docs.repartition(7)).select("doc_id", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in first)


def test_rounding_keeps_expectations(spark):
    rows = [("a", i, 0.3, float(1 + i % 5)) for i in range(3_000)] + [(None, i, 0.75, 2.0) for i in range(600)] + [("one", 1, 0.5, 9.0)]
    items = spark.createDataFrame(rows, "stratum string, key long, part double, words double")
    done = pivotal_mix.rounded(items, fan_in=8).collect()
    assert len(done) == len(rows) and len({(r.stratum, r.key) for r in done}) == len(rows)
    assert abs(sum(1 + r.key % 5 for r in done if r.stratum == "a" and r.up) - 0.3 * 9_000) <= 5
    assert abs(sum(r.up for r in done if r.stratum is None) - 450) <= 1
    light = [r.up for r in done if r.stratum == "a" and r.key % 5 == 0]
    assert 0.24 < sum(light) / len(light) < 0.36


def test_a_heavy_row_is_paired_with_all_others(spark):
    light = [(f"s{s}", i, 0.3, 10.0) for s in range(200) for i in range(1, 41)]
    heavy = [(f"s{s}", -s - 1, 0.3, 90.0) for s in range(200)]  # a draw depends on the key
    beyond = [("beyond", 0, 0.5, 1_000.0), ("beyond", 1, 0.5, 10.0)]
    many = [("many", 0, 0.3, 5_000.0)] + [("many", i, 0.3, 10.0) for i in range(1, 2_001)]
    items = spark.createDataFrame(light + heavy + beyond + many, "stratum string, key long, part double, words double")
    done = pivotal_mix.rounded(items).collect()
    assert Counter((r.stratum, r.key) for r in done) == Counter((r[0], r[1]) for r in light + heavy + beyond + many)
    words = {(r[0], r[1]): r[3] for r in light + heavy + beyond + many}
    taken = Counter()
    for r in done:
        taken[r.stratum] += words[r.stratum, r.key] * r.up
    assert all(abs(taken[f"s{s}"] - 147) <= 5 for s in range(200))
    assert abs(taken["many"] - 7_500) <= 5 and taken["beyond"] in (0, 10, 1_000, 1_010)
    assert 0.2 < sum(r.up for r in done if r.key < 0) / 200 < 0.4
    few = pivotal_mix.rounded(items.where("false")).collect()
    assert few == []


def test_mix_of_nasty_rows(nasty):
    counted = pivotal_mix.with_copies(nasty)
    rows = counted.collect()
    assert len(rows) == nasty.count()
    sizes = {r.doc_id: r["size"] for r in rows}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[7] == 7 and sizes[5] == 240_000
    assert len({r.copies for r in rows if r.doc_id == 1}) == 1
    mixed = pivotal_mix.mixed(nasty)
    assert mixed.columns == nasty.columns and {r["size"] for r in mixed.collect()} <= {"x", "y", "z", None} and mixed.count() == sum(r.copies for r in rows)
    assert pivotal_mix.mixed(nasty.limit(0)).count() == 0


def check_shards(rows, shards, slack):
    bytes_, slots = Counter({i: 0 for i in range(shards)}), defaultdict(list)
    for r in rows:
        bytes_[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert set(bytes_) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(bytes_.values()) / shards
    assert all(abs(b - ideal) <= slack for b in bytes_.values())


def test_shards_are_even_and_keep_equal_texts_together(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    rows = histogram_shards.with_shards(docs, shards=4).collect()
    check_shards(rows, 4, max(len(r.text.encode()) for r in rows) + 0.02 * sum(len(r.text) for r in rows) / 4)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    where = defaultdict(set)
    for r in rows:
        where[r.text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_text_is_split_by_id(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise("the same text").alias("text"))
    check_shards(histogram_shards.with_shards(docs, shards=16).collect(), 16, 60)


def test_shards_of_nasty_rows(nasty):
    out = histogram_shards.with_shards(nasty.withColumn("shard", F.lit("old")), shards=3)
    assert out.columns == [*nasty.columns, "shard", "slot"]
    rows = out.collect()
    assert len(rows) == nasty.count()
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert histogram_shards.with_shards(nasty.limit(0)).count() == 0
