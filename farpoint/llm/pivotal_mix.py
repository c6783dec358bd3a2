"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is to be taken ``target / source size`` times, which is rarely whole.
The fractions are rounded two at a time: of a pair one gains and the other loses the same
number of words, the direction being drawn so that expectations hold, until one of the two is
taken or left.  The other goes on to the next pair.  A bucket of documents leaves one
fraction; the fractions of the buckets are paired in the next round, and so on up a tree, so
that no task sees a whole source.

The few documents that weigh much in their source are settled before the others, each paired
with all that is lighter, whose fractions move together.  What is left at the end is light, so
a source ends close to its target even if one document is a good part of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import WORD, fresh_name, text_or_empty, wide_hash
from farpoint.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
#: Fractions that a node of the tree pairs, on average.
FAN_IN = 48
#: Rows with at least this share of their stratum's words are settled first: so few that one group holds them.
HEAVY = 1 / 256
#: Strata up to so many are sent to all tasks: one short row each.
FEW_STRATA = 10_000


def size_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes (source, size)``, one row a source.

    Weights repeat over the sources in code point order, null last.  The targets add up to
    ``share`` of all sizes; none is above ``most`` times its source's size.  What a capped
    source leaves is shared among the others by weight until none is above, which is one
    level: every target is the least of its cap and ``level * weight``.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * share
    level = (wanted - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = ranked.withColumn("level", level)
    # the first source, by ratio, whose cap is not reached at its level sets the level for all after it
    free = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))
    common = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(common, F.col("level")) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _paired(items: Column) -> Column:
    """Sequential pivotal rounding of ``array<struct<rank, key, part, words, luck>>``, heaviest first.

    That order leaves a light row at the end, and so a small error.

    Gives ``struct<key, part, words, done>``: the last fraction, and ``array<struct<key, up>>``
    of what has been settled.
    """

    def step(state: Column, item: Column) -> Column:
        def moved(x: Column) -> Column:
            # the held fraction gains `rise` words or loses `fall`; the new one does the opposite
            up = x.luck * (x.rise + x.fall) < x.fall
            held_ends = F.when(up, x.held_room <= x.item_has).otherwise(x.held_has <= x.item_room)
            settled = F.struct(F.when(held_ends, x.held).otherwise(x.item).alias("key"), (up == held_ends).alias("up"))
            part = F.when(
                held_ends,
                F.when(up, (x.item_has - x.rise) / x.item_words).otherwise((x.item_has + x.fall) / x.item_words),
            ).otherwise(F.when(up, (x.held_has + x.rise) / x.held_words).otherwise((x.held_has - x.fall) / x.held_words))
            return F.struct(
                F.when(held_ends, x.item).otherwise(x.held).alias("key"),
                part.alias("part"),
                F.when(held_ends, x.item_words).otherwise(x.held_words).alias("words"),
                F.array_append(x.done, settled).alias("done"),
            )

        masses = F.struct(
            state.key.alias("held"), item.key.alias("item"), state.words.alias("held_words"), item.words.alias("item_words"),
            (state.part * state.words).alias("held_has"), ((1 - state.part) * state.words).alias("held_room"),
            (item.part * item.words).alias("item_has"), ((1 - item.part) * item.words).alias("item_room"),
            F.least((1 - state.part) * state.words, item.part * item.words).alias("rise"),
            F.least(state.part * state.words, (1 - item.part) * item.words).alias("fall"),
            item.luck.alias("luck"), state.done.alias("done"),
        )
        return _let(masses, moved)

    head = F.element_at(items, 1)
    none = F.filter(F.transform(items, lambda x: F.struct(x.key.alias("key"), (x.part > 2).alias("up"))), lambda x: x.up)
    start = F.struct(head.key.alias("key"), head.part.alias("part"), head.words.alias("words"), none.alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items)), start, step)


def _against_rest(items: Column, words: Column, mass: Column) -> Column:
    """Pivotal rounding of a stratum's heavy ``items``, heaviest first, each paired with all that is lighter.

    ``words`` and ``mass`` (words times part) are those of the whole stratum.  Gives
    ``struct<slope, base, words, mass, done>``: a light row's part becomes ``slope * part + base``.
    """

    def step(state: Column, item: Column) -> Column:
        def moved(x: Column) -> Column:
            up = item.luck * (x.rise + x.fall) < x.fall
            keeps = 1 - F.when(up, F.when(x.rest > 0, x.rise / x.rest).otherwise(0.0)).otherwise(F.when(x.free > 0, x.fall / x.free).otherwise(0.0))
            share = F.when(up, x.part + x.rise / item.words).otherwise(x.part - x.fall / item.words)
            return F.struct(
                (state.slope * keeps).alias("slope"),
                (state.base * keeps + F.when(up, 0.0).otherwise(1 - keeps)).alias("base"),
                (state.words - item.words).alias("words"),
                F.when(up, x.rest - x.rise).otherwise(x.rest + x.fall).alias("mass"),
                F.array_append(state.done, F.struct(item.key.alias("key"), (share >= 0.5).alias("up"))).alias("done"),
            )

        part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), state.slope * item.part + state.base))
        lighter = state.words - item.words

        def paired(x: Column) -> Column:
            sides = F.struct(
                x.part.alias("part"), x.rest.alias("rest"), (lighter - x.rest).alias("free"),
                F.least((1 - x.part) * item.words, x.rest).alias("rise"),
                F.least(x.part * item.words, lighter - x.rest).alias("fall"),
            )
            return _let(sides, moved)

        rest = F.least(lighter, F.greatest(F.lit(0.0), state.mass - part * item.words))
        return _let(F.struct(part.alias("part"), rest.alias("rest")), paired)

    none = F.filter(F.transform(items, lambda x: F.struct(x.key.alias("key"), (x.part > 2).alias("up"))), lambda x: x.up)
    start = F.struct(F.lit(1.0).alias("slope"), F.lit(0.0).alias("base"), words.alias("words"), mass.alias("mass"), none.alias("done"))
    return F.aggregate(items, start, step)


def _beside(items: DataFrame, strata: DataFrame, few: bool) -> DataFrame:
    """``items`` with the columns of their stratum's row in ``strata``."""
    named = strata.withColumnRenamed("stratum", "s")
    return items.join(F.broadcast(named) if few else named, F.col("stratum").eqNullSafe(F.col("s"))).drop("s")


def _heavy_first(items: DataFrame, seed: int, heavy: float) -> tuple[DataFrame, DataFrame]:
    """The light rows with the parts that are left to them, and what has been settled."""
    totals = items.groupBy("stratum").agg(F.sum("words").alias("all"), F.sum(F.col("part") * F.col("words")).alias("mass"))
    totals = materialize(totals, "strata")
    few = totals.count() <= FEW_STRATA
    luck = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(-1)), F.lit(1 << 30)) / float(1 << 30)
    entry = F.struct((-F.col("words")).alias("rank"), "key", "part", "words", luck.alias("luck"))
    great = _beside(items, totals, few).where(F.col("words") >= heavy * F.col("all"))
    gathered = great.groupBy("stratum", "all", "mass").agg(F.array_sort(F.collect_list(entry)).alias("items"))  # 1 / heavy rows at most
    worked = materialize(gathered.select("stratum", _against_rest(F.col("items"), F.col("all"), F.col("mass")).alias("r")), "heavy")
    moves = worked.select(F.col("stratum").alias("t"), "r.slope", "r.base")
    known = totals.join(moves, F.col("stratum").eqNullSafe(F.col("t")), "left").select(
        "stratum", "all", F.coalesce("slope", F.lit(1.0)).alias("slope"), F.coalesce("base", F.lit(0.0)).alias("base")
    )
    shifted = _beside(items, known, few).where(F.col("words") < heavy * F.col("all"))
    light = shifted.select("stratum", "key", (F.col("slope") * F.col("part") + F.col("base")).alias("part"), "words")
    whole = (F.col("part") < 1e-9) | (F.col("part") > 1 - 1e-9)
    settled = worked.select("stratum", F.explode("r.done").alias("d")).select("stratum", "d.key", "d.up")
    return light.where(~whole), settled.unionByName(light.where(whole).select("stratum", "key", (F.col("part") > 0.5).alias("up")))


def rounded(items: DataFrame, seed: int = 42, fan_in: int = FAN_IN, heavy: float = HEAVY) -> DataFrame:
    """``(stratum, key, up)`` for every row of ``items (stratum, key, part, words)``, 0 < part < 1, words > 0.

    Words times ``up`` add up to words times ``part`` in every stratum, but for the last
    fraction, which goes to the nearer end; before it each row is up with chance ``part`` where
    the parts of a stratum are equal, as in a mix by source.  Rows of at least ``heavy`` of a
    stratum's words come first, then rows of like weight, weight classes last, so the last
    fraction is light.
    Keys are unique in a stratum.  The draws depend on keys and seed alone, so reruns agree.
    """
    same_class = F.floor(2 * F.log2("words")).cast("int")
    light, first = _heavy_first(items, seed, heavy)
    left, settled, level = materialize(light.withColumn("class", same_class), "light"), [first], 0
    while True:
        sizes = left.groupBy("stratum", "class").agg(F.ceil(F.count("*") / fan_in).alias("buckets"))
        most = sizes.agg(F.max("buckets")).first()[0]
        if most is None:
            return first
        node = F.pmod(F.xxhash64("key", F.lit(-seed), F.lit(level)), F.col("buckets"))
        same = F.col("stratum").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))
        dealt = left.join(sizes.select(F.col("stratum").alias("s"), F.col("class").alias("c"), "buckets"), same)
        left = _round(dealt.withColumn("node", node), ["stratum", "class", "node"], seed, level, settled)
        left = left.withColumn("class", same_class)
        level += 1
        if most == 1:
            break
    # a few dozen weight classes remain, each with one fraction or a few
    left = _round(left, ["stratum"], seed, level, settled)
    done = left.select("stratum", "key", (F.col("part") >= 0.5).alias("up"))
    for part in settled:
        done = done.unionByName(part)
    return done


def _round(dealt: DataFrame, by: list[str], seed: int, level: int, settled: list[DataFrame]) -> DataFrame:
    """The fractions that are left of each node; what has been settled is added to the list."""
    luck = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    entry = F.struct((-F.col("words")).alias("rank"), "key", "part", "words", luck.alias("luck"))
    gathered = dealt.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    worked = materialize(gathered.select("stratum", _paired(F.col("items")).alias("r")), "mix")
    settled.append(worked.select("stratum", F.explode("r.done").alias("d")).select("stratum", "d.key", "d.up"))
    return worked.select("stratum", "r.key", "r.part", "r.words")


def with_copies(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the row).

    Size counts words (null text: 0).  Rows of equal id, source and size are one unit of the
    draw and share its outcome.  Wordless rows weigh nothing and keep the whole part of their
    copies.  Null sources are one source, null ids are ids.  An empty table gives an empty
    table.  Columns of ``docs`` with the four names are replaced.
    """
    names = ("size", "source_size", "target", "copies")
    docs = docs.drop(*names)
    mark = fresh_name(docs, "row_unit")
    sized = docs.withColumn("size", size_words(text))
    unit = wide_hash(F.col(key), F.col(source), F.col("size"))
    small = materialize(sized.select(F.col(source).alias("source"), unit.alias("key"), "size"), "sizes")
    targets = materialize(source_targets(small, weights, share, most), "targets")
    by_source = small.join(
        F.broadcast(targets.withColumnRenamed("source", "s")) if targets.count() <= 10_000 else targets.withColumnRenamed("source", "s"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = by_source.groupBy("source", "key").agg(
        F.first("size").alias("size"), F.count("*").alias("rows"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.first(wanted).alias("wanted"),
    )
    units = materialize(units.withColumn("whole", F.floor("wanted")).withColumn("part", F.col("wanted") - F.col("whole")), "units")
    open_ = units.where("part > 0 and size > 0").select(
        F.col("source").alias("stratum"), "key", "part", (F.col("size") * F.col("rows")).cast("double").alias("words")
    )
    drawn = rounded(open_, seed).select("key", F.col("up").cast("long").alias("up"))
    copies = units.join(drawn, "key", "left").select(
        F.col("key").alias(mark), "source_size", "target", (F.col("whole") + F.coalesce("up", F.lit(0))).cast("long").alias("copies")
    )
    return sized.withColumn(mark, unit).join(copies, mark).select(
        *[sized[f"`{c}`"] for c in docs.columns], "size", "source_size", "target", "copies"
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs`` as they are."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    names = {c: docs.columns.index(options.pop(c, d)) for c, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    counted = with_copies(docs.toDF(*plain), **options, **{c: f"c{i}" for c, i in names.items()})
    repeated = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns)])
