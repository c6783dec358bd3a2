"""SimHash fingerprints with permuted block tables, in DataFrame functions alone.

Every term of a text, a run of three words, is hashed to 64 bits; each occurrence votes for or
against each bit, so a term weighs as often as it occurs.  The fingerprint keeps the sign of
the votes.  To find all fingerprints within ``radius`` bits the 64 bits are cut into blocks,
and for each choice of blocks there is one table keyed by their bits: whatever differs in at
most ``radius`` bits agrees in all blocks of at least one choice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import text_or_empty, word_list
from farpoint.session import materialize

BITS = 64
#: Words in a term.
TERM_WORDS = 3
#: Fingerprints that differ in no more bits are found.
RADIUS = 3
#: Blocks that the bits are cut into; a table keys on all but ``RADIUS`` of them.
BLOCKS = 6
_NO_ID = -(1 << 63)
_PAIR = (1 << 32) + 1  # one bit of the lower and one of the upper half


def term_hashes(text: Column, term_words: int = TERM_WORDS) -> Column:
    """Hash of every run of ``term_words`` words (fewer words: the whole run; none: empty array)."""
    words = word_list(F.lower(text))
    runs = F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < term_words, F.array(F.xxhash64(F.concat_ws(" ", w))))
            .otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(w) - term_words),
                    lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(term_words)]),
                )
            ),
        ),
        1,
    )
    return runs


def _votes() -> list[Column]:
    """Counts of set bits, two to a sum: bit i in the lower, bit i + 32 in the upper half."""
    pair = F.lit(_PAIR).cast("long")
    return [F.sum(F.shiftrightunsigned("term", i).bitwiseAND(pair)).alias(f"votes_{i}") for i in range(BITS // 2)]


def _signs() -> Column:
    """The bits with more than half of ``terms`` votes, as a long."""
    low = F.lit(0xFFFFFFFF).cast("long")
    bits = []
    for i in range(BITS // 2):
        count = F.coalesce(F.col(f"votes_{i}"), F.lit(0).cast("long"))
        for votes, at in ((count.bitwiseAND(low), i), (F.shiftrightunsigned(count, 32), i + 32)):
            mask = (1 << at) - (1 << 64 if at == 63 else 0)
            bits.append(F.when(2 * votes > F.col("terms"), F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def fingerprints(rows: DataFrame, keys: list[str], terms: str, out: str, kept: list[str] | None = None) -> DataFrame:
    """``keys``, ``kept`` and the fingerprint ``out`` of every distinct ``keys``.

    ``terms`` is an array of hashes.  Rows with the same keys vote together; ``kept`` longs are
    functions of the keys.  No terms: fingerprint zero.
    """
    kept = kept or []
    counted = (
        rows.select(*keys, *kept, F.explode_outer(terms).alias("term"))
        .groupBy(*keys)
        .agg(F.count("term").alias("terms"), *_votes(), *[F.max(c).alias(c) for c in kept])
    )
    return counted.select(*keys, *kept, _signs().alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / float(BITS)


def hex_digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- search ------------------------------------------------------------------


def _table_masks(radius: int, blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(whole, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within_radius(queries: DataFrame, stored: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(query, fp)``: every fingerprint of ``stored (fp)`` within ``radius`` bits of one of ``queries (query)``.

    Both sides hold distinct longs.  A pair that several tables would bring is kept by the first
    of them, within the join, so nothing has to be made distinct after it.
    """
    if not 0 <= radius < blocks:
        raise ValueError("a table needs at least one block that may not differ")
    masks = _table_masks(radius, blocks)
    keys = lambda c: F.posexplode(F.array(*[F.col(c).bitwiseAND(F.lit(m).cast("long")) for m in masks]))
    left = queries.select("query", keys("query").alias("t", "k"))
    right = stored.select("fp", keys("fp").alias("tt", "kk"))
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    earlier = F.lit(False)
    for t, mask in enumerate(masks):
        earlier |= (F.col("t") > t) & (apart.bitwiseAND(F.lit(mask).cast("long")) == 0)
    met = (F.col("t") == F.col("tt")) & (F.col("k") == F.col("kk")) & (F.bit_count(apart) <= radius) & ~earlier
    return left.join(right, met).select("query", "fp")


# --- edited texts ------------------------------------------------------------


def next_ids(ids: DataFrame) -> DataFrame:
    """``(id, next_id)`` of distinct ``ids (id)``: the next lower one, after the least the greatest.

    Ids are dealt out in order; only the greatest id of each part crosses to another part.
    """
    dealt = ids.repartitionByRange(F.col("id").desc()).withColumn("part", F.spark_partition_id())
    placed = materialize(dealt, "ids")
    heads = placed.groupBy("part").agg(F.max("id").alias("head"))
    line = Window.orderBy("part")  # one row a part
    after = heads.select("part", F.lead("head").over(line).alias("follower"), F.max("head").over(Window.partitionBy()).alias("top"))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy(F.col("id").desc()))
    return placed.withColumn("inner", inside).join(after, "part").select(
        "id", F.coalesce("inner", "follower", "top").alias("next_id")
    )


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_chars``, ``edited_sha256``, ``fp``, ``edited_fp`` and ``next_fp``.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first
    as many of the next document, descending by id, after the last the first.  Null texts are
    empty.  Null ids count as the least long.  Of several rows with one id the one with the
    least text hash is the next document; each of them has the same next document.  An empty
    table gives an empty table.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"),
        text_or_empty(text).alias("text"),
    )
    # equal rows give equal results: they are worked on once and counted
    rows = rows.select("doc_id", "id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"), "text")
    small = materialize(rows.select("doc_id", "id", "h", "n"), "texts")
    first = Window.partitionBy("id").orderBy("h", "n")
    heads = small.withColumn("r", F.row_number().over(first)).where("r = 1").select(
        "id", F.col("h").alias("head_h"), F.col("n").alias("head_n")
    )
    after = materialize(next_ids(small.select("id").distinct()), "next")
    longest = small.groupBy("id").agg(F.max("n").alias("n"))
    # for each id, the id before it and how many code points that one may want
    wanted = after.join(longest, "id").select(
        F.col("next_id").alias("id"), F.col("id").alias("before"), F.expr("n div 2").alias("want")
    )
    # read by two joins with the same columns, so that the texts are shuffled once
    dealt = rows.drop("doc_id").repartition("id")
    pieces = (
        dealt.join(wanted.join(heads, "id"), "id")
        # not as equations, which would become join keys and deal the texts out once more
        .where((F.col("h").bitwiseXOR(F.col("head_h")) == 0) & (F.col("n").bitwiseXOR(F.col("head_n")) == 0))
        .select(F.col("before").alias("id"), F.substring("text", F.lit(1), F.col("want").cast("int")).alias("piece"))
        .dropDuplicates(["id"])
    )
    own = dealt.select("id", "h", "n", F.substring("text", F.lit(1), (F.col("n") - F.expr("n div 2")).cast("int")).alias("kept"))
    edited = own.join(pieces, "id").select(
        "id", "h", F.concat("kept", F.substring("piece", F.lit(1), F.expr("cast(n div 2 as int)"))).alias("edited")
    )
    digits = [F.conv(F.substring("digest", 13 * i + 1, 13), 16, 10).cast("long").alias(f"sha_{i}") for i in range(5)]
    digested = edited.select("id", "h", term_hashes(F.col("edited")).alias("terms"), F.sha2(F.col("edited"), 256).alias("digest"))
    shas = [f"sha_{i}" for i in range(5)]
    # the digest goes through the aggregate as longs, which keep it a hash aggregate
    changed = fingerprints(digested.select("id", "h", "terms", *digits), ["id", "h"], "terms", "edited_fp", shas)
    digest = F.concat(*[F.lpad(F.lower(F.hex(c)), 13 if i < 4 else 12, "0") for i, c in enumerate(shas)])
    plain = fingerprints(rows.select("id", "h", term_hashes(F.col("text")).alias("terms")), ["id", "h"], "terms", "fp")
    plain = materialize(plain, "fingerprints")
    followers = after.join(heads.join(plain, "id").where("h = head_h").select(F.col("id").alias("next_id"), F.col("fp").alias("next_fp")), "next_id")
    return (
        small.join(changed.withColumn("edited_sha256", digest).drop(*shas), ["id", "h"])
        .join(plain, ["id", "h"])
        .join(followers.select("id", "next_fp"), "id")
        .select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", "fp", "edited_fp", "next_fp")
    )
