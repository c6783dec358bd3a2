"""Exact deduplication with a heavy-hitter split, in DataFrame functions alone.

A text is known by its SHA-256 digest.  Spark's ``approx_top_k`` keeps a Misra-Gries summary of
the digests in every task, counters of bounded number that all lose the same amount when they
run out, and merges the summaries: one pass, and no row is shuffled.  The candidates are counted
exactly; those with more than one row in ``HEAVY + 1`` are the winners, of which there can be no
more than ``HEAVY``.  The winners are broadcast and their rows settled where they lie.  What
remains has no large group and goes through an ordinary shuffle by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farpoint.llm.common import fresh_name, row_key, text_or_empty
from farpoint.session import materialize

#: Digests with more than one row in ``HEAVY + 1`` are heavy: at most so many exist, whatever the input.
HEAVY = 1024
#: Counters of a summary.  Spark gives a summary a map of the next power of two above 4/3 of this, and an
#: error of at most 3.5 in that number; a digest is listed once it has twice the error, here one row in 2340.
COUNTERS = 10_000


def digest_of(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def heavy_candidates(rows: DataFrame, digest: str = "digest", counters: int = COUNTERS) -> DataFrame:
    """``(h)``: hashes of digests from the merged Misra-Gries summaries, at most ``counters`` rows.

    No digest of more than twice the summary's error is missing; light ones may be listed.
    """
    hashed = rows.select(F.xxhash64(digest).alias("h"))
    summary = hashed.agg(F.expr(f"approx_top_k(h, {counters}, {counters})").alias("top"))
    return summary.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))


def winners(rows: DataFrame, best: Column, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """``(digest, rows, best)`` of the heavy digests of ``rows (digest, ..)``: exact counts, at most ``heavy`` rows.

    ``best`` is an aggregate over the rows of a digest.
    """
    if counters < 7 * (heavy + 1) * 3 // 4:
        raise ValueError("the summary is too small to list every heavy digest")
    listed = rows.join(F.broadcast(heavy_candidates(rows, counters=counters)), F.xxhash64("digest") == F.col("h"))
    counted = listed.groupBy("digest").agg(F.count("*").alias("rows"), best.alias("best"))
    return counted.where(F.col("rows") * (heavy + 1) > rows.count())


def duplicate_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, counters: int = COUNTERS
) -> DataFrame:
    """One row per row of ``docs``: its key, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal if all their bytes are; a null text is empty.  Of equal texts the row with
    the largest key stays, a null key being less than any other; of several rows with that key
    one stays.  An empty table gives an empty table.  Other columns of ``docs`` play no part.
    """
    digests = docs.select(F.col(key).alias("k"), digest_of(text_or_empty(text)).alias("digest"))
    # written once, so that the row numbers hold: they tell apart rows that share key and text
    rows = materialize(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    last = F.struct(F.col("k").isNotNull().alias("known"), "k", "row")
    heads = materialize(winners(rows, F.max(last), heavy, counters), "heavy")
    # at most ``heavy`` rows of some 60 bytes: bounded whatever the input, so broadcast without a check
    settled = rows.join(F.broadcast(heads), "digest")
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(heads.select("digest")), "digest", "left_anti").select(
        "k", "row", "digest", F.count("*").over(group).alias("rows"), F.max(last).over(group).alias("best")
    )
    return settled.select(*light.columns).unionByName(light).select(
        F.col("k").alias(key),
        F.col("best.k").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY, counters: int = COUNTERS
) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all columns: those that ``duplicate_groups`` keeps.

    Of rows with the same text and key the one of greatest row hash stays.  Copies of heavy texts
    are dropped while reading, before anything is shuffled.
    """
    digest, mark, best = (fresh_name(docs, c) for c in ("text_digest", "row_mark", "row_best"))
    order = F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("k"), row_key(docs).alias("row"))
    marked = docs.withColumns({digest: digest_of(text_or_empty(text)), mark: order})
    slim = materialize(marked.select(F.col(digest).alias("digest"), F.col(mark).alias("order")), "digests")
    heads = materialize(winners(slim, F.max("order"), heavy, counters), "heavy")
    heads = F.broadcast(heads.select(F.col("digest").alias(digest), F.col("best").alias(best)))
    left = marked.join(heads, digest, "left").where(F.col(best).isNull() | (F.col(mark) == F.col(best)))
    # rows equal in all columns may be as many as they like: they are reduced before the shuffle
    rank = fresh_name(docs, "row_rank")
    first = Window.partitionBy(digest).orderBy(F.col(mark).desc())
    return left.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).select(*[f"`{c}`" for c in docs.columns])
