"""The operators of this subpackage as queries over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import (
    chat_spans,
    heavy_hitter_dedup,
    histogram_shards,
    html_wrappers,
    ordinal_quality,
    pivotal_mix,
    revisit_asof,
    simhash_balls,
    simhash_tables,
    string_tiling,
    token_alignment,
    toxicity_grammar,
    whitening,
)
from farpoint.llm.common import table, text_or_empty
from farpoint.llm.oracles import ORACLES  # noqa: F401
from farpoint.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op2_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op3_simhash_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search: the fingerprints of ids divisible by 100 against all others (``near_fingerprints``: how many are found)."""
    marked = materialize(simhash_tables.with_edits(table(spark, sf_dir, "documents")), "marked")
    asked = marked.where("doc_id % 100 = 0").select(F.col("fp").alias("query")).distinct()
    found = simhash_tables.within_radius(asked, marked.select("fp").distinct())
    near = found.groupBy("query").agg((F.count("*") - 1).alias("near_fingerprints")).withColumnRenamed("query", "fp")
    return marked.join(near, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash_tables.hex_digits("fp").alias("fingerprint"),
        simhash_tables.hex_digits("edited_fp").alias("edited_fingerprint"),
        simhash_tables.likeness("fp", "edited_fp").alias("near_edited"),
        simhash_tables.likeness("fp", "next_fp").alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.col("near_fingerprints")).alias("near_fingerprints"),
    )


@_query
def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = pivotal_mix.with_copies(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


@_query
def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_shards.with_shards(docs, shards=16).select(
        "doc_id",
        histogram_shards.size_bytes().alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = ordinal_quality.fit(docs, labels.select("doc_id", ordinal_quality.graded(labels).alias("grade")))
    return ordinal_quality.with_grades(docs.withColumn("held_out", ordinal_quality.in_held_out()), model)


@_query
def op7_revisit_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawl = revisit_asof.crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = revisit_asof.resolved(crawl)
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(entries, "\n"))


@_query
def op8_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_spans.with_control_case(table(spark, sf_dir, "conversations"))
    return chat_spans.digests(chat_spans.formatted(conversations))


@_query
def op9_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_balls.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_balls.hex_digits("fp").alias("fingerprint"), "component_id")


@_query
def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity_grammar.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    marked = docs.withColumn("held_out", toxicity_grammar.in_held_out())
    scored = toxicity_grammar.with_scores(marked, grammar)
    return scored.withColumn("predicted", (F.col("score") >= toxicity_grammar.THRESHOLD).cast("int"))


@_query
def op11_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitter_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


@_query
def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_table(table(spark, sf_dir, "embeddings"))


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))
