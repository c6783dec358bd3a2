"""Registered queries next to their SQL.  All of them with FARPOINT_ALL=1; by default a few
of each family, on the same tables."""

import os

import pytest

import check_queries
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.01"
SOME = (
    "a2_scan_with_partitions",
    "b12_fields_per_line",
    "b15_first_matching_lines",
    "c3_unseen_category",
    "c4_column_stats",
    "p1_components",
    "x3_mixed_rms",
    "k10_majority_class",
    "k13_sub_cluster_classes",
    "t3_percent_ascending",
    "l5_weighted_centroid_lof",
    "l9_ties_kept",
    "v1_support_vectors_in_blocks",
    "e7_threshold_grid",
    "e8_report_rollup",
    "s4_center_history",
    "detector_majority_label",
)
NAMES = sorted(oracle_sql()) if os.environ.get("FARPOINT_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert check_queries.compare(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="benchmark tables not there")
def test_entry(spark):
    assert entry(spark).count() == 1
