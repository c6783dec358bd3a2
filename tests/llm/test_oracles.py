"""Training-data queries that have SQL, next to it."""

import pytest

import check_queries
from __spark_entry__ import queries
from farpoint.llm.oracles import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_small, name):
    assert check_queries.compare(queries()[name](spark, sf_small), check_queries.connect(sf_small), ORACLES[name]) is None


def test_dates_do_not_follow_the_session_zone(spark, sf_small):
    kept = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = queries()["op7_revisit_asof"](spark, sf_small)
        assert check_queries.compare(df, check_queries.connect(sf_small), ORACLES["op7_revisit_asof"]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
