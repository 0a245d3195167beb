"""Every registered query against its SQL twin in DuckDB."""

import pytest

import __spark_entry__ as contract
from compare import compare, connect
from lanepulse.testbed import oracle, queries

QUERIES, ORACLES = queries.queries(), oracle.oracle_sql()
# Percentiles from sketches: their rank error is tested in test_sketches.
NO_SQL = {f"{name}_from_sketches" for name in (
    "overall_speed", "overall_volume", "overall_occupancy", "overall_wide", "road_capacity_estimates",
    "lane_capacity_estimates")}
# Fitted models: tested in test_outlook and test_network.
NO_SQL |= {"road_clusters", "next_hour_forecast"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    ok, _, why = compare(spark, duck, sf_dir, name, QUERIES[name], ORACLES[name])
    assert ok, why


def test_entry(spark):
    result = contract.entry(spark)
    assert result.count() > 0 and result.columns[:2] == ["Road_EN", "District"]
